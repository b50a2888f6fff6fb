"""Frames of a call's byte stream: 9 bytes of length, flags and stream, the payload, and a cursor if flagged."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

#: Fixed values.
END_STREAM, ERROR, COMPRESSED, TRAILER, CURSOR = 0x01, 0x02, 0x04, 0x08, 0x10
KNOWN = END_STREAM | ERROR | COMPRESSED | TRAILER | CURSOR
HEAD = struct.Struct("<IBI")
FRAME = StructType([StructField("pos", IntegerType()), StructField("flags", IntegerType()), StructField("stream_id", LongType()), StructField("payload", BinaryType()), StructField("cursor", DecimalType(20, 0)), StructField("error", StringType())])


def problem(flags: Column) -> Column:
    """What is wrong with a frame's flags, or null."""
    end, err, trailer = (flags.bitwiseAND(b) != 0 for b in (END_STREAM, ERROR, TRAILER))
    return F.when(err & trailer, "error and trailer together").when(err & ~end, "error before the end").when(trailer & ~end, "trailer before the end")


def is_message(flags: Column, payload: Column, streaming: bool = True) -> Column:
    """Whether a frame is an application message: in a stream an empty frame that ends it is not, nor ever an error or trailer."""
    special = flags.bitwiseAND(ERROR | TRAILER) != 0
    empty_end = (flags.bitwiseAND(END_STREAM) != 0) & (F.octet_length(payload) == 0)
    return ~special & ~empty_end if streaming else ~special


def encode_frames(df: DataFrame) -> DataFrame:
    """Adds ``frame``: the bytes of each row's flags, stream_id, payload and cursor (null: none), in JVM functions only."""

    def little(x: Column, size: int) -> Column:
        text = F.lpad(F.hex(x), 2 * size, "0")
        pairs = [F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))]
        return F.unhex(F.concat(*pairs))

    flags = F.col("flags").bitwiseAND(KNOWN & ~CURSOR) + F.when(F.col("cursor").isNotNull(), CURSOR).otherwise(0)
    tail = F.when(F.col("cursor").isNotNull(), little(F.col("cursor").cast("long"), 8)).otherwise(F.unhex(F.lit("")))
    return df.withColumn("frame", F.concat(little(F.octet_length("payload").cast("long"), 4), little(flags.cast("long"), 1), little(F.col("stream_id"), 4), F.col("payload"), tail))


def split_frames(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row per frame of the bytes in ``column``: the kept columns, pos, flags (unknown bits dropped), stream_id, payload, cursor, error.

    Where the bytes end within a frame, the last row has only an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, data in enumerate(batch.column(column).to_pylist()):
                at, pos = 0, 0
                while data is not None and at < len(data):
                    row = _frame(data, at)
                    rows.append((pos, *row[:5]))
                    owner.append(i)
                    at, pos = row[5], pos + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.decimal128(20, 0), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            kept = [batch.column(k).take(pa.array(owner, pa.int64())) for k in keep]
            yield pa.record_batch([*kept, *columns], [*keep, *FRAME.names])

    schema = StructType([*df.select(*keep).schema.fields, *FRAME.fields])
    return df.select(*keep, *([] if column in keep else [column])).mapInArrow(run, schema)


def _frame(data: bytes, at: int) -> tuple:
    if at + HEAD.size > len(data):
        return None, None, None, None, "the header is cut short", len(data)
    length, flags, stream = HEAD.unpack_from(data, at)
    flags &= KNOWN
    end = at + HEAD.size + length
    if end > len(data):
        return flags, stream, None, None, "the payload is cut short", len(data)
    cursor = None
    payload = data[at + HEAD.size : end]
    if flags & CURSOR:
        if end + 8 > len(data):
            return flags, stream, payload, None, "the cursor is cut short", len(data)
        cursor, end = int.from_bytes(data[end : end + 8], "little"), end + 8
    bad = "error and trailer together" if flags & ERROR and flags & TRAILER else "error before the end" if flags & ERROR and not flags & END_STREAM else "trailer before the end" if flags & TRAILER and not flags & END_STREAM else None
    return flags, stream, payload, cursor, bad, end
