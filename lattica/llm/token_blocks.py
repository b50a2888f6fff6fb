"""Token ids in files of patched frame-of-reference blocks.

A shard file (little-endian) is: 4 bytes ``PFB1``; uint64 number of documents,
ids, ids a block, blocks; then int64 document ids, uint64 end of each document
in ids, uint64 start of each block in the body (one more for the end), and the
body. A block is uint32 minimum, uint8 width, uint32 exceptions, the values
less the minimum packed at ``width`` bits each (low bits first, a short last
block filled up with its minimum), then uint16 position and uint32 full
difference of each exception. The width is that of the block's ``PERCENTILE``
smallest difference; wider ones are exceptions.

Documents are ranged by id into partitions and each task writes the shards of
its partition, so names in order hold ids in order. A file is written under a
temporary name and then moved, with the same content on every attempt.

Defined results: null or empty text is only the end id; a null id sorts first;
repeated rows and ids are written as often as they come, in any order among equals;
texts of any length are read whole and never split between files; other columns are ignored,
whatever they are called; an empty table gives no file and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .tokens import encoded, encoder

BLOCK, PERCENTILE = 256, 0.9
#: Ids of a shard, but that the last document is never split.
SHARD_IDS = 2 << 20
NULL_ID = -(1 << 63)
#: Tables beside the files: what each task wrote, and where each shard starts.
WRITTEN, SHARDS = "_written", "_shards"
HEAD = np.dtype([("base", "<u4"), ("width", "u1"), ("exceptions", "<u4")])
_GROUP = 1024


def _widths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(body, start of each block and the end)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, np.uint64)
    full = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    full[: len(ids)] = ids
    last = ids[(n - 1) * BLOCK :]
    full[len(ids) :] = last.min()
    full = full.reshape(n, BLOCK)
    base = full.min(axis=1)
    rest = full - base[:, None]
    need = _widths(rest)
    width = np.partition(need, int(BLOCK * PERCENTILE) - 1, axis=1)[:, int(BLOCK * PERCENTILE) - 1]
    extra = need > width[:, None]
    count = extra.sum(axis=1)
    sizes = HEAD.itemsize + width * (BLOCK // 8) + count * 6
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(starts[-1], np.uint8)
    head = np.zeros(n, HEAD)
    head["base"], head["width"], head["exceptions"] = base, width, count
    body[starts[:-1, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            for at in range(0, len(mine), _GROUP):
                part = mine[at : at + _GROUP]
                bits = (rest[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
                packed = np.packbits(bits.astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                body[starts[part, None] + HEAD.itemsize + np.arange(packed.shape[1])] = packed
    row, position = np.nonzero(extra)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        tail = starts[row] + HEAD.itemsize + width[row] * (BLOCK // 8)
        body[(tail + nth * 2)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(tail + count[row] * 2 + nth * 4)[:, None] + np.arange(4)] = rest[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return body.tobytes(), starts.astype(np.uint64)


def unpack(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` (without the end), a short last block still filled up."""
    starts = starts.astype(np.int64)
    n = len(starts)
    out = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return out.ravel()
    head = np.ascontiguousarray(body[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).ravel()
    width, count = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            for at in range(0, len(mine), _GROUP):
                part = mine[at : at + _GROUP]
                packed = body[starts[part, None] + HEAD.itemsize + np.arange(w * (BLOCK // 8))]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                out[part] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    if count.sum():
        row = np.repeat(np.arange(n), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        tail = starts[row] + HEAD.itemsize + width[row] * (BLOCK // 8)
        position = np.ascontiguousarray(body[(tail + nth * 2)[:, None] + np.arange(2)]).view("<u2").ravel()
        out[row, position] = np.ascontiguousarray(body[(tail + count[row] * 2 + nth * 4)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (out + head["base"][:, None]).ravel()


def shard_bytes(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    body, starts = pack(flat)
    counts = np.array([len(doc_ids), len(flat), BLOCK, len(starts) - 1], "<u8")
    return b"PFB1" + counts.tobytes() + np.array(doc_ids, "<i8").tobytes() + np.cumsum([len(x) for x in ids], dtype="<u8").tobytes() + starts.astype("<u8").tobytes() + body


class Shard:
    """A shard file's bytes; ``ids(lo, hi)`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes):
        if data[:4] != b"PFB1":
            raise ValueError("not a shard of token blocks")
        docs, self.n_ids, self.block, blocks = (int(x) for x in np.frombuffer(data, "<u8", 4, 4))
        at = 36
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs)
        self.body = np.frombuffer(data, np.uint8, offset=at + 16 * docs + 8 * (blocks + 1))

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        first = lo // self.block
        return unpack(self.body, self.starts[first : -(-hi // self.block)])[lo - first * self.block : hi - first * self.block]


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, cut: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, cut).many
    part, number, doc_ids, ids, total = TaskContext.get().partitionId(), 0, [], [], 0
    files, root = fs.FileSystem.from_uri(folder)

    def flush() -> pa.RecordBatch:
        nonlocal number, doc_ids, ids, total
        name = f"{part:06d}-{number:06d}"
        temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as out:
            out.write(shard_bytes(doc_ids, ids))
        files.move(temporary, f"{root}/{name}.pfb")
        row = pa.record_batch([[name], [len(doc_ids)], [total]], ["shard", "n_docs", "n_ids"])
        number, doc_ids, ids, total = number + 1, [], [], 0
        return row

    for portion, found in encoded(batches, encode):
        for doc_id, got in zip(portion.column("doc_id").to_pylist(), found, strict=True):
            got = np.append(got, np.uint32(end_id))
            doc_ids.append(NULL_ID if doc_id is None else doc_id)
            ids.append(got)
            total += len(got)
            if total >= SHARD_IDS:
                yield flush()
    if doc_ids:
        yield flush()


def write_token_blocks(docs: DataFrame, folder: str, vocabulary: str, cut: str, end_id: int) -> DataFrame:
    """Writes (doc_id, text) to ``folder``, in ascending doc_id; returns the shards: shard, n_docs, n_ids, start (ids of all shards before it).

    ``folder`` is a URI that executors can write. The list of shards is a table in it (one row for each 2 million ids) and never passes
    the driver: starts are sums within each partition and over the partitions' totals.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    written = ordered.mapInArrow(lambda it: textkit.released(_write(it, folder, vocabulary, cut, end_id)), "shard string, n_docs long, n_ids long")
    written.write.mode("overwrite").parquet(f"{folder}/{WRITTEN}")
    rows = spark.read.schema(written.schema).parquet(f"{folder}/{WRITTEN}").withColumn("part", F.substring("shard", 1, 6))
    before = F.expr("sum(n_ids) over (order by part rows between unbounded preceding and current row) - n_ids").alias("before")
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before)  # a row for each of ``parts``
    within = F.expr("sum(n_ids) over (partition by part order by shard rows between unbounded preceding and current row) - n_ids")
    starts = rows.withColumn("within", within).join(totals, "part").select("shard", "n_docs", "n_ids", (F.col("before") + F.col("within")).alias("start"))
    starts.write.mode("overwrite").parquet(f"{folder}/{SHARDS}")
    return spark.read.schema(starts.schema).parquet(f"{folder}/{SHARDS}")


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            shard = Shard(content.as_buffer())
            ids, starts = shard.ids(), np.concatenate([[0], shard.ends[:-1]]) if len(shard.ends) else shard.ends
            data = memoryview(ids.astype("<u4").tobytes())
            columns = [
                pa.array([path.rsplit("/", 1)[1].removesuffix(".pfb")] * len(starts)),
                pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID),
                pa.array(starts, pa.int64()),
                pa.array(shard.ends - starts, pa.int64()),
                pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)], pa.int64()),
            ]
            names = ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([starts, shard.ends[-1:]]), pa.int32()), pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.record_batch(columns, names)


def read_token_blocks(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfb").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    shards = spark.read.schema("shard string, n_docs long, n_ids long, start long").parquet(f"{folder}/{SHARDS}")
    kind = "shard string, doc_id long, in_shard long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = files.select("path", "content").mapInArrow(lambda it: textkit.released(_read(it, with_ids)), kind)
    return rows.join(shards.select("shard", F.col("start").alias("before")), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
