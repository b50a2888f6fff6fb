"""Best-fit packing of token pieces into sequences by exact complements.

A document is its ids and an end id; only documents over ``size`` are cut, the
first piece short and all others full. What remains is one bin-packing problem
over lengths from 1 to ``size``, and equal lengths are interchangeable, so it is solved on
the histogram of lengths (at most ``size`` numbers): from the longest length
down, gaps are filled exactly by a single length, a pair or a triple that sums
to the gap, as often as the counts allow; what can't be filled exactly is
packed best-fit, longest first. The solution is a list of patterns with a
number of sequences each. Spark then deals pieces to the patterns' places by
their rank among pieces of their length; ranks come from each partition's own counting
and the partitions' counts, so no length ever meets in one task.

Defined results: null or empty text is the end id alone; repeated rows and null
ids are pieces of their own; texts of any length are read whole; pieces of equal length
are dealt in the order they are met; an empty table gives no rows; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .tokens import encoded, encoder
from .workspace import Workspace

SIZE = 1024


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, cut: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces with the partition they were cut in and their rank among its pieces of the same length."""
    encode, part = encoder(vocabulary, cut).many, TaskContext.get().partitionId()
    seen = np.zeros(size + 1, np.int64)
    for portion, found in encoded(batches, encode):
        tokens = [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in found]
        count = np.array([len(t) for t in tokens], np.int64)
        many = -(-count // size)
        row = np.repeat(np.arange(len(count)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        first = ((count - 1) % size + 1)[row]
        start = np.where(piece == 0, 0, first + (piece - 1) * size)
        length = np.where(piece == 0, first, size)
        crc = np.fromiter((zlib.crc32(tokens[r][a : a + n].tobytes()) for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)), np.int64, len(row))
        # the rank within the portion, pieces of a length one after the other
        order = np.argsort(length, kind="stable")
        here = np.bincount(length, minlength=size + 1)
        rank = np.empty(len(row), np.int64)
        rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here)
        rank += seen[length]
        seen += here
        columns = [portion.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc)), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
        yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])


def patterns(counts: list[int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) that use up ``counts`` (by length, from 0).

    Solved with complements of up to three, two, one and no lengths, as using up short lengths early can cost more than it saves
    where there are few; the solution with the fewest sequences is returned.
    """
    return min((_solved(counts, size, most) for most in (3, 2, 1, 0)), key=lambda p: sum(times for times, _ in p))


def _solved(counts: list[int], size: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    left = np.array(counts, np.int64)
    left[0] = 0
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        times = min(int(left[n]) // k for n, k in Counter(lengths).items())
        if times:
            out.append((times, lengths))
            for n in lengths:
                left[n] -= times
        return times > 0

    def pair(total: int) -> list[int]:
        """Larger members of the pairs of lengths at hand that sum to total, largest first."""
        a = np.arange(min(total - 1, size), (total - 1) // 2, -1)
        return a[(left[a] > 0) & (left[total - a] > 0)].tolist() if len(a) else []

    def exact(longest: int) -> bool:
        gap = size - longest
        if gap == 0:
            return take((longest,))
        if most >= 1 and left[gap] and take((longest, gap)):
            return True
        if most >= 2 and any(take((longest, a, gap - a)) for a in pair(gap)):
            return True
        if most >= 3:
            for a in range(min(gap - 2, size), (gap - 1) // 3, -1):
                if left[a] and any(b <= a and take((longest, a, b, gap - a - b)) for b in pair(gap - a)):
                    return True
        return False

    stuck: Counter[int] = Counter()
    for longest in range(size, 0, -1):
        while left[longest]:
            if not exact(longest):
                stuck[longest] = int(left[longest])
                left[longest] = 0
    # what no exact complement is left for: best fit, longest first, equal sequences together
    rooms = np.zeros(size + 1, np.int64)
    by_room: dict[int, Counter[tuple[int, ...]]] = {}

    def put(room: int, lengths: tuple[int, ...], number: int) -> None:
        by_room.setdefault(room, Counter())[lengths] += number
        rooms[room] += number

    for length in sorted(stuck, reverse=True):
        need = stuck[length]
        while need:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = size // length
                for per, number in ((each, need // each), (need % each, 1)):
                    if per and number:
                        put(size - per * length, (length,) * per, number)
                break
            room = length + int(fits[0])
            lengths, number = next(iter(by_room[room].items()))
            times = min(number, need)
            by_room[room][lengths] -= times
            if not by_room[room][lengths]:
                del by_room[room][lengths]
            rooms[room] -= times
            put(room - length, (*lengths, length), times)
            need -= times
    return out + [(number, lengths) for same in by_room.values() for lengths, number in same.items()]


def places(solution: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of places, its first sequence, its offset. Rank r of a run sits in sequence first + (r - first rank)."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for times, lengths in solution:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def _deal(batches: Iterator[pa.RecordBatch], runs: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "global_rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            first, start, at = runs[int(n)]
            k = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine] = start[k] + rank[mine] - first[k]
            offset[mine] = at[k]
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_sequences(docs: DataFrame, vocabulary: str, cut: str, end_id: int, size: int = SIZE) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut_rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: textkit.released(_pieces(it, vocabulary, cut, end_id, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    pieces = work.table(cut_rows, "pieces")
    by_part = work.table(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "by-part")
    total = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    runs = places(patterns([total.get(n, 0) for n in range(size + 1)], size))
    before = by_part.select("length", "part", F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n").alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("global_rank", F.col("rank") + F.col("before"))
    out = ranked.mapInArrow(lambda it: _deal(it, runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
