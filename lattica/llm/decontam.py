"""Documents that hold passages of benchmark items.

Items are cut into windows of ``width`` consecutive words (a shorter item is one window).
The windows' hashes go to every task; a task hashes all windows of its texts
at once, looks them up, compares the words of each hit, and marks the words inside. Benchmark
windows are sent in blocks of at most BLOCK_WINDOWS, whatever the benchmark's size; with several blocks each
scans the texts as they were written once, and the hits are put together per row by a key that is written with the rows.

Defined results: null has no words; an item without words is in nothing; items
with equal windows are all found; every row gives one row, repeated ones and
those without an id too; texts of any length are read whole; an empty table gives no rows,
and against an empty benchmark nothing is hit; other columns are ignored, whatever they are called,
and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .workspace import Workspace

#: Key of a row while the hits of several blocks are put together.
ROW, KEPT = "__row", "__row_of_the_table"
WIDTH = 13
#: Windows in one broadcast: about 100 MB of words and hashes at 13 words each.
BLOCK_WINDOWS = 500_000


def item_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item_id, size, hash, words) of each distinct window of each item."""
    for batch in batches:
        ids, sizes, hashes, texts = [], [], [], []
        names = batch.column("item_id").to_pylist()
        for lo, hi, data, offsets in textkit.slices(batch.column("text")):
            low, starts, ends, word, first = textkit.words(data, offsets, textkit.ALNUM)
            spell = [bytes(low[a:b]) for a, b in zip(starts, ends, strict=True)]
            for i in range(hi - lo):
                a, b = int(first[i]), int(first[i + 1])
                size = min(width, b - a)
                if size:
                    for k, h in enumerate(textkit.windows(word[a:b], size)):
                        ids.append(names[lo + i])
                        sizes.append(size)
                        hashes.append(int(h.astype(np.int64)))
                        texts.append(b" ".join(spell[a + k : a + k + size]))
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.binary())], ["item_id", "size", "hash", "words"])


class Windows:
    """Windows of items, looked up by hash and confirmed by their words."""

    def __init__(self, rows: list):
        self.items: dict[bytes, list[str]] = {}
        by_size: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault(bytes(r["words"]), []).append(r["item_id"])
            by_size.setdefault(r["size"], set()).add(r["hash"])
        self.hashes = {n: np.sort(np.array(list(h), np.int64).astype(np.uint64)) for n, h in by_size.items()}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """(number of words, marks of the hit words, items found) of each text."""
        low, starts, ends, word, first = textkit.words(data, offsets, textkit.ALNUM)
        marks = np.zeros(len(word) + 1, np.int32)
        found: dict[int, set[str]] = {}
        for size, known in self.hashes.items():
            got = textkit.windows(word, size)
            if not len(got):
                continue
            at = np.searchsorted(known, got)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == got)
            owner = np.searchsorted(first, hits, "right") - 1
            for k, i in zip(hits.tolist(), owner.tolist(), strict=True):
                if k + size <= first[i + 1]:
                    items = self.items.get(b" ".join(bytes(low[starts[j] : ends[j]]) for j in range(k, k + size)))
                    if items:
                        marks[k] += 1
                        marks[k + size] -= 1
                        found.setdefault(i, set()).update(items)
        hit = np.cumsum(marks[:-1]) > 0
        for i in range(len(offsets) - 1):
            yield int(first[i + 1] - first[i]), hit[first[i] : first[i + 1]], found.get(i, set())


def _blocks(benchmark: DataFrame, width: int, work: Workspace) -> tuple[int, Iterator[list]]:
    """The number of blocks of windows, and the blocks, each read when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(lambda it: item_windows(it, width), "item_id string, size int, hash long, words binary").distinct()
    rows = work.table(rows, "windows")
    total = rows.count()
    if total <= BLOCK_WINDOWS:
        return 1, iter([rows.collect()])
    n = 2 * -(-total // BLOCK_WINDOWS)
    return n, (rows.filter(F.expr(f"pmod(xxhash64(words), {n}) = {i}")).collect() for i in range(n))


def _scan(docs: DataFrame, key: str, block: list, all_rows: bool) -> tuple[DataFrame, object]:
    """(key, n_words, hit_words, items) of the rows, or of those with a hit, and the broadcast."""
    windows = docs.sparkSession.sparkContext.broadcast(Windows(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, items = [], [], []
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                for count, hit, found in windows.value.scan(data, offsets):
                    n.append(count)
                    hits.append(np.flatnonzero(hit).astype(np.int32))
                    items.append(sorted(found))
            out = pa.record_batch([batch.column(key), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [key, "n_words", "hit_words", "items"])
            yield out if all_rows else out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_()))

    return docs.select(key, "text").mapInArrow(lambda it: textkit.released(run(it)), f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, hit_words array<int>, items array<string>"), windows


def _in_blocks(docs: DataFrame, blocks: Iterator[list], work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows with a key, and (key, n_words, hit_words, items) of each, from the hits of all blocks. A column of the key's name gets another."""
    keyed = work.table(docs.withColumnRenamed(ROW, KEPT).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    whole = None
    for i, block in enumerate(blocks):
        hits, windows = _scan(keyed, ROW, block, i == 0)
        hits = work.table(hits, f"hits-{i}")
        windows.unpersist()
        whole = hits if whole is None else whole.union(hits)
    merged = whole.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed, merged


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, hit_words (positions), items (sorted ids as strings)."""
    work = Workspace(docs.sparkSession, "decontam")
    docs = docs.select("doc_id", "text")
    n, blocks = _blocks(benchmark, width, work)
    if n == 1:
        return _scan(docs, "doc_id", next(blocks), True)[0]
    keyed, merged = _in_blocks(docs, blocks, work)
    return keyed.select(ROW, "doc_id").join(merged, ROW).select("doc_id", "n_words", "hit_words", "items")


def judged(found: DataFrame) -> DataFrame:
    """Digest columns and verdict: a document is contaminated if at least one word in twenty is hit."""
    hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) with every hit stretch of words, and what stands between its words, taken out of the text as it was written."""
    work = Workspace(docs.sparkSession, "decontam")
    docs = docs.select("doc_id", "text")
    n, blocks = _blocks(benchmark, width, work)
    if n == 1:
        found = docs.withColumn("hit_words", F.lit(None).cast("array<int>"))
        windows = docs.sparkSession.sparkContext.broadcast(Windows(next(blocks)))
    else:
        # hits of all blocks are found in the text as it was written, before anything is taken out
        keyed, merged = _in_blocks(docs, blocks, work)
        found = keyed.join(merged.select(ROW, "hit_words"), ROW).select("doc_id", "text", "hit_words")
        windows = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            given = batch.column("hit_words").to_pylist()
            for at, _, data, offsets in textkit.slices(batch.column("text")):
                _, starts, ends, _, first = textkit.words(data, offsets, textkit.ALNUM)
                if windows is not None:
                    hits = [np.flatnonzero(hit) for _, hit, _ in windows.value.scan(data, offsets)]
                else:
                    hits = [np.array(given[at + i], np.int64) for i in range(len(offsets) - 1)]
                for i, hit in enumerate(hits):
                    own, lo = data[offsets[i] : offsets[i + 1]].tobytes(), offsets[i]
                    if len(hit):
                        edge = np.flatnonzero(np.diff(hit) > 1)
                        kept, last = [], 0
                        for a, b in zip(hit[[0, *(edge + 1)]] + first[i], hit[[*edge, len(hit) - 1]] + first[i], strict=True):
                            kept.append(own[last : starts[a] - lo])
                            last = ends[b] - lo
                        own = b"".join([*kept, own[last:]])
                    texts.append(own.decode())
            yield pa.record_batch([batch.column("doc_id"), pc.if_else(batch.column("text").is_null(), None, pa.array(texts, pa.string()))], ["doc_id", "text"])

    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that are not contaminated. With one block of windows each batch is filtered where it is scanned."""
    work = Workspace(docs.sparkSession, "decontam")
    n, blocks = _blocks(benchmark, width, work)
    if n > 1:
        keyed, merged = _in_blocks(docs, blocks, work)
        bad = merged.filter("size(hit_words) > 0 and 20 * size(hit_words) >= n_words").select(ROW)
        return keyed.join(bad, ROW, "left_anti").select(*[F.col(f"`{KEPT if c == ROW else c}`").alias(c) for c in docs.columns])
    windows = docs.sparkSession.sparkContext.broadcast(Windows(next(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, data, offsets in textkit.slices(batch.column("text")):
                keep += [not hit.any() or 20 * int(hit.sum()) < count for count, hit, _ in windows.value.scan(data, offsets)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda it: textkit.released(run(it)), docs.schema)
