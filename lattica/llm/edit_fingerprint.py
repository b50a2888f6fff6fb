"""Document fingerprints from a randomised edit embedding.

Walk: a text is read character by character; each character is repeated until
a random bit, shared by all texts and drawn for (time, character), lets the
walk move on. After an edit two walks fall back into step, so texts at a small
edit distance agree at most times: edit distance becomes Hamming distance.
Walks start anew where the text itself says so: at contexts whose hash ends in
zeros, on average each CUT characters, and BLOCK characters after the last start
at the latest. So an insertion of any length puts no walk out of step beyond the
next such place, and numpy can walk many blocks at once.

Bit sampling: a fingerprint has PLACES hexadecimal digits. Place k looks at one
block, chosen by a hash of the context that the block starts with, in proportion
to its length, whatever stands before it; in the block at one random time of the
walk, by a rule that depends on the walk's length alone and changes rarely as it
grows. It holds 4 bits of a hash of the CONTEXT characters that the walk stands at.
The share of equal digits beyond chance estimates what two texts share of all that
they hold; likeness is what they share of their mean length. Near texts agree in a
band of sampled digits with high probability; documents that meet in a band are verified on
whole fingerprints and form classes.

Defined results: null counts as empty; an empty text's fingerprint is all
zeros, alike to another empty text only; equal texts have equal fingerprints; texts of
any length are read whole; repeated rows give a result each; an empty table gives no
rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_dup, textkit
from .workspace import Workspace

U = np.uint64
BLOCK, CUT, TIMES, PLACES, CONTEXT = 2048, 256, 8192, 256, 8  # CUT is a power of two
#: Characters walked at once; a longer text is walked alone.
SLICE_CHARS = 1 << 20
#: Bytes of text of a range of ids, on average, and the most ranges that the driver tells apart.
AREA_BYTES, MOST_AREAS = 16 << 20, 20_000
#: Stands for an id of null, below all ids.
NO_ID = -(1 << 63)


@functools.cache
def _bits() -> np.ndarray:
    """[character class * TIMES + time]: first time from there on at which the walk leaves the character, plus one."""
    leaves = np.random.default_rng(11).random((256, TIMES)) < 0.5
    at = np.where(leaves, np.arange(TIMES), TIMES)
    return np.minimum(np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1] + 1, TIMES - 1).astype(np.int32).ravel()


@functools.cache
def _records(longest: int) -> list[np.ndarray]:
    """For each place the lengths at which its time changes: it looks at the last of them below the walk's length."""
    rng, out = np.random.default_rng(13), []
    for _ in range(PLACES):
        draw, at = np.random.default_rng(int(rng.integers(1 << 62))), [0]
        while at[-1] <= longest:
            at.append(int((at[-1] + 1) / max(draw.random(), 1e-12)))
        out.append(np.array(at, np.int64))
    return out


def _embed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each character the time at which its block's walk leaves it. Blocks are walked side by side, a character of each at a step."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, leave = starts[order], sizes[order], _bits()
    out, time = np.empty(len(codes), np.int32), np.zeros(len(sizes), np.int32)
    rows = codes * TIMES
    alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
    for step, n in enumerate(alive.tolist()):
        at = starts[:n] + step
        time[:n] = leave[rows[at] + time[:n]]
        out[at] = time[:n]
    return out


def _digits(texts: list[np.ndarray]) -> np.ndarray:
    """[text, place]: the digits of texts given as code points."""
    length = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(CONTEXT, np.uint32)]).astype(U)
    seen = np.zeros(len(flat) - CONTEXT + 1, U)
    for k in range(CONTEXT):
        seen = (seen ^ flat[k : k + len(seen)]) * U(0x9FB21C651E98DF25)
        seen ^= seen >> U(28)
    first = np.concatenate([[0], np.cumsum(length)])
    # a context that would run into the next text ends with its own
    for k in range(1, CONTEXT):
        at = first[1:][length >= k] - k
        own = np.full(len(at), k, U)
        for j in range(k):
            own = (own ^ flat[at + j]) * U(0x9FB21C651E98DF25)
            own ^= own >> U(28)
        seen[at] = own
    codes = (textkit.mix(flat) & U(255)).astype(np.int64)
    out = np.zeros((len(texts), PLACES), np.uint8)
    some = np.flatnonzero(length)
    if not len(some):
        return out
    n_chars = int(first[-1])
    cut = np.flatnonzero(((textkit.mix(seen[:n_chars]) >> U(20)) & U(CUT - 1)) == 0)
    starts = np.union1d(first[:-1][some], cut)
    sizes = np.diff(starts, append=n_chars)
    # a block that is too long is cut each BLOCK characters
    times = -(-sizes // BLOCK)
    starts = np.repeat(starts, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * BLOCK
    sizes = np.diff(starts, append=n_chars)
    base = np.searchsorted(starts, first[:-1][some])
    leave = _embed(codes[:n_chars], starts, sizes)
    took = np.maximum(leave[starts + sizes - 1], 1)
    many = np.diff(base, append=len(starts))
    lane = np.empty((len(some), PLACES), np.int64)
    for k in range(PLACES):
        # the least of exponential draws, each over its block's length, is a choice in proportion to length
        draw = (textkit.mix(seen[starts] ^ U((k + 1) * 0xA24BAED4963EE407 % (1 << 64))) >> U(11)).astype(np.float64) / (1 << 53)
        wait = -np.log1p(-draw) / sizes
        least = np.repeat(np.minimum.reduceat(wait, base), many)
        lane[:, k] = np.minimum.reduceat(np.where(wait == least, np.arange(len(wait)), len(wait)), base)
    records = _records(TIMES)
    time = np.stack([r[np.searchsorted(r, took[lane[:, k]]) - 1] for k, r in enumerate(records)], axis=1)
    # in a block, times of leaving grow with the step: one sorted array of block * span + time
    span = TIMES + 1
    keys = leave + np.repeat(np.arange(len(sizes)) * span, sizes)
    step = np.searchsorted(keys, (lane * span + time).ravel(), "right").reshape(lane.shape) - starts[lane]
    step = np.minimum(step, sizes[lane] - 1)
    digit = textkit.mix(seen[starts[lane] + step] ^ (np.arange(PLACES, dtype=U) * U(0xD1342543DE82EF95))) & U(15)
    out[some] = digit
    return out


def fingerprints(texts: list[str]) -> list[str]:
    out, part, chars = [], [], 0
    for text in [*texts, None]:
        if part and (text is None or chars + len(text) > SLICE_CHARS):
            hexed = np.frombuffer(b"0123456789abcdef", np.uint8)[_digits(part)].tobytes().decode()
            out += [hexed[i : i + PLACES] for i in range(0, len(hexed), PLACES)]
            part, chars = [], 0
        if text is not None:
            part.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
            chars += len(text)
    return out


def likeness(a: str, b: str) -> float:
    """From the share of equal digits beyond the 1 in 16 of chance what the texts share of their mean length, from 0 to 1."""
    same = int((np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)).sum()) / PLACES
    shared = max(0.0, (same - 1 / 16) / (1 - 1 / 16))
    return 2 * shared / (1 + shared) if a != b else 1.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(fingerprints([t or "" for t in batch.column("text").to_pylist()]), pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: textkit.released(run(it)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def packed(prints: Column) -> Column:
    return F.unhex(prints)


def unpacked(prints: list[bytes]) -> np.ndarray:
    """[fingerprint, place] of packed fingerprints: the digits."""
    pairs = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    return np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(prints), -1)


def digits_for(least: float) -> int:
    """How many equal digits make two fingerprints alike by ``least``."""
    shared = least / (2 - least)
    return math.ceil(PLACES * (1 / 16 + 15 / 16 * shared) - 1e-9)


def bands_for(n: int, least: float, miss: float) -> tuple[int, int]:
    """(digits of a sample, number of samples) for so many fingerprints.

    Unrelated ones share a sample of so many digits one time in 16 on average, whatever their number; a pair
    that is alike by ``least`` shares none with probability ``miss``.
    """
    width = 1 + math.ceil(math.log(max(2, n), 16))
    return width, math.ceil(math.log(miss) / math.log(1 - (digits_for(least) / PLACES) ** width))


def _band_keys(batches: Iterator[pa.RecordBatch], samples: np.ndarray, kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        digits = unpacked(batch.column("signature").to_pylist())
        for i, sample in enumerate(samples):
            key = np.full(len(digits), i + 1, U)
            for place in sample:
                key = textkit.mix(key * U(257) + digits[:, place])
            yield pa.record_batch([pa.array(key.astype(np.int64)), *(batch.column(c) for c in kept)], ["key", *kept])


def near_classes(prints: DataFrame, least: float = 0.9, miss: float = 0.02) -> DataFrame:
    """(doc_id, class_id) of the rows of ``prints`` (doc_id, fingerprint) that are in one class with others; class_id is the smallest id that can be reached.

    Equal fingerprints are one class. Different ones are linked if they are alike by ``least``; a pair of just that likeness shares no
    sample with probability ``miss``. Every link is verified on whole fingerprints: first each fingerprint of a sample's
    value against a random one of them, then, where several classes remain, all against all, in blocks if there are many. Rows without an id are left out.
    """
    spark = prints.sparkSession
    work = Workspace(spark, "fingerprint-classes")
    digest = F.unhex(F.md5(F.col("fingerprint").cast("binary")))
    marks = work.table(prints.filter("doc_id is not null and fingerprint is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), packed(F.col("fingerprint")).alias("signature")), "marks")
    reps = work.table(marks.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("x"), F.count("*").alias("n")).select("digest", F.col("x.doc_id").alias("rep"), "x.signature", "n"), "reps")
    width, bands = bands_for(reps.count(), least, miss)
    rng, enough = np.random.default_rng(17), digits_for(least)
    samples = np.stack([rng.choice(PLACES, min(width, PLACES), replace=False) for _ in range(bands)])

    reached = reps.select("rep", "signature").mapInArrow(lambda it: _band_keys(it, samples, ("rep",)), "key long, rep long")
    stars = near_dup.star_pairs(reps, reached, enough, work, unpacked).select("a", "b")
    known = work.table(near_dup.with_component(reps.select("rep", "signature", F.lit(1).cast("long").alias("w")), near_dup.connected(spark, stars, work, "one")), "known")
    kind = "key long, rep long, w long, component long"
    rows = near_dup.opened(known.mapInArrow(lambda it: _band_keys(it, samples, ("rep", "w", "component")), kind), work, "open")
    cells = near_dup.in_cells(rows, known.select("rep", F.col("signature").alias("s")), work)
    rest = work.table(cells.mapInArrow(lambda it: textkit.released(near_dup.compared(it, enough, 0, unpacked, True)), "a long, b long").distinct(), "rest")
    classes = near_dup.connected(spark, stars.union(rest), work, "two")
    shared = reps.select("digest", "rep", "n").join(classes.withColumnRenamed("id", "rep"), "rep", "left").filter("component is not null or n > 1").select("digest", F.coalesce("component", "rep").alias("class_id"))
    out = work.table(marks.select("doc_id", "digest").join(shared, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "classes")
    work.drop("marks", "reps", "stars", "known", "open", "open-keys", "nodes", "rest")
    return out


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order within a range, each range ended by a borrowed row, to results of all rows but the borrowed.

    A row with a class stands before the documents of its id.
    """
    held: tuple | None = None  # the last row seen, whose next one isn't known yet
    classed = (None, None)
    todo: list[tuple] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        mine, edited = fingerprints([t for _, t, *_ in todo]), fingerprints([_edited(t, n) for _, t, n, _ in todo])
        follow = fingerprints([n if i + 1 == len(todo) or todo[i + 1][1] is not n else "" for i, (_, _, n, _) in enumerate(todo)])
        rows = []
        for i, (doc_id, text, nxt, class_id) in enumerate(todo):
            after = mine[i + 1] if i + 1 < len(todo) and todo[i + 1][1] is nxt else follow[i]
            digest = hashlib.sha256(_edited(text, nxt).encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(text), digest, mine[i], edited[i], likeness(mine[i], edited[i]), likeness(mine[i], after), doc_id if class_id is None else class_id))
        todo.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])

    for batch in batches:
        for area, borrowed, doc_id, class_id, text in zip(*(batch.column(c).to_pylist() for c in ("area", "borrowed", "doc_id", "class_id", "text")), strict=True):
            if class_id is not None:
                classed = (doc_id, class_id)
                continue
            text = text or ""
            if held is not None and held[0] == area:
                todo.append((held[1], held[2], text, held[3]))
                chars += len(held[2])
                if chars > SLICE_CHARS:
                    yield flush()
                    chars = 0
            held = None if borrowed else (area, doc_id, text, classed[1] if classed[0] == doc_id else None)
    if todo:
        yield flush()


def _area(cuts: list[int], value: str) -> Column:
    """The number of cuts below the value, with a minus: found in two steps, each over about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    numbers = lambda x: "array(" + ",".join(f"{c}L" if c > NO_ID else f"bigint('{c}')" for c in x) + ")"
    groups = ",".join(numbers(cuts[i : i + step]) for i in range(0, len(cuts), step))
    before = f"size(filter({numbers(cuts[step - 1 :: step])}, c -> c < {value}))"
    return F.expr(f"cast(-({before} * {step} + coalesce(size(filter(get(array({groups}), {before}), c -> c < {value})), 0)) as int)")


def compare_with_edits(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """Fingerprints of each document, of its text with the last half replaced by the start of the next document's (descending id; after the last the first),
    their likeness, and the class of documents alike by ``least`` that it belongs to (its smallest id; its own id if it is alone).

    Ids are ranged by approximate quantiles, and each range borrows the first row of the next one, so no order over all rows is ever made in one task.
    Rows of one id stay in one range, in the order of their texts, and share the smallest class that any of them reaches; an id of null comes last and has no class.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    classes = near_classes(fingerprint_documents(docs), least)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    # ranges of AREA_BYTES on average, but MOST_AREAS at most: a range is a stream, which memory needn't hold
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_AREAS, max(parts, size // AREA_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []
    area = _area(sorted({int(c) for c in cuts}), "doc_id")
    # descending: a higher id has the lower area
    areas = docs.select("doc_id", area.alias("area")).groupBy("area").agg(F.max("doc_id").alias("head")).orderBy("area").collect()  # fewer than ``n`` rows
    heads = [(r["head"], areas[i - 1]["area"]) for i, r in enumerate(areas)]  # the highest id goes to the last
    firsts = spark.createDataFrame(heads or [(0, 0)], "head long, to_area int")
    none = F.lit(None).cast("long").alias("class_id")
    own = docs.select(area.alias("area"), F.lit(False).alias("borrowed"), "doc_id", none, "text")
    of_class = classes.select("doc_id", area.alias("area"), "class_id").select("area", F.lit(False), "doc_id", "class_id", F.lit(None).cast("string"))
    # of the rows with the head's id the one that sorts first is lent
    lent = docs.join(F.broadcast(firsts), F.col("doc_id") == F.col("head")).groupBy("to_area", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = own.union(of_class).union(lent.select("to_area", F.lit(True), "doc_id", none, "text"))
    rows = (rows.repartition("area") if n == parts else rows.repartition(n, "area")).sortWithinPartitions("area", "borrowed", F.desc("doc_id"), F.col("class_id").isNull(), F.coalesce("text", F.lit("")))
    out = rows.mapInArrow(lambda it: textkit.released(_compare(it)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")
    given = F.col("doc_id") > F.lit(NO_ID)
    return out.withColumns({"doc_id": F.when(given, F.col("doc_id")).cast(id_type), "class_id": F.when(given, F.col("class_id")).cast(id_type)})
