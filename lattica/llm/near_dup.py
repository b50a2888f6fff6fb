"""Near-duplicate classes by a chosen-path similarity join.

A document is a set of word shingles, and its signature holds COORDINATES minwise
tokens of the set. A tree branches from its root: a node chooses one coordinate, or
two in one case of four, and a document goes on to the child that its token there
names, so that a pair of 0.8 shares one child of a shared node on average and the
search never dies out fast. After ``depth`` levels every node is compared
exhaustively, as far as its documents aren't known to be one component; nodes of more
than LARGE documents branch again beforehand. Trees are repeated until a pair of
exactly the wanted similarity is missed with probability ``miss``.

The nodes of the first trees are closed first: each document meets one random member
of its node, which links most groups of copies. Then only nodes that still hold
several components are read at all, and of their documents only those that have a
likely partner in another component. A node is cut into blocks at random, each pair
of blocks is compared in one task, and only links leave it.

Equal sets are one class from the start. Every link is confirmed on full sets.
The depth follows the number of distinct sets, so that unrelated documents
rarely meet, and the number of trees follows the depth.

Defined results: null, empty or wordless text has an empty set, is linked with
nothing and is kept. A null id never names a class. Rows with one id are one
document: all of them stay or go, and any of their texts stands for them. Texts of
any length are read whole; an empty table gives no rows. Other columns of the input
are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .workspace import Workspace

U = np.uint64
#: Coordinates of a signature.
COORDINATES = 128
#: One node in TWICE chooses two coordinates: 1.25 children on average, the inverse of the usual similarity.
TWICE = 4
#: Trees whose nodes are closed by comparing each document with one member; at most STAR documents with the same one.
FIRST_TREES, STAR = 3, 256
#: Documents and shingles (16 MB) of a block, on average.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 21
#: Nodes of more documents branch DEEPER levels further, in as many trees of their own as the same probability of a miss needs.
LARGE, DEEPER = 1 << 15, 6
#: Standard deviations below the wanted similarity at which the estimate drops a pair (1 in 10**6).
MARGIN = 4.8
#: Up to so many ids (16 MB) of documents in a pair are broadcast to the scan of texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 63, dtype=U, size=n) * U(2) + U(1)


def signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    factor = _odd(1, COORDINATES)[:, None]
    for batch in batches:
        sizes, digests, packed = [], [], []
        for s in textkit.shingle_sets(batch.column("text"), width):
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                packed.append(None)
                continue
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            low = np.full(COORDINATES, ~U(0))
            for at in range(0, len(s), 4096):
                low = np.minimum(low, (s[None, at : at + 4096] * factor).min(axis=1))
            packed.append((textkit.mix(low) >> U(48)).astype("<u2").tobytes())
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])


def branch(keys: np.ndarray, sig: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the nodes that documents with signatures ``sig`` at the nodes ``keys`` reach so many levels further down."""
    row = np.arange(len(keys))
    for _ in range(levels):
        pick = textkit.mix(keys ^ U(0x94D049BB133111EB))
        place = (pick % U(COORDINATES)).astype(np.int64)
        more = np.flatnonzero((pick >> U(32)) % U(TWICE) == 0)
        second = (place[more] + 1 + ((pick[more] >> U(40)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        row, place, keys = np.concatenate([row, row[more]]), np.concatenate([place, second]), np.concatenate([keys, keys[more]])
        keys = textkit.mix(textkit.mix(keys + (place + 1).astype(U) * U(0x9E3779B97F4A7C15)) ^ (sig[row, place].astype(U) + U(1)) * U(0xD1342543DE82EF95))
    return row, keys


def unpacked(packed: list[bytes]) -> np.ndarray:
    """[document, coordinate] of stored signatures."""
    return np.frombuffer(b"".join(packed), "<u2").reshape(len(packed), -1)


def _nodes(batches: Iterator[pa.RecordBatch], depth: int, trees: range, kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (signature and others; ``key`` if the trees stand in a node) to rows (key and ``kept``) for each node that the document reaches."""
    roots = textkit.mix(np.arange(1, trees.stop + 1, dtype=U))
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = unpacked(batch.column("signature").to_pylist())
        start = batch.column("key").to_numpy().astype(U) if "key" in batch.schema.names else np.zeros(len(sig), U)
        for tree in trees:
            row, keys = branch(textkit.mix(start ^ roots[tree]), sig, depth)
            yield pa.record_batch([pa.array(keys.astype(np.int64)), *(batch.column(c).take(pa.array(row)) for c in kept)], ["key", *kept])


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, i, j), as one table for each of these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(cell[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(cell[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def compare_cell(rep: np.ndarray, block: np.ndarray, label: np.ndarray, sig: np.ndarray, least: int, percent: int, sets: list[np.ndarray] | None, sure: bool = False) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All pairs of two blocks' documents, or of one block's own, that have different labels.

    Without ``sets``: which documents have a partner whose signature agrees in ``least`` places. With them, or if signatures
    are ``sure``: pairs that are as alike as wanted, less those whose ends other pairs link already.
    """
    whole = bool(block.min() == block.max())
    if whole:
        # the largest component comes last: its documents needn't be compared with each other
        names, owner = np.unique(label, return_inverse=True)
        last = owner == np.bincount(owner, minlength=len(names)).argmax()
        order, first = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)]), int((~last).sum())
    else:
        lower = block == block.min()
        if 2 * lower.sum() > len(rep):
            lower = ~lower
        order, first = np.concatenate([np.flatnonzero(lower), np.flatnonzero(~lower)]), int(lower.sum())
    label = label[order].copy()
    sig = sig[order]
    near, links = np.zeros(len(rep), bool), []
    if sets is not None:
        size = np.array([len(sets[o]) for o in order])
        ends = np.cumsum(size)
        token = np.unique(np.concatenate([sets[o] for o in order]), return_inverse=True)[1]
        mine = np.zeros(int(token.max()) + 1, np.int32)

    def _alike(i: int, at: np.ndarray) -> np.ndarray:
        own = token[ends[i] - size[i] : ends[i]]
        mine[own] = 1
        if 4 * len(at) < len(rep):
            both = np.array([mine[token[ends[k] - size[k] : ends[k]]].sum() for k in at], np.int64)
        else:
            both = np.add.reduceat(mine[token], ends - size)[at].astype(np.int64)
        mine[own] = 0
        return 100 * both >= percent * (size[i] + size[at] - both)

    for i in range(first):
        low = i + 1 if whole else first
        at = low + np.flatnonzero(label[low:] != label[i])
        at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
        if not len(at):
            continue
        if sets is None and not sure:
            near[i] = True
            near[at] = True
            continue
        if sets is not None:
            at = at[_alike(i, at)]
        if len(at):
            joined, one = np.unique(label[at], return_index=True)
            links += [(min(x, y), max(x, y)) for x, y in ((int(rep[order[i]]), int(rep[order[k]])) for k in at[one])]
            label[np.isin(label, joined)] = label[i]
    back = np.zeros(len(rep), bool)
    back[order] = near
    return back, links


def compared(batches: Iterator[pa.RecordBatch], least: int, percent: int, read: Callable[[list[bytes]], np.ndarray] = unpacked, sure: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, rep, component, s[, set]) sorted by cell: those that have a likely partner, or with sets or sure signatures links."""
    for cell in cells(batches):
        rep, block, label = (cell.column(c).to_numpy() for c in ("rep", "block", "component"))
        sig, sets = read(cell.column("s").to_pylist()), None
        if "set" in cell.column_names:
            sets = [x for part in cell.column("set").chunks for x in np.split(part.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(part.offsets.to_numpy()))[:-1])]
        near, links = compare_cell(rep, block, label, sig, least, percent, sets, sure)
        if links:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
        elif near.any():
            yield from cell.select(["key", "i", "j", "block", "rep", "component"]).filter(pa.array(near)).combine_chunks().to_batches()


def _estimated(batches: Iterator[pa.RecordBatch], least: int, read: Callable[[list[bytes]], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in ``least`` coordinates, with that number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (read(batch.column(c).to_pylist()) for c in ("sa", "sb"))
        same = (a == b).sum(axis=1)
        keep = same >= least
        yield pa.record_batch([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(same[keep].astype(np.int32))], ["a", "b", "same"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(textkit.shingle_sets(batch.column("text"), width))
        ends = np.cumsum([0, *map(len, got)])
        flat = np.concatenate([*got, np.zeros(0, U)]).astype(np.int64)
        yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "set"])


def missed(depth: int, trees: int, similarity: float) -> float:
    """Probability that a pair of so similar sets meets in no tree. All trees choose from the same COORDINATES, so they aren't independent."""
    total = 0.0
    for same in range(COORDINATES + 1):
        p, meet = same / COORDINATES, 1.0
        for _ in range(depth):
            lost = 1 - p * meet
            meet = 1 - lost * (1 - (1 - lost) / TWICE)
        total += math.comb(COORDINATES, same) * similarity**same * (1 - similarity) ** (COORDINATES - same) * (1 - meet) ** trees
    return total


def trees_for(depth: int, similarity: float, miss: float) -> int:
    trees = 1
    while missed(depth, trees, similarity) > miss:
        trees += 1
    return trees


def plan(n_sets: int, similarity: float, miss: float) -> tuple[int, int]:
    """(depth, trees) for so many distinct sets. Unrelated sets agree in a minwise token about 3 times in 100."""
    depth = max(1, math.ceil(math.log(max(2, n_sets)) / math.log(1 / 0.03)))
    return depth, trees_for(depth, similarity, miss)


def connected(spark: SparkSession, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, component) of each id in ``links`` (a, b): the smallest id that can be reached.

    Labels fall to the smallest of the neighbours' and then to the label's own label, until nothing changes.
    """
    both = work.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-both")
    labels = work.table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")), f"{name}-labels-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(seen, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = work.table(moved.join(jump, "label", "left").select("id", "was", F.coalesce("next", "label").alias("label")), f"{name}-labels-{turn}")
        still = labels.filter("label <> was").limit(1).count()
        labels = labels.select("id", "label")
        work.drop(f"{name}-labels-{turn - 1}")
        if not still:
            work.drop(f"{name}-both")
            return labels.select("id", F.col("label").alias("component"))


class _Sets:
    """Shingle sets (id, set) of the documents that were asked for; each text is read once."""

    def __init__(self, docs: DataFrame, width: int, work: Workspace):
        self.docs, self.width, self.work, self.parts = docs, width, work, []

    def of(self, wanted: DataFrame) -> DataFrame:
        """Sets of at least the ids in ``wanted`` (id, distinct)."""
        name = f"sets-{len(self.parts)}"
        for part in self.parts:
            wanted = wanted.join(part.select("id"), "id", "left_anti")
        wanted = self.work.table(wanted, f"{name}-ids").withColumnRenamed("id", "doc_id")
        few = wanted.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
        width = self.width
        # rows of one id are one document, which the set of any of them stands for
        sets = texts.mapInArrow(lambda it: textkit.released(_sets(it, width)), "id long, set array<long>")
        self.parts.append(self.work.table(sets, name))
        self.work.drop(f"{name}-ids")
        return functools.reduce(DataFrame.union, self.parts)

    def drop(self) -> None:
        self.work.drop(*(f"sets-{i}" for i in range(len(self.parts))))


def _confirmed(pairs: DataFrame, sets: _Sets, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs whose full sets are as alike as wanted."""
    all_sets = sets.of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    x = pairs.select("a", "b").join(all_sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(all_sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = x.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return work.table(both.filter(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b").distinct(), name)


def with_component(df: DataFrame, classes: DataFrame, column: str = "rep", name: str = "component") -> DataFrame:
    known = classes.select(F.col("id").alias(column), F.col("component").alias("_known"))
    return df.join(known, column, "left").withColumn(name, F.coalesce("_known", column)).drop("_known")


def star_pairs(reps: DataFrame, reached: DataFrame, least: int, work: Workspace, read: Callable[[list[bytes]], np.ndarray] = unpacked) -> DataFrame:
    """Pairs (a, b, same) of documents with a random member of their node that agree in ``least`` places; at most STAR or so meet the same member.

    ``reps``: rep, signature; ``reached``: key, rep.
    """
    reached = work.table(reached, "star-nodes")
    sizes = reached.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # one order of documents: nodes that share documents tend to share the one that all are compared with
    order = F.struct(F.xxhash64("rep", F.lit(0)), F.col("rep"))
    part = Window.partitionBy("key", F.expr(f"pmod(xxhash64(rep, key), cast(ceil(n / {STAR}) as int))"))
    stars = reached.join(sizes, "key").select("rep", F.min(order).over(part)["rep"].alias("pivot")).filter("rep <> pivot")
    pairs = stars.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()

    def signature(name: str, column: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("signature").alias(column))

    stars = work.table(pairs.join(signature("a", "sa"), "a").join(signature("b", "sb"), "b").mapInArrow(lambda it: _estimated(it, least, read), "a long, b long, same int"), "stars")
    work.drop("star-nodes")
    return stars


def _star_links(reps: DataFrame, depth: int, trees: range, least: int, percent: int, sets: _Sets, work: Workspace) -> DataFrame:
    """Links (a, b) of documents with a random member of their node."""
    stars = star_pairs(reps, reps.select("rep", "signature").mapInArrow(lambda it: _nodes(it, depth, trees, ("rep",)), "key long, rep long"), least, work)
    # of each document's pairs the likeliest first, then the likeliest between two components
    ends = stars.union(stars.select(F.col("b"), F.col("a"), "same"))
    best = ends.groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("b"))).alias("m")).select(F.least("a", -F.col("m.b")).alias("a"), F.greatest("a", -F.col("m.b")).alias("b")).distinct()
    first = _confirmed(work.table(best, "best"), sets, percent, work, "star-links")
    classes = connected(work.spark, first, work, "star")
    apart = with_component(with_component(stars, classes, "a", "ca"), classes, "b", "cb").filter("ca <> cb")
    across = apart.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max(F.struct("same", "a", "b")).alias("m")).select("m.a", "m.b")
    second = _confirmed(work.table(across, "across"), sets, percent, work, "across-links")
    work.drop("stars", "best", "across")
    return first.union(second)


def opened(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The rows (key, rep, ...) of the nodes that hold several components, with the node's number of rows."""
    nodes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "n")
    return work.table(rows.join(work.table(nodes, f"{name}-keys"), "key"), name)


def _node_links(reps: DataFrame, depth: int, trees: int, deeper: int, least: int, percent: int, sets: _Sets, work: Workspace) -> DataFrame:
    """Links (a, b) between the components of each node. ``reps``: rep, signature, w (shingles), component."""
    kept = ("rep", "w", "component")
    kind = "key long, rep long, w long, component long"
    rows = opened(reps.mapInArrow(lambda it: _nodes(it, depth, range(trees), kept), kind), work, "open")
    if not rows.filter(F.col("n") > LARGE).isEmpty():
        again = rows.filter(F.col("n") > LARGE).join(reps.select("rep", "signature"), "rep")
        inner = opened(again.mapInArrow(lambda it: _nodes(it, DEEPER, range(trees, trees + deeper), kept), kind), work, "open-deeper")
        rows = rows.filter(F.col("n") <= LARGE).union(inner)
    signed = reps.select("rep", F.col("signature").alias("s"))
    likely = work.table(in_cells(rows, signed, work).mapInArrow(lambda it: textkit.released(compared(it, least, percent)), "key long, i int, j int, block int, rep long, component long"), "likely")
    ids = work.table(likely.select(F.col("rep").alias("id")).distinct(), "likely-ids")
    one = sets.of(ids).join(ids, "id", "left_semi").join(signed, F.col("id") == F.col("rep")).select("rep", "s", "set")
    links = work.table(_dealt(likely.join(one, "rep")).mapInArrow(lambda it: textkit.released(compared(it, least, percent)), "a long, b long").distinct(), "node-links")
    work.drop("open", "open-keys", "open-deeper", "open-deeper-keys", "nodes", "likely", "likely-ids")
    return links


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def in_cells(rows: DataFrame, signed: DataFrame, work: Workspace) -> DataFrame:
    """``rows`` (key, rep, w, component) of nodes with several components as sorted cells (key, i, j, block, rep, component, s): pairs of blocks to compare.

    The largest component of a node needs no comparison with itself: only the others' blocks meet all blocks.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    nodes = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    # a node that fits one block is a cell of its own, with no blocks but 0
    fits = f"n <= {BLOCK_DOCS} and w <= {BLOCK_SHINGLES}"
    blocks = f"cast(greatest(ceil({{n}} / {BLOCK_DOCS}), ceil({{w}} / {BLOCK_SHINGLES}), 1) as int)"
    other, own = blocks.format(n="(n - main.n)", w="(w - main.w)"), blocks.format(n="main.n", w="main.w")
    nodes = work.table(nodes.select("key", F.col("main.component").alias("most"), F.expr(f"if({fits}, 1, {other})").alias("other"), F.expr(f"if({fits}, 0, {own})").alias("own")), "nodes")
    mine = rows.join(nodes, "key").withColumn("block", F.expr("cast(if(component = most and own > 0, other + pmod(xxhash64(rep, key), greatest(own, 1)), pmod(xxhash64(rep, key), other)) as int)"))
    met = F.expr("transform(sequence(0, if(component = most and own > 0, other, other + own) - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    placed = mine.join(signed, "rep").select("key", "rep", "component", "block", "s", F.explode(met).alias("c"))
    return _dealt(placed.select("key", "c.i", "c.j", "block", "rep", "component", "s"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    percent = round(similarity * 100)
    work = Workspace(spark, "near-dup")
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = work.table(docs.mapInArrow(lambda it: textkit.released(signatures(it, width)), "doc_id long, n_shingles long, digest binary, signature binary"), "marks")
    reps = work.table(marks.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "signature", "n_shingles")).alias("x")).select("digest", F.col("x.doc_id").alias("rep"), "x.signature", "x.n_shingles"), "reps")
    depth, trees = plan(reps.count(), similarity, miss)
    least = math.floor(COORDINATES * similarity - MARGIN * math.sqrt(COORDINATES * similarity * (1 - similarity)))
    sets = _Sets(docs, width, work)

    stars = _star_links(reps, depth, range(min(trees, FIRST_TREES)), least, percent, sets, work)
    first = connected(spark, stars, work, "one")
    known = work.table(with_component(reps.select("rep", "signature", F.col("n_shingles").alias("w")), first), "known")
    links = stars.union(_node_links(known, depth, trees, trees_for(DEEPER, similarity, miss), least, percent, sets, work))
    classes = connected(spark, links, work, "two")
    sets.drop()
    work.drop("known", "star-links", "across-links", "node-links")

    of_set = with_component(reps.select("digest", "rep"), classes).select("digest", "component")
    out = marks.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    return out.select(F.col("doc_id").cast(id_type), "n_shingles", F.coalesce("component", "doc_id").cast(id_type).alias("component_id"), F.expr("doc_id <=> coalesce(component, doc_id)").alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document stays: the one with the smallest id of each class. Rows without an id stay."""
    work = Workspace(docs.sparkSession, "dropped")
    gone = work.table(near_duplicates(docs, **options).filter("not kept and doc_id is not null").select("doc_id").distinct(), "ids")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
