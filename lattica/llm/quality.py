"""Text quality by supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams of a text are hashed
into BUCKETS rows of an embedding table; a document is the mean of its rows, a
softmax layer gives the probability of label 1. Table and layer are trained
together by stochastic gradient descent in numpy, on at most ``sample`` labelled
rows (those with the smallest hash of their id), on whole texts, in one task. As the layer
is linear in the mean, each bucket's contribution to the score is one number,
and scoring is a look-up and a mean for each text.

Character n-grams run over the text's bytes, lower-cased or not according to
the kind, so letters, signs and casing all count.

Defined results: null or empty text scores as the layer does on a zero vector; repeated
rows are scored alike; of repeated labels the largest counts; a score of just one half is label 1; a null id
is in no fold but scored; without labels of both kinds every score is the share of label 1 (one half without labels);
texts of any length are read whole; an empty table gives no rows; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

U = np.uint64
BUCKETS = 1 << 17
DIMENSIONS, EPOCHS, RATE = 8, 4, 0.3
#: Labelled rows to learn from at most; at 3 KB of text each some 20 MB meet in the task that trains.
SAMPLE = 6_000
GRAMS = (3, 4)
#: The row that all pairs of a word with itself share: repetition counts as such, whatever word is repeated.
REPEAT = 0


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of each text, all its n-grams and words."""
    _, _, _, word, first = textkit.words(data, offsets, textkit.NOT_SPACE)
    pair = textkit.windows(word, 2)
    one, two = (word % U(BUCKETS)).astype(np.int32), (pair % U(BUCKETS)).astype(np.int32)
    two[word[1:] == word[:-1]] = REPEAT
    grams = []
    for n in GRAMS:
        if len(data) < n:
            grams.append(np.zeros(0, np.int32))
            continue
        key = np.zeros(len(data) - n + 1, np.uint32)
        for k in range(n):
            key = (key ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
            key ^= key >> np.uint32(15)
        grams.append(((key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 17)).astype(np.int32))
    out = []
    for i in range(len(offsets) - 1):
        a, b, lo, hi = first[i], first[i + 1], offsets[i], offsets[i + 1]
        out.append(np.concatenate([one[a:b], two[a : max(a, b - 1)], *(g[lo : max(lo, hi - n + 1)] for n, g in zip(GRAMS, grams, strict=True))]))
    return out


@dataclass
class Model:
    """``weight``: what each bucket adds to the log-odds of label 1; ``bias``: log-odds of a zero vector."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, _, data, offsets in textkit.slices(texts):
            for i, f in enumerate(features(data, offsets)):
                out[lo + i] = self.weight[f].mean(dtype=np.float64) if len(f) else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def train(texts: pa.Array, labels: list[int], seed: int = 5) -> Model:
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    ids_of, count_of = [], []
    for _, _, data, offsets in textkit.slices(texts):
        for f in features(data, offsets):
            ids, n = np.unique(f, return_counts=True)
            ids_of.append(ids)
            count_of.append(n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.int64))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    # the rarer label weighs as much as the other in all
    balance = np.array([0.5 / (1 - share), 0.5 / share])
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps) * min(4.0, balance[y[i]])
            done += 1
            ids, part = ids_of[i], count_of[i].astype(np.float32)
            if not len(ids):
                continue
            part /= part.sum()
            mean = part @ table[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # a mean spreads its step over the rows; scaled up so that their sum moves as one row would
            table[ids] -= (rate * np.minimum(part * len(ids), 8.0))[:, None] * back
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id: int | None) -> bool:
    """The fold that labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """A model of labels (doc_id, quality) on docs (doc_id, text), from at most ``sample`` rows outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold != 1))
    few = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("text", pa.string())])).sort_by("doc_id")
        model = train(found.column("text"), found.column("y").to_pylist())
        yield pa.record_batch([pa.array([model.weight.astype("<f4").tobytes()]), pa.array([model.bias])], ["weight", "bias"])

    # the bounded sample meets in one task, and only the model passes the driver
    made = rows.select(F.col("doc_id").cast("long"), "y", "text").repartition(1).mapInArrow(lambda it: textkit.released(run(it)), "weight binary, bias double").first()
    return train(pa.array([], pa.string()), []) if made is None else Model(np.frombuffer(made["weight"], "<f4"), made["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array([held_out(i) for i in batch.column("doc_id").to_pylist()]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: textkit.released(run(it)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; a filter over each batch, nothing is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) >= least))

    return docs.mapInArrow(lambda it: textkit.released(run(it)), docs.schema)
