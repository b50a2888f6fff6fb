"""The pipeline's stages against brute-force versions, on a small folder of tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import pii, quality
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    passage = " ".join(f"bench{k}" for k in range(30))
    texts = [prose(rng, rng.randint(8, 120)) for _ in range(160)]
    texts += [texts[0], texts[1] + " tail", f"{texts[2]} {passage}", f"{prose(rng, 900)} {passage}", "card 4111 1111 1111 1111 of joe@x.org"] + [" ".join(w + "%%%" for w in prose(rng, 30).split()) for _ in range(40)]
    path = f"file://{tmp_path_factory.mktemp('pipe')}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("%%%" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= 0.5}
    want = [{i: t for i, t in rows.items() if i in good}]
    parts = brute.components(list(want[-1].items()), 5)
    want.append({i: t for i, t in want[-1].items() if parts[i][1] == i})
    clean = {i: brute.contamination(t, {0: " ".join(f"bench{k}" for k in range(30))}) for i, t in want[-1].items()}
    want.append({i: t for i, t in want[-1].items() if not (clean[i][1] and 20 * clean[i][1] >= clean[i][0])})
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(want[-1].items()), "doc_id long, text string")).collect()}
    want.append(hidden)
    assert len(want[0]) < len(rows) and len(want[1]) < len(want[0]) and len(want[2]) < len(want[1]) and hidden != want[2]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, folder).cache()
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    library, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for t in hidden.values():
        total += len(library.encode(t, add_special_tokens=False).ids) + 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in pieces) == total and {r["doc_id"] for r in pieces} == set(hidden)
    assert brute.packed_well([(r["length"], r["sequence_id"], r["offset"]) for r in pieces], 1024)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_keep_clean_rows_of_repeated_and_null_ids(spark, folder):
    """Only the row that a stage rejects goes, whatever shares its id; near copies go by their document."""
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = [(900, f"an odd and clean text of its own {k}", "en", "s", 30) for k in range(2)] + [(900, passage, "en", "s", 9), (None, "another clean text", "en", "s", 9), (None, passage, "en", "s", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["benchmark decontamination"](spark, docs, folder).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in docs.collect() if r["text"] != passage)
    near = stages["near duplicates"](spark, docs, folder).collect()
    assert sum(r["doc_id"] is None for r in near) == 3
    hidden = stages["personal data"](spark, docs, folder)
    assert hidden.count() == len(rows) and hidden.columns == docs.columns
    assert stages["quality classifier"](spark, docs, folder).columns == docs.columns
    assert stages["packing"](spark, docs, folder).count() == len(rows)
