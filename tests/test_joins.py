import random

from pyspark.sql import functions as F

from lattica.functions.arrays import sums_before
from lattica.operators import joins


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 700):
        a = list(range(n))
        assert spark.createDataFrame([(a,)], "a array<int>").select(sums_before(F.col("a"))).first()[0] == [sum(a[:k]) for k in range(n)]


def test_as_of_and_within_like_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.randint(0, 3), rng.randint(0, 50), i, f"l{i}") for i in range(80)]
    right = [(rng.randint(0, 3), rng.randint(0, 50), 1000 + i, f"r{i}") for i in range(60)]
    l, r = (spark.createDataFrame(x, f"k int, at int, tie int, {name} string") for x, name in ((left, "a"), (right, "b")))
    got = {row["tie"]: row["b"] for row in joins.as_of(l, r, ["k"], "at", "tie", ["b"]).collect()}
    for k, at, tie, _ in left:
        before = [x for x in right if x[0] == k and (x[1], x[2]) <= (at, tie)]
        assert got[tie] == (max(before, key=lambda x: (x[1], x[2]))[3] if before else None)
    spans = [(rng.randint(0, 3), lo := rng.randint(-5, 50), lo + rng.randint(-2, 30), i) for i in range(50)]
    s = spark.createDataFrame(spans, "k int, lo int, hi int, id int")
    pairs = sorted((row["tie"], row["id"]) for row in joins.within(l, s, ["k"], "at", "lo", "hi", 7.0).collect())
    assert pairs == sorted((x[2], y[3]) for x in left for y in spans if x[0] == y[0] and y[1] <= x[1] < y[2])
