from datetime import datetime

from pyspark.sql import functions as F

from lattica.streaming import calls, events

# fixed values: the orders of calls that a batch may have
BATCHES = [
    ("independent", [(0, -1), (1, -1)], True), ("dependent", [(0, -1), (1, 0)], True), ("any ids", [(9, -1), (2, 9)], True), ("negative", [(-1, -1)], False), ("repeated", [(0, -1), (0, -1)], False),
    ("forward", [(0, 1), (1, -1)], False), ("missing", [(0, 8)], False), ("self", [(0, 0)], False), ("sentinel", [(0, -2)], False),
]


def test_batch_orders(spark):
    rows = [(name, pos, i, f) for name, cs, _ in BATCHES for pos, (i, f) in enumerate(cs)]
    bad = {r["batch_id"] for r in calls.batch_problems(spark.createDataFrame(rows, "batch_id string, pos int, call_id int, input_from int")).collect()}
    assert bad == {name for name, _, ok in BATCHES if not ok}


def test_batches_run(spark):
    rows = [("b", 0, 1, "up", "a", -1), ("b", 1, 2, "up", None, -1), ("b", 2, 3, "twice", None, 1), ("b", 3, 4, "up", None, 2), ("b", 4, 5, "none", "x", -1), ("c", 0, 1, "up", "z", 1)]
    df = spark.createDataFrame(rows, "batch_id string, pos int, call_id int, method string, payload string, input_from int")
    out = {(r["batch_id"], r["call_id"]): (r["result"], r["code"], r["message"]) for r in calls.run_batches(df, {"up": F.upper, "twice": lambda p: F.concat(p, p)}).collect()}
    assert out == {("b", 1): ("A", 0, None), ("b", 2): (None, 3, "no result"), ("b", 3): ("AA", 0, None), ("b", 4): (None, 3, "dependency 2 failed"), ("b", 5): (None, 12, "no such method"), ("c", 1): (None, 3, "input is not from an earlier call")}


def test_interceptors_wrap_in_order(spark):
    tag = lambda t: lambda m: lambda p: F.concat(F.lit(t), m(p))
    assert spark.range(1).select(calls.intercepted(lambda p: F.lit("x"), tag("a"), tag("b"))(F.lit(0))).first()[0] == "abx"


def test_discovery(spark):
    assert calls.discovery(spark, {"GreeterService": {"SayHello": "unary"}}).first()["method_id"] == 0x4D62BEB5


def test_stream_resumes_and_drops_repeats(spark, tmp_path):
    schema = "owner string, idem_key string, id long, at timestamp"
    one = spark.createDataFrame([("o", "k", 1, datetime(2024, 1, 1)), ("o", "k", 2, datetime(2024, 1, 1, 0, 1))], schema)
    one.write.parquet(str(tmp_path / "in"))
    stream = lambda: calls.dispatched_stream(events.event_stream(spark, str(tmp_path / "in"), one.schema))
    events.drained(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    spark.createDataFrame([("o", "k", 3, datetime(2024, 1, 1, 0, 2)), ("p", "k", 4, datetime(2024, 1, 1, 0, 2))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    events.drained(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and {r["owner"] for r in got.collect()} == {"o", "p"}


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5), "a", 1.0, 1), (datetime(2024, 1, 1, 0, 50), "a", 2.0, 1), (datetime(2024, 1, 1, 3), "a", 4.0, 2), (datetime(2024, 1, 1, 9), "b", 8.0, 2)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double, user_id long")
    df.write.parquet(str(tmp_path / "in"))
    events.drained(events.windowed(events.event_stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 4.0), (2, 3.0)]  # the last window is still open
    assert sorted(r["n"] for r in events.sessions(df, "1 hour").collect()) == [1, 1, 2]
