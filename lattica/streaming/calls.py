"""Calls as tables: the four shapes, batches with dependencies, futures, cursors and deadlines.

A method is a function of a payload column. A call is a row; a batch is the rows with its id. Everything here is
joins, groupings and windows over those rows; what is said to work on streams works on
``readStream`` frames as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Method = Callable[[Column], Column]
#: Limits and status codes of calls.
MAX_BATCH, MAX_ELEMENTS, MAX_KEPT = 1024, 10_000, 10_000
INVALID_ARGUMENT, NOT_FOUND, PERMISSION_DENIED, UNIMPLEMENTED = 3, 5, 7, 12


def unary(calls: DataFrame, method: Method) -> DataFrame:
    """One row in, one row out: ``payload`` through the method, as ``result``."""
    return calls.withColumn("result", method(F.col("payload")))


def server_stream(calls: DataFrame, method: Method) -> DataFrame:
    """One row in, a row per element of the method's array out, numbered by ``pos``."""
    others = [c for c in calls.columns if c != "payload"]
    return calls.select(*others, F.posexplode(method(F.col("payload"))).alias("pos", "result"))


def client_stream(calls: DataFrame, method: Method, order: str = "pos", limit: int = MAX_ELEMENTS) -> DataFrame:
    """Rows of a call in, one row out: the method sees the array of payloads in order. More than ``limit`` elements raise."""
    sent = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("payload"))))
    few = F.when(F.count("*") > limit, F.raise_error(F.lit("too many elements")).cast("boolean")).otherwise(True)
    grouped = calls.groupBy("call_id").agg(sent.alias("_s"), few.alias("_few")).filter("_few").withColumn("_s", F.transform("_s", lambda x: x["payload"]))
    return grouped.select("call_id", method(F.col("_s")).alias("result"))


def duplex(calls: DataFrame, aggregate: Method, order: str = "pos") -> DataFrame:
    """A row out for each row in, from all rows of its call so far."""
    so_far = Window.partitionBy("call_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("result", aggregate(F.col("payload")).over(so_far))


def batch_problems(calls: DataFrame) -> DataFrame:
    """(batch_id, problem) of batches that can't run: calls are (batch_id, pos, call_id, input_from), -1 for no input.

    Ids are unique and not negative, an input comes from an earlier call, and a batch has MAX_BATCH calls at most.
    """
    sizes = calls.groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("ids"), F.min("call_id").alias("low"), F.min("input_from").alias("sentinel"))
    earlier = calls.alias("c").join(calls.select("batch_id", F.col("call_id").alias("input_from"), F.col("pos").alias("source")), ["batch_id", "input_from"], "left")
    late = earlier.filter((F.col("input_from") >= 0) & (F.col("source").isNull() | (F.col("source") >= F.col("c.pos")))).select("batch_id").distinct().withColumn("late", F.lit(True))
    problem = F.when(F.col("n") > MAX_BATCH, "too many calls").when(F.col("low") < 0, "negative id").when(F.col("ids") < F.col("n"), "repeated id").when(F.col("sentinel") < -1, "bad input").when(F.col("late"), "input is not from an earlier call")
    return sizes.join(late, "batch_id", "left").select("batch_id", problem.alias("problem")).filter("problem is not null")


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that a step doesn't run all steps before it again; as it is without such a folder."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def run_batches(calls: DataFrame, methods: dict[str, Method]) -> DataFrame:
    """Outcomes (batch_id, pos, call_id, result, code, message) of calls (batch_id, pos, call_id, method, payload, input_from).

    Calls run in waves by how deep their inputs lie; a wave is one join of the calls still open with the wave before, and the last
    is the one after which none is open. A null result fails its call, and what depends on it fails with it, while others keep
    their results. Batches that can't run fail whole.
    """
    bad = _cut(batch_problems(calls))
    good = calls.join(bad.select("batch_id"), "batch_id", "left_anti")

    def applied(df: DataFrame, payload: Column) -> DataFrame:
        result = F.coalesce(*[F.when(F.col("method") == name, f(payload)) for name, f in methods.items()])
        known = F.col("method").isin(*methods)
        code = F.when(F.col("failed").isNotNull(), INVALID_ARGUMENT).when(~known, UNIMPLEMENTED).when(result.isNull(), INVALID_ARGUMENT).otherwise(0)
        message = F.when(F.col("failed").isNotNull(), F.concat(F.lit("dependency "), F.col("failed").cast("string"), F.lit(" failed"))).when(~known, F.lit("no such method")).when(result.isNull(), F.lit("no result"))
        return df.select("batch_id", "pos", "call_id", F.when(code == 0, result).alias("result"), code.alias("code"), message.alias("message"))

    wave = applied(good.filter("input_from = -1").withColumn("failed", F.lit(None).cast("int")), F.col("payload"))
    done, open_ = wave, _cut(good.filter("input_from <> -1"))
    # an input comes from an earlier call, so every wave but the last closes a call
    while not open_.isEmpty():
        wave = _cut(wave)
        fed = wave.select("batch_id", F.col("call_id").alias("input_from"), F.col("result").alias("fed"), F.when(F.col("code") != 0, F.col("call_id")).alias("failed"))
        wave = applied(open_.join(fed, ["batch_id", "input_from"]), F.col("fed"))
        open_ = _cut(open_.join(fed.select("batch_id", "input_from"), ["batch_id", "input_from"], "left_anti").select(*open_.columns))
        done = done.union(wave)
    whole = bad.join(calls, "batch_id").select("batch_id", "pos", "call_id", F.lit(None).cast(dict(done.dtypes)["result"]).alias("result"), F.lit(INVALID_ARGUMENT).alias("code"), F.col("problem").alias("message"))
    return done.union(whole)


def with_metadata(batch: Column, upstream: Column) -> Column:
    """The batch's metadata overlaid by the upstream response's."""
    return F.map_concat(F.map_filter(batch, lambda k, _: ~F.map_contains_key(upstream, k)), upstream)


def dispatched(futures: DataFrame, cancels: DataFrame | None = None) -> DataFrame:
    """(owner, idem_key, id, at) rows with ``handle``: the id that the first dispatch of the owner's key got. A null key never repeats.

    ``cancels`` (owner, id, at) release the key of the future that they name, if it is the owner's, from that time on: the next dispatch starts anew.
    """
    mine = Window.partitionBy("owner", "idem_key")
    rows = futures.withColumn("_freed", F.lit(0))
    if cancels is not None:
        freed = cancels.select("owner", "id", F.col("at").alias("_when")).join(futures.select("owner", "id", "idem_key"), ["owner", "id"])
        rows = rows.unionByName(freed.select("owner", "idem_key", F.col("_when").alias("at"), F.lit(1).alias("_freed")), allowMissingColumns=True)
    so_far = mine.orderBy("at", F.desc("_freed"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turn", F.sum("_freed").over(so_far)).filter("_freed = 0")
    first = Window.partitionBy("owner", "idem_key", "_turn").orderBy("at", "id")
    return rows.withColumn("handle", F.when(F.col("idem_key").isNull(), F.col("id")).otherwise(F.first("id").over(first))).drop("_freed", "_turn")


def cancelled(futures: DataFrame, asked: DataFrame) -> DataFrame:
    """Outcomes (owner, id, code, stopped) of requests (owner, id) to cancel futures (owner, id, done; null while pending).

    An unknown id and another caller's future are refused; a completed one is well but stays as it is.
    """
    known = futures.select("id", F.col("owner").alias("_of"), F.col("done").isNotNull().alias("_done"))
    code = F.when(F.col("_of").isNull(), NOT_FOUND).when(F.col("_of") != F.col("owner"), PERMISSION_DENIED).otherwise(0)
    return asked.select("owner", "id").join(known, "id", "left").select("owner", "id", code.alias("code"), ((code == 0) & ~F.coalesce("_done", F.lit(True))).alias("stopped"))


def cancelled_calls(calls: DataFrame, stopped: DataFrame) -> DataFrame:
    """The call_id of all calls (call_id, parent_id) that end with the stopped ones (call_id): these and all below them, no parent and no sibling.

    One join for each level of the tree, over the calls found last.
    """
    found = _cut(calls.select("call_id").join(stopped.select("call_id").distinct(), "call_id", "left_semi").distinct())
    every = found
    while not found.isEmpty():
        below = calls.join(found.select(F.col("call_id").alias("parent_id")), "parent_id", "left_semi").select("call_id").distinct()
        found = _cut(below.join(every, "call_id", "left_anti"))
        every = every.union(found)
    return every


def dispatched_stream(futures: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first dispatch of each owner's key, on a stream with event time ``at``: state is kept for ``within``."""
    return futures.withWatermark("at", within).dropDuplicatesWithinWatermark(["owner", "idem_key"])


def retained(completed: DataFrame, limit: int = MAX_KEPT) -> DataFrame:
    """What a store of ``limit`` completed futures still holds, of all owners together: those completed first leave first, by (done, id).

    Futures whose column ``discard`` is true are delivered to whoever waits and never kept.
    """
    kept = completed.filter("not coalesce(discard, false)") if "discard" in completed.columns else completed
    return kept.orderBy(F.desc("done"), F.desc("id")).limit(limit)


def resolved(completed: DataFrame, asked: DataFrame) -> DataFrame:
    """The completed futures that are asked for (owner, id) by their own owner."""
    return completed.join(asked.select("owner", "id").distinct(), ["owner", "id"], "left_semi")


def with_cursors(elements: DataFrame, order: str = "pos") -> DataFrame:
    """Elements of calls numbered from 1 by ``cursor``."""
    return elements.withColumn("cursor", F.row_number().over(Window.partitionBy("call_id").orderBy(order)))


def resumed(elements: DataFrame, last: DataFrame) -> DataFrame:
    """What each client (call_id, cursor) hasn't had; a call without a stated cursor starts anew."""
    had = last.groupBy("call_id").agg(F.max("cursor").alias("_had"))
    return elements.join(had, "call_id", "left").filter(F.col("cursor") > F.coalesce("_had", F.lit(0))).drop("_had")


def within_deadline(calls: DataFrame, parents: DataFrame, now: Column) -> DataFrame:
    """Calls (call_id, parent_id, deadline) still to run: a child's deadline is never later than its parent's (call_id, deadline)."""
    above = parents.select(F.col("call_id").alias("parent_id"), F.col("deadline").alias("_above"))
    return calls.join(above, "parent_id", "left").withColumn("deadline", F.least("deadline", "_above")).drop("_above").filter(F.col("deadline").isNull() | (F.col("deadline") > now))


def intercepted(method: Method, *interceptors: Callable[[Method], Method]) -> Method:
    """The method inside its interceptors, the first outermost."""
    for wrap in reversed(interceptors):
        method = wrap(method)
    return method


def discovery(spark, services: dict[str, dict[str, str]]) -> DataFrame:
    """(service, method, shape, method_id) of {service: {method: shape}}."""
    from ..functions.method_id import method_id

    rows = [(s, m, shape) for s, methods in services.items() for m, shape in methods.items()]
    return spark.createDataFrame(rows, "service string, method string, shape string").withColumn("method_id", method_id(F.concat(F.lit("/"), "service", F.lit("/"), "method")))
