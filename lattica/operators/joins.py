"""Joins by order: the latest row before another, and points inside intervals, without comparing all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` with the same ``by`` and no later (``at``, ``tie``); null without one.

    One shuffle by the key and one pass in order: both sides run as one stream of rows, and the last right row is carried along.
    """
    own = [c for c in left.columns if c not in (*by, at, tie)]
    row = F.struct(*take)
    a = left.select(*by, at, tie, F.struct(*own).alias("_own") if own else F.lit(None).cast("struct<x:int>").alias("_own"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_row"), F.lit(1).alias("_left"))
    b = right.select(*by, at, tie, F.lit(None).cast(a.schema["_own"].dataType).alias("_own"), row.alias("_row"), F.lit(0).alias("_left"))
    so_far = Window.partitionBy(*by).orderBy(at, tie, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("_last", F.last("_row", ignorenulls=True).over(so_far)).filter("_left = 1")
    return found.select(*[F.col(c) if c in (*by, at, tie) else F.col("_own")[c].alias(c) for c in left.columns], *[F.col("_last")[c].alias(c) for c in take])


def within(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of points and intervals of the same ``by`` with start <= at < end; ``at``, ``start`` and ``end`` are numbers.

    Both sides are dealt to buckets of ``width`` (about the length of an interval) and meet in an equi-join on key and bucket;
    an interval lies in each bucket that it touches, a point in one, so no pair comes twice.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    last: Column = F.ceil(F.col(end) / width) - 1
    reach = intervals.filter(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), F.greatest(last, bucket(start)))))
    met = points.withColumn("_bucket", bucket(at)).join(reach, [*by, "_bucket"])
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")
