"""Array expressions that take time in proportion to the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(a: Column) -> Column:
    """For each item of an array of numbers the sum of all before it.

    Items are summed in groups, so that no array that grows is copied once for each item of a long one.
    """
    start = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["all"] + x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))

    groups = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(_GROUP)), lambda at: F.aggregate(F.slice(a, at, _GROUP), start, step))

    def joined(done: Column) -> Column:
        tops = F.aggregate(F.transform(done, lambda g: g["all"]), start, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(done, tops, lambda g, top: F.transform(g["out"], lambda x: top + x)))

    return F.when(F.size(a) > 0, let(groups, joined)).otherwise(F.array().cast("array<int>"))
