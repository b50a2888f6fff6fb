"""Arrays and maps of groups' rows, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import coerced
from ..plans import types as T


def group_array(value: Column, t: T.Array, order: Column) -> Column:
    """An aggregate: the group's values in order. A null value raises, an empty group is null."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), coerced(t.element, value).alias("v"))))
    return F.when(F.size(pairs) > 0, F.when(F.size(pairs) > T.MAX_ITEMS, F.raise_error(F.lit("too many items")).cast(T.to_spark(t))).otherwise(F.transform(pairs, lambda p: p["v"])))


def group_map(key: Column, value: Column, t: T.Map, order: Column) -> Column:
    """An aggregate: the group's entries in order. A repeated key or a null raises, an empty group is null."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), coerced(t.key, key).alias("k"), coerced(t.value, value).alias("v"))))
    return F.when(F.size(entries) > 0, F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))))
