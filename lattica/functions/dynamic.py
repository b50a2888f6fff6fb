"""Values of any type: a type's address beside its bytes; and names' numbers."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "type.local/"


def any_of(type_name: str, value: Column, prefix: str = PREFIX) -> Column:
    return F.struct(F.lit(prefix + type_name).alias("type_url"), value.alias("value"))


def any_name(x: Column) -> Column:
    """The name after the address's last slash."""
    return F.substring_index(x["type_url"], "/", -1)


def any_is(x: Column, type_name: str) -> Column:
    return any_name(x) == type_name


def any_value(x: Column, type_name: str) -> Column:
    return F.when(any_is(x, type_name), x["value"])


def bfloat16(x: Column) -> Column:
    """A float rounded to bfloat16, ties to even, as a float."""
    from .values import narrowed

    return narrowed(x.cast("double"), "bfloat16").cast("float")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: bfloat16(x * factor))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: bfloat16(x + y))
