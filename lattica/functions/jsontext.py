"""Schema-directed JSON text of typed values, both ways.

Wide integers are quoted, bytes are base64, NaN and infinities are strings, a
map is an array of [key, value] pairs, an absent message field is left out, a union is
an object of its one branch. Writing raises where a value has no text: a required
field, an item or a map's value that is missing, a union's unknown branch. Reading is strict: unknown or missing fields,
other shapes and values that don't fit raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from .values import Typed, coerced, rendered

_WIDE = ("int64", "uint64", "int128", "uint128")


def _quoted(text: Column) -> Column:
    inner = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(inner, F.lit(6), F.length(inner) - 6))


def _present(text: Column, missing: str) -> Column:
    return F.coalesce(text, F.raise_error(F.lit(missing)).cast("string"))


def _written(t: T.Type, x: Column) -> Column:
    match t:
        case T.Scalar("bool"):
            return x.cast("string")
        case T.Scalar(kind) if kind in _WIDE:
            return F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
        case T.Scalar(kind) if kind in T.BOUNDS:
            return x.cast("string")
        case T.Scalar("float16" | "bfloat16" | "float32" | "float64"):
            odd = F.when(F.isnan(x), F.lit('"NaN"')).when(x == float("inf"), F.lit('"Infinity"')).when(x == float("-inf"), F.lit('"-Infinity"'))
            return odd.otherwise(x.cast("string"))
        case T.Scalar("timestamp" | "duration"):
            return F.concat(F.lit('"'), rendered(t, x), F.lit('"'))
        case T.Scalar():
            return _quoted(rendered(t, x))
        case T.Bytes():
            return F.concat(F.lit('"'), F.base64(x), F.lit('"'))
        case T.Enum():
            return _written(T.Scalar(t.base), x)
        case T.Array(element):
            return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: _present(_written(element, e), "an item is missing")), ","), F.lit("]"))
        case T.Map(key, value):
            pairs = F.transform(F.map_entries(x), lambda e: F.concat(F.lit("["), _written(key, e["key"]), F.lit(","), _present(_written(value, e["value"]), "a map's value is missing"), F.lit("]")))
            return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))
    if isinstance(t, T.Struct):
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _present(_written(f.type, x[f.name]), f"{f.name} is missing")) for f in t.fields]
    else:
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _written(f.type, x[f.name])) for f in t.fields]
    body = _present(F.coalesce(*parts), "unknown branch") if isinstance(t, T.Union) else F.concat_ws(",", *parts)
    return F.when(x.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))


def to_json(v: Typed) -> Column:
    return F.when(v.column.isNotNull(), _written(v.type, v.column))


def _bad(text: str, t: T.Type) -> Column:
    return F.raise_error(F.lit(text)).cast(T.to_spark(t))


def _read(t: T.Type, v: Column) -> Column:
    """A variant as the type's column."""

    def scalar(to: str) -> Column:
        return F.variant_get(v, "$", to)

    kind = F.schema_of_variant(v)
    match t:
        case T.Scalar("bool"):
            return F.when(kind == "BOOLEAN", scalar("boolean")).otherwise(_bad("not a truth value", t))
        case T.Scalar(k) if k in _WIDE:
            return F.when(kind == "STRING", coerced(t, scalar("string"))).when(kind == "BIGINT", coerced(t, scalar("string"))).otherwise(_bad("not a whole number", t))
        case T.Scalar(k) if k in T.BOUNDS:
            return F.when(kind == "BIGINT", coerced(t, scalar("bigint"))).otherwise(_bad("not a whole number", t))
        case T.Scalar("float16" | "bfloat16" | "float32" | "float64"):
            text = scalar("string")
            named = F.when(text == "NaN", float("nan")).when(text == "Infinity", float("inf")).when(text == "-Infinity", float("-inf"))
            return F.when(kind == "STRING", F.coalesce(named.cast(T.to_spark(t)), _bad("not a number", t))).when(kind.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), coerced(t, scalar("double"))).otherwise(_bad("not a number", t))
        case T.Scalar("timestamp" | "duration"):
            p = F.split(scalar("string"), ":")
            fields = [p[0].cast("long").alias("s"), p[1].cast("int").alias("ns")] + ([p[2].cast("int").alias("off_ms")] if t.kind == "timestamp" else [])
            return F.when((kind == "STRING") & (F.size(p) == len(fields)), F.struct(*fields)).otherwise(_bad("not a time", t))
        case T.Scalar():
            return F.when(kind == "STRING", coerced(t, scalar("string"))).otherwise(_bad("not text", t))
        case T.Bytes():
            return F.when(kind == "STRING", coerced(t, F.unbase64(scalar("string")))).otherwise(_bad("not base64", t))
        case T.Enum():
            return _read(T.Scalar(t.base), v)
        case T.Array(element):
            items = F.transform(v.cast("array<variant>"), lambda e: _read(element, e))
            return coerced(t, F.when(kind.startswith("ARRAY"), items).otherwise(_bad("not an array", t)))
        case T.Map(key, value):
            pairs = F.transform(v.cast("array<array<variant>>"), lambda e: F.when(F.size(e) == 2, F.struct(_read(key, F.get(e, F.lit(0))).alias("key"), _read(value, F.get(e, F.lit(1))).alias("value"))))
            return F.when(kind.startswith("ARRAY"), F.map_from_entries(pairs)).otherwise(_bad("not an array of pairs", t))
    object_ = v.cast("map<string,variant>")
    unknown = F.filter(F.map_keys(object_), lambda k: ~k.isin(*[f.name for f in t.fields]) if t.fields else F.lit(True))
    fields = []
    if isinstance(t, T.Union):
        fields.append(F.coalesce(*[F.when(F.map_contains_key(object_, F.lit(f.name)), F.lit(f.tag)) for f in t.fields]).cast("smallint").alias("disc"))
    for f in t.fields:
        e = F.try_element_at(object_, F.lit(f.name))
        absent = F.lit(None).cast(T.to_spark(f.type)) if not isinstance(t, T.Struct) else _bad(f"{f.name} is missing", f.type)
        fields.append(F.when(F.map_contains_key(object_, F.lit(f.name)), _read(f.type, e)).otherwise(absent).alias(f.name))
    right = kind.startswith("OBJECT") & (F.size(unknown) == 0)
    if isinstance(t, T.Union):
        right = right & (F.size(object_) == 1)
    return F.when(right, F.struct(*fields)).otherwise(_bad("not an object of the declared fields", t))


def from_json(text: Column, t: T.Type) -> Typed:
    return Typed(F.when(text.isNotNull(), _read(t, F.parse_json(text))), t)
