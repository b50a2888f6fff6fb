"""Reading, checking and changing typed values as column expressions.

A ``Typed`` is a column with its declared type. Paths are compiled on the
driver into nested column access, so Spark prunes and pushes down as for any
other column. A null value gives null; a path to something absent reads as
null. Changes return whole new values and raise where the change can't be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.paths import Step, operand, parse


def _raise(text: str, like: T.Type) -> Column:
    return F.raise_error(F.lit(text)).cast(T.to_spark(like))


def _present(x: Column, out: Column) -> Column:
    return F.when(x.isNotNull(), out)


def _key(t: T.Map, step: Step) -> Column | None:
    kind = t.key.kind
    if kind in T.BOUNDS and step.kind == "index":
        return F.lit(str(step.value) if kind in ("int128", "uint128") else step.value).cast(T.to_spark(t.key))
    if kind in ("string", "uuid") and step.kind == "name":
        return F.lit(step.value.lower() if kind == "uuid" else step.value)
    return None


def rendered(t: T.Type, x: Column) -> Column:
    """A scalar as SQL shows it: flags and enums as integers, wide integers and times as text, halves as doubles; containers as they are."""
    match t:
        case T.Scalar("bool"):
            return x.cast("int")
        case T.Scalar("uint64"):
            return x.cast("string")
        case T.Scalar("uuid"):
            return F.lower(x)
        case T.Scalar("float16" | "bfloat16" | "float32" | "float64"):
            return F.when(F.isnan(x), F.raise_error(F.lit("NaN has no SQL value")).cast("double")).otherwise(x.cast("double"))
        case T.Scalar("timestamp"):
            return _present(x, F.concat_ws(":", x["s"], x["ns"], x["off_ms"]))
        case T.Scalar("duration"):
            return _present(x, F.concat_ws(":", x["s"], x["ns"]))
        case T.Scalar(kind) if kind in T.BOUNDS and kind != "int128" and kind != "uint128":
            return x.cast("long")
        case T.Enum() if t.base != "uint64":
            return x.cast("long")
    return x


def coerced(t: T.Type, value) -> Column:
    """``value`` in the type's column, exactly: what doesn't fit raises, null too."""
    if isinstance(value, Typed):
        if value.type != t:
            raise T.SchemaError(f"{T.describe(value.type)} is not {T.describe(t)}")
        return F.when(value.column.isNull(), _raise("null has no typed value", t)).otherwise(value.column)
    v = value if isinstance(value, Column) else F.lit(value)
    out, fits = v.cast(T.to_spark(t)), None
    match t:
        case T.Scalar(kind) if kind in ("int128", "uint128"):
            low, high = T.BOUNDS[kind]
            text = v.cast("string")
            size = F.length(F.regexp_replace(text, "^-", ""))
            bound = F.when(text.startswith("-"), F.lit(str(-low) if low else "0")).otherwise(F.lit(str(high)))
            digits = F.regexp_replace(text, "^-", "")
            fits = text.rlike("^(0|-?[1-9][0-9]*)$") & ((size < F.length(bound)) | ((size == F.length(bound)) & (digits <= bound)))
            out = text
        case T.Scalar(kind) if kind in T.BOUNDS:
            low, high = T.BOUNDS[kind]
            whole = v.cast("string").try_cast("decimal(38,0)")
            fits = v.cast("string").rlike("^(0|-?[1-9][0-9]*)$") & (whole >= F.lit(str(low)).cast("decimal(38,0)")) & (whole <= F.lit(str(high)).cast("decimal(38,0)"))
            out = whole.cast(T.to_spark(t))
        case T.Enum():
            return coerced(T.Scalar(t.base), value)
        case T.Scalar("bool"):
            fits = v.cast("string").isin("0", "1", "true", "false")
            out = v.cast("string").isin("1", "true")
        case T.Scalar("float32"):
            fits = F.isnan(v.cast("double")) | (v.cast("float").cast("double") == v.cast("double"))
        case T.Scalar("bfloat16" | "float16"):
            fits = F.isnan(v.cast("double")) | (narrowed(v.cast("double"), t.kind) == v.cast("double"))
        case T.Scalar("uuid"):
            out = F.lower(v)
            fits = out.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
        case T.Bytes(size) if size is not None:
            fits = F.octet_length(v) == size
        case T.Array(_, size) if size is not None:
            fits = F.size(v) == size
    if fits is not None:
        out = F.when(fits, out).otherwise(_raise(f"the value doesn't fit {T.describe(t)}", t))
    return F.when(v.isNull(), _raise("null has no typed value", t)).otherwise(out)


def narrowed(x: Column, kind: str) -> Column:
    """A double rounded to the nearest half or bfloat16, ties to even, as a double."""
    bits, least, most = (10, -14, 65504.0) if kind == "float16" else (7, -126, 3.3895313892515355e38)
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))), F.lit(least).cast("long"))
    unit = F.pow(F.lit(2.0), exponent - bits)
    near = F.rint(size / unit) * unit
    limit = most + F.pow(F.lit(2.0), F.lit(15 - 11 if kind == "float16" else 127 - 8).cast("double"))
    value = F.when(size >= limit, F.lit(float("inf"))).otherwise(near)
    return F.when(F.isnan(x) | (size == float("inf")), x).otherwise(F.when((x < 0) | (F.signum(x) < 0), -value).otherwise(value))


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.Type

    # reading

    def get(self, path: str | int = "$") -> Typed | None:
        """The value at the path with its own type; None where the type has no such path."""
        at: Typed | None = self
        for step in parse(operand(path)):
            if at is None:
                return None
            at = at._child(step)
        return at

    def __getitem__(self, path: str | int) -> Typed | None:
        return self.get(path)

    def _child(self, step: Step) -> Typed | None:
        x, t = self.column, self.type
        match t:
            case T.Struct() | T.Message() | T.Union():
                if step.kind != "name":
                    if isinstance(t, T.Message):
                        raise T.SchemaError(f"{t.name} is not indexed")
                    return None
                f = T.field_named(t, step.value)
                return f and Typed(x[f.name], f.type)
            case T.Array(element):
                if step.kind == "name" or step.kind == "index" and step.value < 0:
                    return None
                return Typed(F.get(x, _place(x, step)), element)
            case T.Bytes():
                if step.kind == "name" or step.kind == "index" and step.value < 0:
                    return None
                at = F.lit(step.value) if step.kind == "index" else F.octet_length(x) - step.value
                byte = F.conv(F.hex(F.substring(x, at + 1, F.lit(1))), 16, 10)
                return Typed(F.when((at >= 0) & (at < F.octet_length(x)), byte.cast("smallint")), T.Scalar("byte"))
            case T.Map():
                key = _key(t, step)
                return None if key is None else Typed(F.try_element_at(x, key), t.value)
        raise T.SchemaError(f"{T.describe(t)} has no parts")

    def _read(self, path: str | int, f: Callable[[Typed], Column], absent: str) -> Column:
        at = self.get(path)
        return F.lit(None).cast(absent) if at is None else f(at)

    def extract(self, path: str | int = "$") -> Column:
        return self._read(path, lambda v: rendered(v.type, v.column), "string")

    def exists(self, path: str | int) -> Column:
        return _present(self.column, self._read(path, lambda v: v.column.isNotNull().cast("int"), "int").cast("int") if self.get(path) else F.lit(0))

    def typeof(self, path: str | int = "$") -> Column:
        return self._read(path, lambda v: _present(v.column, F.lit(T.describe(v.type))), "string")

    def kind(self, path: str | int = "$") -> Column:
        return self._read(path, lambda v: _present(v.column, F.lit(T.kind_of(v.type))), "string")

    def length(self, path: str | int = "$") -> Column:
        """Bytes of text and bytes, items of arrays and maps, declared fields of a struct, present fields of a message, 1 for a union."""

        def of(v: Typed) -> Column:
            x = v.column
            match v.type:
                case T.Scalar("string") | T.Bytes():
                    return F.octet_length(x)
                case T.Array() | T.Map():
                    return _present(x, F.size(x))
                case T.Struct(_, fields):
                    return _present(x, F.lit(len(fields)))
                case T.Message(_, fields):
                    return _present(x, sum((x[f.name].isNotNull().cast("int") for f in fields), F.lit(0)))
                case T.Union():
                    return _present(x, F.lit(1))
            raise T.SchemaError(f"{T.describe(v.type)} has no length")

        return self._read(path, lambda v: of(v).cast("long"), "long")

    def branch(self, path: str | int = "$") -> Column:
        """The active branch's name, or # and the discriminator if that is unknown."""

        def of(v: Typed) -> Column:
            if not isinstance(v.type, T.Union):
                raise T.SchemaError(f"{T.describe(v.type)} has no branches")
            disc = v.column["disc"]
            names = [F.when(disc == f.tag, F.lit(f.name)) for f in v.type.fields]
            return _present(v.column, F.coalesce(*names, F.concat(F.lit("#"), disc)))

        return self._read(path, of, "string")

    def enum_name(self, path: str | int = "$") -> Column:
        """The first declared member of the value, or null."""

        def of(v: Typed) -> Column:
            if not isinstance(v.type, T.Enum):
                raise T.SchemaError(f"{T.describe(v.type)} has no members")
            return F.coalesce(*[F.when(v.column == value, F.lit(name)) for name, value in v.type.members])

        return self._read(path, of, "string")

    # checking

    def error(self) -> Column:
        """What is wrong with the value, or null."""
        return _present(self.column, _error(self.type, self.column, F.lit("$")))

    def valid(self) -> Column:
        return _present(self.column, self.error().isNull().cast("int"))

    # maps

    def _map(self) -> T.Map:
        if not isinstance(self.type, T.Map):
            raise T.SchemaError(f"{T.describe(self.type)} is not a map")
        return self.type

    def map_get(self, key) -> Typed:
        return Typed(F.try_element_at(self.column, coerced(self._map().key, key)), self.type.value)

    def map_has(self, key) -> Column:
        return F.map_contains_key(self.column, coerced(self._map().key, key)).cast("int")

    def map_set(self, key, value) -> Typed:
        """An entry replaced in its place, or added at the end."""
        t = self._map()
        return Typed(_present(self.column, _map_put(self.column, coerced(t.key, key), coerced(t.value, value))), t)

    def map_remove(self, key) -> Typed:
        k = coerced(self._map().key, key)
        return Typed(F.map_filter(self.column, lambda a, _: a != k), self.type)

    # changing

    def set(self, path: str, value) -> Typed:
        return self._change("set", path, value)

    def insert(self, path: str, value) -> Typed:
        return self._change("insert", path, value)

    def replace(self, path: str, value) -> Typed:
        return self._change("replace", path, value)

    def append(self, path: str, value) -> Typed:
        return self._change("append", path, value)

    def remove(self, path: str) -> Typed:
        return self._change("remove", path, None)

    def _change(self, how: str, path: str, value) -> Typed:
        steps = parse(path, mutating=True)
        if not steps and how in ("insert", "remove"):
            raise T.SchemaError(f"the whole value can't be the target of {how}")
        return Typed(_present(self.column, _changed(how, self.type, self.column, steps, value)), self.type)


def _place(x: Column, step: Step) -> Column:
    return F.lit(step.value) if step.kind == "index" else F.size(x) - step.value


def _map_put(x: Column, key: Column, value: Column) -> Column:
    entry = F.struct(key.alias("key"), value.alias("value"))
    there = F.transform(F.map_entries(x), lambda e: F.when(e["key"] == key, entry).otherwise(e))
    return F.map_from_entries(F.when(F.map_contains_key(x, key), there).otherwise(F.concat(F.map_entries(x), F.array(entry))))


def _changed(how: str, t: T.Type, x: Column, steps: tuple[Step, ...], value) -> Column:
    if not steps:
        if how == "append":
            if not isinstance(t, T.Array) or t.size is not None:
                raise T.SchemaError(f"{T.describe(t)} doesn't grow")
            return F.when(x.isNull(), _raise("nothing to append to", t)).otherwise(F.array_append(x, coerced(t.element, value)))
        return coerced(t, value)
    step, rest = steps[0], steps[1:]
    last = not rest and how != "append"
    match t:
        case T.Struct() | T.Message() | T.Union():
            f = T.field_named(t, step.value) if step.kind == "name" else None
            if f is None:
                raise T.SchemaError(f"{t.name} has no field {step.value!r}")
            now = x[f.name]
            if isinstance(t, T.Union) and last and how in ("remove", "insert"):
                raise T.SchemaError("a branch can't be added or removed")
            if last and isinstance(t, T.Struct):
                if how == "remove":
                    raise T.SchemaError(f"{t.name}.{f.name} is required")
                new = now if how == "insert" else coerced(f.type, value)
            elif last:
                v = None if how == "remove" else coerced(f.type, value)
                new = {"set": lambda: v, "insert": lambda: F.when(now.isNull(), v).otherwise(now), "replace": lambda: F.when(now.isNotNull(), v), "remove": lambda: F.lit(None).cast(T.to_spark(f.type))}[how]()
                if isinstance(t, T.Union):
                    new = F.when(now.isNull(), _raise(f"{f.name} is not the active branch", f.type)).otherwise(v)
            else:
                new = F.when(now.isNull(), _raise(f"{f.name} is absent", f.type)).otherwise(_changed(how, f.type, now, rest, value))
            return x.withField(f"`{f.name}`", new)
        case T.Array(element, size):
            if step.kind == "name":
                raise T.SchemaError(f"{T.describe(t)} has no names")
            if step.kind == "append":
                if size is not None or how == "remove":
                    raise T.SchemaError(f"{how} can't use [#] on {T.describe(t)}")
                return x if how == "replace" else F.array_append(x, coerced(element, value))
            at, n = _place(x, step), F.size(x)
            if step.kind == "index" and step.value < 0:
                raise T.SchemaError("an array is indexed from 0")
            if last and how in ("insert", "remove"):
                if size is not None:
                    raise T.SchemaError(f"{T.describe(t)} keeps its size")
                done = F.filter(x, lambda _, i: i != at) if how == "remove" else F.when(at == n, F.array_append(x, coerced(element, value))).otherwise(F.array_insert(x, at + 1, coerced(element, value)))
                return F.when((at < 0) | (at > n), _raise("index beyond the array", t)).otherwise(done)
            done = F.transform(x, lambda e, i: F.when(i == at, coerced(element, value) if last else _changed(how, element, e, rest, value)).otherwise(e))
            return F.when((at < 0) | (at >= n), _raise("index beyond the array", t)).otherwise(done)
        case T.Map():
            key = _key(t, step)
            if key is None:
                raise T.SchemaError(f"{step.value!r} is no key of {T.describe(t)}")
            has = F.map_contains_key(x, key)
            if last and how == "remove":
                return F.map_filter(x, lambda k, _: k != key)
            if last:
                put = _map_put(x, key, coerced(t.value, value))
                return {"set": put, "insert": F.when(has, x).otherwise(put), "replace": F.when(has, put).otherwise(x)}[how]
            inner = _changed(how, t.value, F.try_element_at(x, key), rest, value)
            return F.when(has, _map_put(x, key, inner)).otherwise(_raise("no such entry", t))
    raise T.SchemaError(f"{T.describe(t)} has no parts")


def _error(t: T.Type, x: Column, where: Column, depth: int = 0) -> Column:
    if depth > T.MAX_DEPTH:
        raise T.SchemaError(f"values are {T.MAX_DEPTH} deep at most")

    def says(bad: Column, text: str) -> Column:
        return F.when(bad, F.concat(where, F.lit(": " + text)))

    none = F.lit(None).cast("string")
    match t:
        case T.Scalar("string"):
            return says(~F.is_valid_utf8(x), "not UTF-8")
        case T.Scalar("uuid"):
            return says(~F.lower(x).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "not a uuid")
        case T.Scalar("timestamp"):
            return says((x["ns"] < 0) | (x["ns"] >= 1_000_000_000), "nanoseconds out of range")
        case T.Scalar("duration"):
            return says(F.abs(x["ns"]) >= 1_000_000_000, "nanoseconds out of range")
        case T.Scalar("int128" | "uint128" as kind):
            return says(~x.rlike("^(0|-?[1-9][0-9]{0,38})$" if kind == "int128" else "^(0|[1-9][0-9]{0,38})$"), "not a whole number")
        case T.Scalar(kind) if kind in ("byte", "uint16", "uint32", "uint64"):
            low, high = T.BOUNDS[kind]
            return says((x < low) | (x > F.lit(str(high)).cast("decimal(20,0)")), f"not from {low} to {high}")
        case T.Bytes(size) if size is not None:
            return says(F.octet_length(x) != size, f"not {size} bytes")
        case T.Array(element, size):
            inner = F.filter(F.transform(x, lambda e, i: F.when(e.isNull(), F.concat(where, F.lit(": null item"))).otherwise(_error(element, e, F.concat(where, F.lit("["), i, F.lit("]")), depth + 1))), lambda m: m.isNotNull())
            sized = says(F.size(x) != size, f"not {size} items") if size is not None else says(F.size(x) > T.MAX_ITEMS, "too many items")
            return F.coalesce(sized, F.get(inner, F.lit(0)))
        case T.Map(key, value):
            inner = F.filter(F.transform(F.map_entries(x), lambda e: F.coalesce(_error(key, e["key"], where, depth + 1), _error(value, e["value"], F.concat(where, F.lit("."), e["key"].cast("string")), depth + 1))), lambda m: m.isNotNull())
            return F.coalesce(says(F.size(x) > T.MAX_ITEMS, "too many entries"), F.get(inner, F.lit(0)))
        case T.Struct(_, fields):
            return F.coalesce(none, *[F.coalesce(says(x[f.name].isNull(), f"{f.name} is required"), _error(f.type, x[f.name], F.concat(where, F.lit("." + f.name)), depth + 1)) for f in fields])
        case T.Message(_, fields):
            return F.coalesce(none, *[_present(x[f.name], _error(f.type, x[f.name], F.concat(where, F.lit("." + f.name)), depth + 1)) for f in fields])
        case T.Union(_, fields):
            active = sum((x[f.name].isNotNull().cast("int") for f in fields), F.lit(0))
            known = x["disc"].isin(*[f.tag for f in fields]) if fields else F.lit(False)
            return F.coalesce(says(x["disc"] == 0, "discriminator 0"), says(known & (active != 1), "not one active branch"), *[says((x["disc"] == f.tag) & x[f.name].isNull(), f"{f.name} is missing") for f in fields], *[_present(x[f.name], _error(f.type, x[f.name], F.concat(where, F.lit("." + f.name)), depth + 1)) for f in fields])
    return none


def checked(df: DataFrame, value: Typed, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """The rows whose value is valid or null, and the others with ``reason``: a check constraint that keeps what it refuses."""
    error = value.error()
    return df.filter(error.isNull()), df.filter(error.isNotNull()).withColumn(reason, error)
