"""Declared types and the Spark columns that hold them.

| declared | column |
| --- | --- |
| bool, int8..int64, uint8..uint32 | boolean, the next wider signed integer |
| uint64 | decimal(20,0) |
| int128, uint128 | canonical decimal string |
| float16, bfloat16, float32 / float64 | float / double |
| string, uuid / bytes | string / binary |
| timestamp / duration | struct<s, ns, off_ms> / struct<s, ns> |
| array, fixed array | array |
| map | map, entries in the order of arrival |
| struct / message | struct with required / optional fields |
| union | struct<disc, a nullable field per branch> |
| enum | its base integer |

Spark can't cast a nullable column to one that isn't, so all fields are nullable columns; what is
required says so in its field's metadata, and ``Typed.error`` finds what is missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import types as T

#: Scalar kinds, their wire widths and the columns that hold them.
SCALARS: dict[str, tuple[int, T.DataType]] = {
    "bool": (1, T.BooleanType()), "byte": (1, T.ShortType()), "int8": (1, T.ByteType()), "int16": (2, T.ShortType()), "uint16": (2, T.IntegerType()),
    "int32": (4, T.IntegerType()), "uint32": (4, T.LongType()), "int64": (8, T.LongType()), "uint64": (8, T.DecimalType(20, 0)), "int128": (16, T.StringType()), "uint128": (16, T.StringType()),
    "float16": (2, T.FloatType()), "float32": (4, T.FloatType()), "float64": (8, T.DoubleType()), "bfloat16": (2, T.FloatType()), "string": (0, T.StringType()), "uuid": (16, T.StringType()),
    "timestamp": (16, T.StructType([T.StructField("s", T.LongType()), T.StructField("ns", T.IntegerType()), T.StructField("off_ms", T.IntegerType())])),
    "duration": (12, T.StructType([T.StructField("s", T.LongType()), T.StructField("ns", T.IntegerType())])),
}
#: Inclusive bounds of the integer kinds.
BOUNDS = {"byte": (0, 2**8 - 1), "int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "uint16": (0, 2**16 - 1), "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1), "int128": (-(2**127), 2**127 - 1), "uint128": (0, 2**128 - 1)}
MAP_KEYS = {"bool", "string", "uuid", *BOUNDS}
MAX_DEPTH, MAX_ITEMS, MAX_FIXED, MAX_STEPS = 64, 1_000_000, 65_535, 63


class SchemaError(ValueError):
    """A declared type or a path that can't be."""


@dataclass(frozen=True)
class Scalar:
    kind: str

    def __post_init__(self):
        if self.kind not in SCALARS:
            raise SchemaError(f"unknown scalar {self.kind}")


@dataclass(frozen=True)
class Bytes:
    size: int | None = None


@dataclass(frozen=True)
class Array:
    element: "Type"
    size: int | None = None

    def __post_init__(self):
        if self.size is not None and not 1 <= self.size <= MAX_FIXED:
            raise SchemaError(f"a fixed array has 1 to {MAX_FIXED} items, not {self.size}")


@dataclass(frozen=True)
class Map:
    key: Scalar
    value: "Type"

    def __post_init__(self):
        if not isinstance(self.key, Scalar) or self.key.kind not in MAP_KEYS:
            raise SchemaError(f"{describe(self.key)} can't be a map's key")


@dataclass(frozen=True)
class Enum:
    name: str
    members: tuple[tuple[str, int], ...]
    base: str = "uint32"
    flags: bool = False

    def __post_init__(self):
        low, high = BOUNDS[self.base]
        if not any(v == 0 for _, v in self.members):
            raise SchemaError(f"{self.name} has no member of value 0")
        if bad := [n for n, v in self.members if not low <= v <= high]:
            raise SchemaError(f"{self.name}: {bad} don't fit {self.base}")


@dataclass(frozen=True)
class Field:
    name: str
    type: "Type"
    tag: int | None = None
    deprecated: bool = False


@dataclass(frozen=True)
class Struct:
    name: str
    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        _unique(self.name, [f.name for f in self.fields])


@dataclass(frozen=True)
class Message:
    """``closed``: fields that aren't declared are an error instead of being passed over."""

    name: str
    fields: tuple[Field, ...] = ()
    closed: bool = False

    def __post_init__(self):
        _unique(self.name, [f.name for f in self.fields])
        _unique(self.name, [f.tag for f in self.fields])
        if bad := [f.name for f in self.fields if not isinstance(f.tag, int) or not 1 <= f.tag <= 255]:
            raise SchemaError(f"{self.name}: tags of {bad} are not from 1 to 255")


@dataclass(frozen=True)
class Union:
    """Branches are fields whose tag is the discriminator, from 1 to 255, and whose type is a struct or message."""

    name: str
    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        _unique(self.name, [f.name for f in self.fields])
        _unique(self.name, [f.tag for f in self.fields])
        for f in self.fields:
            if not isinstance(f.tag, int) or not 1 <= f.tag <= 255:
                raise SchemaError(f"{self.name}: the discriminator of {f.name} is not from 1 to 255")
            if not isinstance(f.type, (Struct, Message)):
                raise SchemaError(f"{self.name}: {f.name} is not a struct or message")


Type = Scalar | Bytes | Array | Map | Enum | Struct | Message | Union
Record = (Struct, Message, Union)


def recursive(make: Callable[[Message | None], Message], levels: int) -> Message:
    """A message that holds itself, as columns have to be: so many levels deep.

    ``make`` declares it around the type of the next level, and without its own kind around None. The last level is closed, so a
    value that is deeper raises when it is read and is never cut off.
    """
    if not 1 <= levels <= MAX_DEPTH:
        raise SchemaError(f"levels are from 1 to {MAX_DEPTH}")
    t = replace(make(None), closed=True)
    for _ in range(levels - 1):
        t = make(t)
    return t


def _unique(name: str, values: list) -> None:
    if twice := {v for v in values if values.count(v) > 1}:
        raise SchemaError(f"{name}: {sorted(map(str, twice))} more than once")


def describe(t: Type) -> str:
    """The type's expression, as ``typeof`` gives it."""
    match t:
        case Scalar(kind):
            return kind
        case Bytes(size):
            return "byte[]" if size is None else f"byte[{size}]"
        case Array(element, size):
            return f"{describe(element)}[{'' if size is None else size}]"
        case Map(key, value):
            return f"map[{describe(key)},{describe(value)}]"
    return t.name


def spec_of(t: Type) -> str:
    """A declaration as JSON text, the same for equal declarations."""

    def plain(x):
        if is_dataclass(x):
            return {"is": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in fields(x)}}
        return [plain(y) for y in x] if isinstance(x, tuple) else x

    return json.dumps(plain(t), separators=(",", ":"))


def from_spec(text: str) -> Type:
    """The declaration that ``spec_of`` wrote; checked like any other."""

    def built(x):
        if isinstance(x, dict):
            kinds = {c.__name__: c for c in (Scalar, Bytes, Array, Map, Enum, Field, Struct, Message, Union)}
            if x.get("is") not in kinds:
                raise SchemaError("not a declaration")
            return kinds[x["is"]](**{k: built(v) for k, v in x.items() if k != "is"})
        return tuple(built(y) for y in x) if isinstance(x, list) else x

    return built(json.loads(text))


def kind_of(t: Type) -> str:
    """The type's broad kind, as ``kind`` gives it."""
    match t:
        case Scalar("bool"):
            return "boolean"
        case Scalar(k) if k in BOUNDS:
            return "integer"
        case Scalar(k) if k in ("float16", "bfloat16", "float32", "float64"):
            return "real"
        case Scalar(k):
            return k
        case Bytes():
            return "bytes"
    return type(t).__name__.lower()


def is_container(t: Type) -> bool:
    return isinstance(t, (Bytes, Array, Map, *Record))


def to_spark(t: Type) -> T.DataType:
    match t:
        case Scalar(kind):
            return SCALARS[kind][1]
        case Bytes():
            return T.BinaryType()
        case Array(element):
            return T.ArrayType(to_spark(element))
        case Map(key, value):
            return T.MapType(to_spark(key), to_spark(value))
        case Enum():
            return SCALARS[t.base][1]
        case Struct():
            return T.StructType([T.StructField(f.name, to_spark(f.type), True, metadata_of(f) | {"required": True}) for f in t.fields])
        case Message():
            return T.StructType([T.StructField(f.name, to_spark(f.type), True, metadata_of(f)) for f in t.fields])
        case Union():
            return T.StructType([T.StructField("disc", T.ShortType()), *[T.StructField(f.name, to_spark(f.type), True, metadata_of(f)) for f in t.fields]])
    raise SchemaError(f"not a type: {t!r}")


def metadata_of(f: Field) -> dict:
    out: dict = {"type": describe(f.type)}
    if f.tag is not None:
        out["tag"] = f.tag
    if f.deprecated:
        out["deprecated"] = True
    if isinstance(f.type, Array) and f.type.size is not None:
        out["fixed_size"] = f.type.size
    if isinstance(f.type, Enum):
        out["members"] = {n: str(v) for n, v in f.type.members}
    return out


def fixed_size(t: Type) -> int | None:
    """Bytes of every value of the type on the wire, or None if they vary."""
    match t:
        case Scalar(kind):
            return SCALARS[kind][0] or None
        case Enum():
            return SCALARS[t.base][0]
        case Bytes(size):
            return size
        case Array(element, size) if size is not None and (each := fixed_size(element)) is not None:
            return each * size
        case Struct():
            sizes = [fixed_size(f.type) for f in t.fields]
            return None if None in sizes else sum(sizes)
    return None


def field_named(t: Type, name: str) -> Field | None:
    return next((f for f in t.fields if f.name == name), None)


@dataclass
class Registry:
    """Definitions by name, in an order in which each stands after what it uses."""

    definitions: dict[str, Type] = field(default_factory=dict)

    def add(self, *types: Type) -> "Registry":
        for t in types:
            if t.name in self.definitions and self.definitions[t.name] != t:
                raise SchemaError(f"{t.name} is defined twice")
            for used in references(t):
                self.definitions.setdefault(used.name, used)
            self.definitions.setdefault(t.name, t)
        return self

    def reachable(self, root: str) -> list[str]:
        used = {t.name for t in references(self.definitions[root])} | {root}
        return [n for n in self.definitions if n in used]


def references(t: Type) -> list[Type]:
    """Named definitions below ``t``, deepest first, without ``t``."""
    out: list[Type] = []

    def walk(x: Type, top: bool) -> None:
        match x:
            case Array(element):
                walk(element, False)
            case Map(_, value):
                walk(value, False)
            case Struct() | Message() | Union():
                for f in x.fields:
                    walk(f.type, False)
                if not top and x not in out:
                    out.append(x)
            case Enum():
                if not top and x not in out:
                    out.append(x)

    walk(t, True)
    return out
