"""Rows for the parts of a typed value: its direct children or all descendants, depth first."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, sums_before
from ..functions.jsontext import to_json
from ..functions.values import Typed, rendered
from ..plans import types as T
from ..plans.paths import parse


@dataclass(frozen=True)
class _Slot:
    """A node at a fixed place in its scope: the scope's value itself, then the fields of its structs, but no items."""

    type: T.Type
    steps: tuple[str, ...]
    over: int

    def of(self, x: Column) -> Column:
        for name in self.steps:
            x = x[name]
        return x

    @property
    def suffix(self) -> str:
        return "".join("." + json.dumps(name) for name in self.steps)


def _inner(t: T.Type) -> T.Type | None:
    """The type of the items, if there can be any."""
    match t:
        case T.Array(element):
            return element
        case T.Map(_, value):
            return value
        case T.Bytes():
            return T.Scalar("byte")
    return None


def _text(t: T.Type, x: Column) -> Column:
    if isinstance(t, T.Bytes):
        return F.hex(x)
    return to_json(Typed(x, t)) if T.is_container(t) else rendered(t, x).cast("string")


def _total(counts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, counts, F.lit(0))


def _known(x: Column) -> Column:
    return x.isNotNull().cast("int")


@dataclass(frozen=True)
class _Scope:
    """A value, or an item of one: the nodes that each such value has, in order."""

    type: T.Type
    levels: int
    slots: tuple[_Slot, ...]

    def lists(self) -> list[int]:
        """The slots whose items are nodes."""
        return [i for i, s in enumerate(self.slots) if _inner(s.type) is not None and len(s.steps) + 1 < self.levels]

    @property
    def counted(self) -> int:
        """How many lists, from the first, have slots after them."""
        return sum(slot < len(self.slots) - 1 for slot in self.lists())

    def below(self, slot: int) -> tuple[T.Type, int]:
        return _inner(self.slots[slot].type), self.levels - len(self.slots[slot].steps) - 1

    def present(self, x: Column, before: int) -> Column:
        """How many of the first slots there are."""
        return _total([_known(s.of(x)) for s in self.slots[:before]])


@functools.cache
def _scope(t: T.Type, levels: int) -> _Scope:
    slots: list[_Slot] = []

    def walk(u: T.Type, steps: tuple[str, ...], over: int) -> None:
        at = len(slots)
        slots.append(_Slot(u, steps, over))
        if isinstance(u, T.Struct | T.Message | T.Union) and len(steps) + 1 < levels:
            for f in u.fields:
                walk(f.type, (*steps, f.name), at)

    walk(t, (), -1)
    return _Scope(t, levels, tuple(slots))


def _scopes(t: T.Type, levels: int) -> list[_Scope]:
    """All scopes of a type, from the outside in."""
    out = [_scope(t, levels)]
    for s in out:
        out += [n for n in dict.fromkeys(_scope(*s.below(i)) for i in s.lists()) if n not in out]
    return out


def _items(t: T.Type, x: Column, make: Callable[[Column, Column, Column, Column], Column], full: Column) -> Column:
    """``make`` of each item with its number, key and full key."""

    def indexed(i: Column) -> Column:
        return F.concat(full, F.lit("["), i.cast("string"), F.lit("]"))

    match t:
        case T.Array():
            return F.transform(x, lambda e, i: make(e, i, i.cast("string"), indexed(i)))
        case T.Bytes():
            size = F.octet_length(x)
            at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: make(F.conv(F.hex(F.substring(x, i + 1, F.lit(1))), 16, 10).cast("smallint"), i, i.cast("string"), indexed(i)))

    def entry(e: Column, i: Column) -> Column:
        k = rendered(t.key, e["key"])
        if t.key.kind in ("bool", "uuid"):
            at = F.lit(None).cast("string")
        elif t.key.kind == "string":
            at = F.concat(full, F.lit("."), F.get(F.split(F.to_json(F.struct(k.alias("x"))), '^\\{"x":'), F.lit(1)))
            at = F.substring(at, F.lit(1), F.length(at) - 1)
        else:
            at = F.concat(full, F.lit("["), k.cast("string"), F.lit("]"))
        return make(e["value"], i, k.cast("string"), at)

    return F.transform(F.map_entries(x), entry)


def _count(s: _Scope, x: Column) -> Column:
    """Nodes of a scope and all below it."""
    return _total([s.present(x, len(s.slots)), *[_below(s, i, x) for i in s.lists()]])


def _counts(s: _Scope, slot: int, x: Column) -> Column:
    """The count of each item of a slot."""
    t, inner = s.slots[slot].type, _scope(*s.below(slot))
    return _items(t, s.slots[slot].of(x), lambda e, *_: _count(inner, e), F.lit("")) if not isinstance(t, T.Map) else F.transform(F.map_values(s.slots[slot].of(x)), lambda e: _count(inner, e))


def _below(s: _Scope, slot: int, x: Column) -> Column:
    return F.coalesce(F.aggregate(_counts(s, slot, x), F.lit(0), lambda a, n: a + n), F.lit(0))


def _record(scopes: list[_Scope], s: _Scope, x: Column, at: Column, parent: Column, key: Column, full: Column, path: Column, before: list[Column]) -> Column:
    values = [(x if o is s else F.lit(None)).cast(T.to_spark(o.type)).alias(f"v{n}") for n, o in enumerate(scopes)]
    return F.struct(F.lit(scopes.index(s)).alias("code"), at.alias("id"), parent.alias("parent"), key.alias("key"), full.alias("fullkey"), path.alias("path"), F.array(*before).cast("array<int>").alias("before"), *values)


def _records(scopes: list[_Scope], s: _Scope, x: Column, at: Column, parent: Column, key: Column, full: Column, path: Column) -> Column:
    """A record for the scope, whose first node is number ``at``, and one for each scope below it. A scope that isn't there has one without nodes."""
    lists = s.lists()
    if not lists:
        return F.array(_record(scopes, s, x, at, parent, key, full, path, []))

    def made(sizes: Column | None) -> Column:
        sums = [_total([F.get(sizes, F.lit(j)) for j in range(k)]) for k in range(s.counted + 1)]
        own = F.array(_record(scopes, s, x, at, parent, key, full, path, sums[1:]))
        return F.flatten(F.array(own, *[under(i, at + s.present(x, i) + n) for i, n in zip(lists, sums, strict=False)]))

    def under(slot: int, node: Column) -> Column:
        t, inner = s.slots[slot].type, _scope(*s.below(slot))
        here = F.concat(full, F.lit(s.slots[slot].suffix))

        def listed(starts: Column, node: Column, here: Column) -> Column:
            if inner.lists():
                return F.flatten(_items(t, s.slots[slot].of(x), lambda e, i, k, f: _records(scopes, inner, e, node + 1 + F.get(starts, i), node, k, f, here), here))
            return _items(t, s.slots[slot].of(x), lambda e, i, k, f: _record(scopes, inner, e, node + 1 + F.get(starts, i), node, k, f, here, []), here)

        made = let(F.struct(let(_counts(s, slot, x), sums_before).alias("starts"), node.alias("node"), here.alias("here")), lambda l: listed(l["starts"], l["node"], l["here"]))
        return F.coalesce(made, F.slice(F.array(_nothing(scopes)), 1, 0))

    return let(F.array(*[_below(s, i, x) for i in lists[: s.counted]]), made) if s.counted else made(None)


def _nothing(scopes: list[_Scope]) -> Column:
    nothing = {"code": "int", "id": "int", "parent": "int", "key": "string", "fullkey": "string", "path": "string", "before": "array<int>"}
    return F.struct(*[F.lit(None).cast(k).alias(n) for n, k in nothing.items()], *[F.lit(None).cast(T.to_spark(o.type)).alias(f"v{n}") for n, o in enumerate(scopes)])


def _rows(df: DataFrame, value: Typed, path: str, keep: list[str], levels: int) -> DataFrame:
    """Rows of nodes in two steps. A value becomes one record for each scope, which knows only where it starts; a record then
    becomes its nodes, whose columns are made last, so that what isn't asked for costs nothing."""
    at = value.get(path)
    names = ["key", "value", "atom", "kind", "type", "id", "parent", "fullkey", "path"]
    if at is None:
        kinds = ["string"] * 5 + ["int", "int", "string", "string"]
        return df.filter("false").select(*keep, *[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])
    full = F.lit(path if parse(path) else "$")
    scopes = _scopes(at.type, levels)
    # children only: the value itself is no row, but a scalar is
    hidden = levels == 2 and T.is_container(at.type)
    none = F.lit(None).cast("string")
    records = _records(scopes, scopes[0], at.column, F.lit(0), F.lit(None).cast("int"), none, full, full)
    made = df.select(*keep, F.when(at.column.isNotNull(), records).alias("_records"))
    # outer, as Spark would otherwise work the records out a second time to leave out rows that have none; those have no nodes below
    one = made.select(*keep, F.explode_outer("_records").alias("_r"))
    r = F.col("_r")
    numbers, slots = {}, []
    for n, s in enumerate(scopes):
        for i, slot in enumerate(s.slots):
            numbers[n, i] = len(slots)
            slots.append((n, s, i, slot))

    def by_code(make: Callable[[int, _Scope], Column]) -> Column:
        return functools.reduce(lambda out, n: out.when(r["code"] == n, make(n, scopes[n])), range(1, len(scopes)), F.when(r["code"] == 0, make(0, scopes[0])))

    present = by_code(lambda n, s: F.array(*[F.when(slot.of(r[f"v{n}"]).isNotNull(), numbers[n, i]).otherwise(-1) for i, slot in enumerate(s.slots)]))
    nodes = one.select(*keep, "_r", F.posexplode(F.array_remove(present, -1)).alias("_nth", "_slot"))
    if hidden:
        nodes = nodes.filter(F.col("_slot") != 0)
    g = F.col("_slot")

    def fixed(values: list, kind: str) -> Column:
        return F.get(F.lit(values).cast(f"array<{kind}>"), g)

    def chosen(pairs: list[tuple[int, Column]], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for k, x in reversed(pairs):
            out = F.when(g == k, x).otherwise(out)
        return out

    def items_before(s: _Scope, i: int) -> Column:
        k = sum(slot < i for slot in s.lists())
        return F.get(r["before"], F.lit(k - 1)) if k else F.lit(0)

    more = [(numbers[n, i], items_before(s, i)) for n, s, i, _ in slots if any(slot < i for slot in s.lists())]
    own = r["id"] + F.col("_nth") + (F.coalesce(chosen(more, "int"), F.lit(0)) if more else F.lit(0))
    parents: dict[tuple[int, int], list[int]] = {}
    for n, _, i, slot in slots:
        if slot.over > 0:
            parents.setdefault((n, slot.over), []).append(numbers[n, i])
    over = F.when(fixed([slot.over < 0 for *_, slot in slots], "boolean"), r["parent"])
    for (n, p), below in parents.items():
        over = over.when(g.isin(below), r["id"] + scopes[n].present(r[f"v{n}"], p) + items_before(scopes[n], p))
    over = over.otherwise(r["id"])
    tops = fixed([slot.over < 0 for *_, slot in slots], "boolean")
    texts = [(numbers[n, i], slot.type, slot.of(r[f"v{n}"])) for n, _, i, slot in slots]
    columns = {
        "key": F.when(tops, r["key"]).otherwise(fixed([slot.steps[-1] if slot.steps else None for *_, slot in slots], "string")),
        "value": chosen([(k, _text(t, x)) for k, t, x in texts], "string"),
        "atom": chosen([(k, _text(t, x)) for k, t, x in texts if not T.is_container(t)], "string"),
        "kind": fixed([T.kind_of(slot.type) for *_, slot in slots], "string"),
        "type": fixed([T.describe(slot.type) for *_, slot in slots], "string"),
        "id": own,
        "parent": F.lit(None).cast("int") if hidden else over,
        "fullkey": F.concat(r["fullkey"], fixed([slot.suffix for *_, slot in slots], "string")),
        "path": F.when(tops, r["path"]).otherwise(F.concat(r["fullkey"], fixed([s.slots[slot.over].suffix if slot.over >= 0 else "" for _, s, _, slot in slots], "string"))),
    }
    return nodes.select(*keep, *[columns[n].alias(n) for n in names])


def each(df: DataFrame, value: Typed, path: str = "$", keep: list[str] | None = None) -> DataFrame:
    """A row per direct child of the value at the path; a scalar is its own row. Nothing for null or absent."""
    return _rows(df, value, path, keep or [], 2)


def tree(df: DataFrame, value: Typed, path: str = "$", keep: list[str] | None = None) -> DataFrame:
    """The value at the path, then all its descendants, depth first."""
    return _rows(df, value, path, keep or [], T.MAX_DEPTH + 1)
