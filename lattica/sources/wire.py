"""Wire bytes of typed values: read and written in Arrow batches, for files and queues at an engine's edge.

Inside the engine values live in nested columns; the codec runs once where bytes come in or go out.
Numbers are little-endian. A value's bytes are read whole: what is left over, cut short or out of
range is an error, reported per row and never by failing the job unless asked.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..plans import types as T

_PLAIN = {"bool": "?", "byte": "B", "int8": "b", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float16": "e", "float32": "f", "float64": "d"}
#: Directory kinds of a message's index.
EMPTY, TINY, MASKS, BLOCKS = 0, (1, 2, 3), ((4, 1), (5, 2), (6, 4)), 7


#: Scalars whose bytes are their value: rows of them are read and written at once.
_NUMBERS = {k: c for k, c in _PLAIN.items() if k not in ("bool", "uint64")}


class WireError(ValueError):
    pass


@functools.cache
def _row(t: T.Type) -> tuple[struct.Struct, tuple[str, ...] | None] | None:
    """Layout and names of a struct of numbers, layout alone of a number; None for any other type."""
    match t:
        case T.Scalar(kind) if kind in _NUMBERS:
            return struct.Struct("<" + _NUMBERS[kind]), None
        case T.Enum():
            return _row(T.Scalar(t.base))
        case T.Struct() if t.fields and all(isinstance(f.type, T.Scalar) and f.type.kind in _NUMBERS for f in t.fields):
            return struct.Struct("<" + "".join(_NUMBERS[f.type.kind] for f in t.fields)), tuple(f.name for f in t.fields)
    return None


@functools.cache
def _by_tag(t: T.Message) -> dict[int, T.Field]:
    """The fields that are written, in the order of their tags."""
    return {f.tag: f for f in sorted(t.fields, key=lambda f: f.tag) if not f.deprecated}


def _write_rows(row: tuple[struct.Struct, tuple[str, ...] | None], values: list) -> bytes:
    layout, names = row
    if names is None:
        return struct.pack(f"<{len(values)}{layout.format[1:]}", *values)
    return b"".join([layout.pack(*[v[n] for n in names]) for v in values])


def _read_rows(row: tuple[struct.Struct, tuple[str, ...] | None], data: bytes) -> list:
    layout, names = row
    if names is None:
        return [v for (v,) in layout.iter_unpack(data)]
    return [dict(zip(names, v, strict=True)) for v in layout.iter_unpack(data)]


@functools.cache
def _layout(code: str) -> struct.Struct:
    return struct.Struct("<" + code)


class Reader:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise WireError("the value is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str):
        layout = _layout(code)
        return layout.unpack(self.take(layout.size))[0]

    def part(self, n: int) -> "Reader":
        if n < 0 or self.at + n > self.end:
            raise WireError("the value is cut short")
        self.at += n
        return Reader(self.data, self.at - n, self.at)

    def done(self) -> None:
        if self.at != self.end:
            raise WireError("bytes are left over")


def _write_scalar(kind: str, v) -> bytes:
    match kind:
        case "string":
            data = v.encode()
            return struct.pack("<I", len(data)) + data + b"\0"
        case "uuid":
            return uuid.UUID(v).bytes
        case "int128" | "uint128":
            return int(v).to_bytes(16, "little", signed=kind == "int128")
        case "timestamp":
            return struct.pack("<qii", v["s"], v["ns"], v["off_ms"])
        case "duration":
            return struct.pack("<qi", v["s"], v["ns"])
        case "bfloat16":
            bits = np.array([v], np.float32).view(np.uint32)[0]
            odd = (int(bits) >> 16) & 1
            return struct.pack("<H", 0x7FC0 if v != v else ((int(bits) + 0x7FFF + odd) >> 16) & 0xFFFF)
    return struct.pack("<" + _PLAIN[kind], int(v) if isinstance(v, Decimal) else v)


def _read_scalar(kind: str, r: Reader):
    match kind:
        case "bool":
            b = r.number("B")
            if b > 1:
                raise WireError("a truth value is 0 or 1")
            return bool(b)
        case "string":
            data = r.take(r.number("I"))
            if r.take(1) != b"\0":
                raise WireError("text doesn't end with a zero byte")
            try:
                return data.decode()
            except UnicodeDecodeError as e:
                raise WireError("text is not UTF-8") from e
        case "uuid":
            return str(uuid.UUID(bytes=r.take(16)))
        case "int128" | "uint128":
            return str(int.from_bytes(r.take(16), "little", signed=kind == "int128"))
        case "timestamp":
            s, ns, off = struct.unpack("<qii", r.take(16))
            if not 0 <= ns < 1_000_000_000:
                raise WireError("nanoseconds out of range")
            return {"s": s, "ns": ns, "off_ms": off}
        case "duration":
            s, ns = struct.unpack("<qi", r.take(12))
            if not -1_000_000_000 < ns < 1_000_000_000:
                raise WireError("nanoseconds out of range")
            return {"s": s, "ns": ns}
        case "bfloat16":
            return struct.unpack("<f", b"\0\0" + r.take(2))[0]
        case "uint64":
            return Decimal(r.number("Q"))
    return r.number(_PLAIN[kind])


def _index(tags: tuple[int, ...], ends: list[int]) -> bytes:
    """Boundaries, directory and control byte of fields with these ascending tags and payload ends."""
    if not tags:
        return bytes([EMPTY << 2])
    width = 0 if ends[-1] <= 0xFF else 1 if ends[-1] <= 0xFFFF else 2
    kind, directory = _directory(tags)
    return b"".join([e.to_bytes(1 << width, "little") for e in ends[:-1]]) + directory + bytes([kind << 2 | width])


@functools.cache
def _directory(tags: tuple[int, ...]) -> tuple[int, bytes]:
    blocks: dict[int, int] = {}
    for tag in tags:
        blocks[(tag - 1) // 32] = blocks.get((tag - 1) // 32, 0) | 1 << (tag - 1) % 32
    entries, rank = b"", 0
    for _, mask in sorted(blocks.items()):
        entries += bytes([rank]) + mask.to_bytes(4, "little")
        rank += mask.bit_count()
    kind, directory = BLOCKS, entries + bytes([sum(1 << b for b in blocks)])
    for code, size in MASKS:
        if tags[-1] <= 8 * size and size <= len(directory):
            kind, directory = code, sum(1 << (t - 1) for t in tags).to_bytes(size, "little")
            break
    if len(tags) <= 3 and len(tags) < len(directory):
        kind, directory = TINY[len(tags) - 1], bytes(tags)
    return kind, directory


def _split(r: Reader) -> list[tuple[int, Reader]]:
    """(tag, field) of a message's bytes after its length."""
    if r.end <= r.at:
        raise WireError("a message has no control byte")
    control = r.data[r.end - 1]
    width, kind = control & 3, control >> 2 & 7
    if control >> 5 or width == 3:
        raise WireError("bad control byte")
    end = r.end - 1
    if kind == EMPTY:
        if end != r.at:
            raise WireError("an empty directory has a payload")
        return []
    if kind in TINY:
        tags = list(r.data[end - kind : end])
        end -= kind
    elif kind == BLOCKS:
        present = r.data[end - 1]
        n = present.bit_count()
        start, rank, tags = end - 1 - 5 * n, 0, []
        if start < r.at:
            raise WireError("the value is cut short")
        for k, block in enumerate(b for b in range(8) if present >> b & 1):
            mask = int.from_bytes(r.data[start + 5 * k + 1 : start + 5 * k + 5], "little")
            if r.data[start + 5 * k] != rank or not mask or block == 7 and mask >> 31:
                raise WireError("bad directory")
            tags += [block * 32 + i + 1 for i in range(32) if mask >> i & 1]
            rank += mask.bit_count()
        end = start
    else:
        size = dict(MASKS)[kind]
        mask = int.from_bytes(r.data[end - size : end], "little")
        tags = [i + 1 for i in range(8 * size) if mask >> i & 1]
        end -= size
    if not tags or tags != sorted(set(tags)) or tags[0] < 1:
        raise WireError("bad directory")
    size = 1 << width
    first = end - size * (len(tags) - 1)
    if first < r.at:
        raise WireError("the value is cut short")
    bounds = [0, *(int.from_bytes(r.data[first + i * size : first + (i + 1) * size], "little") for i in range(len(tags) - 1)), first - r.at]
    if bounds != sorted(bounds):
        raise WireError("bad boundaries")
    return [(tag, Reader(r.data, r.at + a, r.at + b)) for tag, a, b in zip(tags, bounds, bounds[1:], strict=False)]


def encode(t: T.Type, v) -> bytes:
    match t:
        case T.Scalar(kind):
            return _write_scalar(kind, v)
        case T.Enum():
            return _write_scalar(t.base, v)
        case T.Bytes(size):
            return bytes(v) if size is not None else struct.pack("<I", len(v)) + bytes(v)
        case T.Array(element, size):
            if size is not None and len(v) != size:
                raise WireError(f"not {size} items")
            row = _row(element)
            items = _write_rows(row, v) if row else b"".join([encode(element, e) for e in v])
            return (b"" if size is not None else struct.pack("<I", len(v))) + items
        case T.Map(key, value):
            pairs = v.items() if isinstance(v, dict) else v
            return struct.pack("<I", len(v)) + b"".join(encode(key, k) + encode(value, e) for k, e in pairs)
        case T.Struct():
            return b"".join([encode(f.type, v[f.name]) for f in t.fields])
        case T.Message():
            fields = [(tag, encode(f.type, v[f.name])) for tag, f in _by_tag(t).items() if v.get(f.name) is not None]
            parts = [data for _, data in fields]
            parts.append(_index(tuple([tag for tag, _ in fields]), list(itertools.accumulate(map(len, parts)))))
            body = b"".join(parts)
            return struct.pack("<I", len(body)) + body
        case T.Union():
            f = next((f for f in t.fields if f.tag == v["disc"]), None)
            if f is None:
                raise WireError(f"unknown branch {v['disc']}")
            body = bytes([f.tag]) + encode(f.type, v[f.name])
            return struct.pack("<I", len(body)) + body
    raise WireError(f"not a type: {t!r}")


def _decode(t: T.Type, r: Reader, depth: int):
    if depth > T.MAX_DEPTH:
        raise WireError("too deep")
    match t:
        case T.Scalar(kind):
            return _read_scalar(kind, r)
        case T.Enum():
            return _read_scalar(t.base, r)
        case T.Bytes(size):
            return r.take(r.number("I") if size is None else size)
        case T.Array(element, size):
            n = r.number("I") if size is None else size
            if n > T.MAX_ITEMS:
                raise WireError("too many items")
            if row := _row(element):
                return _read_rows(row, r.take(n * row[0].size))
            return [_decode(element, r, depth + 1) for _ in range(n)]
        case T.Map(key, value):
            n = r.number("I")
            if n > T.MAX_ITEMS:
                raise WireError("too many entries")
            pairs = [(_decode(key, r, depth + 1), _decode(value, r, depth + 1)) for _ in range(n)]
            if len({k for k, _ in pairs}) < n:
                raise WireError("a key comes twice")
            return pairs
        case T.Struct():
            return {f.name: _decode(f.type, r, depth + 1) for f in t.fields}
        case T.Message():
            inner, by_tag = r.part(r.number("I")), _by_tag(t)
            out = dict.fromkeys(f.name for f in t.fields)
            for tag, part in _split(inner):
                if f := by_tag.get(tag):
                    out[f.name] = _decode(f.type, part, depth + 1)
                    part.done()
                elif t.closed:
                    raise WireError(f"{t.name} has a field {tag} that isn't declared, or goes deeper than declared")
            return out
        case T.Union():
            inner = r.part(r.number("I"))
            disc = inner.number("B")
            if disc == 0:
                raise WireError("discriminator 0")
            out = {"disc": disc} | dict.fromkeys(f.name for f in t.fields)
            if f := next((f for f in t.fields if f.tag == disc), None):
                out[f.name] = _decode(f.type, inner, depth + 1)
                inner.done()
            return out
    raise WireError(f"not a type: {t!r}")


def decode(t: T.Type, data: bytes):
    r = Reader(data)
    out = _decode(t, r, 0)
    r.done()
    return out


class _Slow(Exception):
    """The batch holds what only the codec by rows tells apart."""


#: Scalars that are written and read for a whole batch at once.
_AT_ONCE = {k: np.dtype("<" + c) for k, c in {"byte": "u1", "int8": "i1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "float32": "f4", "float64": "f8"}.items()}
#: Variable items of an array are read side by side for all rows, one item at a time; longer arrays are read by rows.
_MOST_STEPS = 256


@functools.cache
def _at_once(t: T.Type) -> bool:
    match t:
        case T.Scalar(kind):
            return kind in _AT_ONCE or kind == "string"
        case T.Enum():
            return t.base in _AT_ONCE
        case T.Array(element, None):
            return _at_once(element)
        case T.Struct() | T.Message():
            return bool(t.fields) and all(_at_once(f.type) for f in t.fields)
    return False


def _number(t: T.Type) -> np.dtype | None:
    return _AT_ONCE.get(t.base if isinstance(t, T.Enum) else t.kind if isinstance(t, T.Scalar) else None)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places from each start on, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class _Parts:
    """Bytes of many values, one after the other."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size

    @staticmethod
    def numbers(values: np.ndarray) -> "_Parts":
        return _Parts(np.ascontiguousarray(values).view(np.uint8), np.full(len(values), values.dtype.itemsize, np.int64))

    @staticmethod
    def side_by_side(parts: list["_Parts"]) -> "_Parts":
        size = functools.reduce(np.add, [p.size for p in parts])
        out, at = np.empty(int(size.sum()), np.uint8), np.cumsum(size) - size
        for p in parts:
            n = int(p.size[0]) if len(p.size) else 0
            if (p.size == n).all():
                out[at[:, None] + np.arange(n)] = p.data.reshape(len(at), n)
            else:
                out[_spread(at, p.size)] = p.data
            at = at + p.size
        return _Parts(out, size)


def _write_many(t: T.Type, values: pa.Array) -> _Parts:
    """The bytes of all values, none of which is null."""
    if values.null_count:
        raise _Slow
    if (kind := _number(t)) is not None:
        numbers = values.to_numpy(zero_copy_only=False)
        if kind.kind == "u" and len(numbers) and (numbers.min() < 0 or numbers.max() > np.iinfo(kind).max):
            raise _Slow
        return _Parts.numbers(numbers.astype(kind))
    if isinstance(t, T.Scalar):
        texts = values.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        size = np.diff(ends)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        if len(size) and size.max() > 0xFFFFFFFF:
            raise _Slow
        return _Parts.side_by_side([_Parts.numbers(size.astype("<u4")), _Parts(data, size), _Parts.numbers(np.zeros(len(size), np.uint8))])
    if isinstance(t, T.Array):
        counts = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        items = _write_many(t.element, values.flatten())
        ends = np.concatenate([[0], np.cumsum(items.size)])
        last = np.cumsum(counts)
        return _Parts.side_by_side([_Parts.numbers(counts.astype("<u4")), _Parts(items.data, ends[last] - ends[last - counts])])
    fields = dict(zip([f.name for f in t.fields], values.flatten(), strict=True))
    if isinstance(t, T.Struct):
        return _Parts.side_by_side([_write_many(f.type, fields[f.name]) for f in t.fields])
    return _write_messages(t, fields, len(values))


def _write_messages(t: T.Message, fields: dict[str, pa.Array], n: int) -> _Parts:
    by_tag = _by_tag(t)
    there = np.stack([pc.is_valid(fields[f.name]).to_numpy(zero_copy_only=False) for f in by_tag.values()], axis=1) if by_tag else np.zeros((n, 0), bool)
    parts = []
    for k, f in enumerate(by_tag.values()):
        made, size = _write_many(f.type, fields[f.name].drop_null()), np.zeros(n, np.int64)
        size[there[:, k]] = made.size
        parts.append(_Parts(made.data, size))
    ends = np.cumsum(np.stack([p.size for p in parts], axis=1), axis=1) if parts else np.zeros((n, 0), np.int64)
    total = ends[:, -1] if parts else np.zeros(n, np.int64)
    width = (total > 0xFF).astype(np.int64) + (total > 0xFFFF)
    shapes, which = np.unique(np.column_stack([there, width]), axis=0, return_inverse=True)
    which, tails, sizes = which.ravel(), [], np.zeros(n, np.int64)
    order = np.argsort(which, kind="stable")
    made: list[np.ndarray] = []
    for s, shape in enumerate(shapes):
        mine = order[np.searchsorted(which[order], s) : np.searchsorted(which[order], s, "right")]
        tags = tuple(tag for tag, here in zip(by_tag, shape[:-1], strict=True) if here)
        w = 1 << int(shape[-1])
        if tags:
            kind, directory = _directory(tags)
            end = directory + bytes([kind << 2 | int(shape[-1])])
            bounds = ends[mine][:, np.flatnonzero(shape[:-1])[:-1]].astype(f"<u{w}")
            tail = np.concatenate([np.ascontiguousarray(bounds).view(np.uint8).reshape(len(mine), -1), np.tile(np.frombuffer(end, np.uint8), (len(mine), 1))], axis=1)
        else:
            tail = np.full((len(mine), 1), EMPTY << 2, np.uint8)
        sizes[mine] = tail.shape[1]
        made.append(tail.ravel())
    # the tails stand shape by shape; they are put into the rows' order
    flat = np.concatenate([*made, np.zeros(0, np.uint8)])
    starts = np.empty(n, np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    tails = _Parts(flat[_spread(starts, sizes)], sizes)
    if n and int((total + sizes).max()) > 0xFFFFFFFF:
        raise _Slow
    return _Parts.side_by_side([_Parts.numbers((total + sizes).astype("<u4")), *parts, tails])


class _Found:
    """Bytes of many values that are read side by side; ``ok`` tells the rows for which nothing was odd, the others are read again by rows."""

    def __init__(self, data: np.ndarray, ok: np.ndarray):
        self.data, self.ok = data, ok

    def places(self, rows: np.ndarray, at: np.ndarray, end: np.ndarray, size) -> np.ndarray:
        """Where ``size`` bytes from ``at`` are; rows whose value is shorter are odd, and read from the start."""
        bad = at + size > end
        self.ok[rows[bad]] = False
        return np.where(bad, 0, at)

    def number(self, rows, at, end, kind: np.dtype) -> np.ndarray:
        at = self.places(rows, at, end, kind.itemsize)
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(kind.itemsize)]).view(kind).ravel()

    def refuse(self, rows: np.ndarray, bad: np.ndarray) -> None:
        self.ok[rows[bad]] = False


def _read_many(t: T.Type, kind: pa.DataType, r: _Found, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(values, where each ends) of the values at ``at`` of ``rows``."""
    if (number := _number(t)) is not None:
        return pa.array(r.number(rows, at, end, number)).cast(kind), at + number.itemsize
    if isinstance(t, T.Scalar):
        size = r.number(rows, at, end, np.dtype("<u4")).astype(np.int64)
        bad = at + 4 + size + 1 > end
        bad |= r.data[np.where(bad, 0, at + 4 + size)] != 0
        r.refuse(rows, bad)
        size = np.where(bad, 0, size)
        data = r.data[_spread(at + 4, size)]
        texts = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(data)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid as e:
            raise _Slow from e
        return texts.cast(kind), at + 5 + size
    if isinstance(t, T.Array):
        return _read_lists(t, kind, r, rows, at, end)
    if isinstance(t, T.Struct):
        columns = []
        for i, f in enumerate(t.fields):
            made, at = _read_many(f.type, kind.field(i).type, r, rows, at, end)
            columns.append(made)
        return pa.StructArray.from_arrays(columns, fields=list(kind)), at
    size = r.number(rows, at, end, np.dtype("<u4")).astype(np.int64)
    bad = (at + 4 + size > end) | (size < 1)
    r.refuse(rows, bad)
    at, stop = at + 4, np.where(bad, at + 4, at + 4 + size)
    return _read_messages(t, kind, r, rows, at, stop, ~bad), stop


def _read_lists(t: T.Array, kind: pa.DataType, r: _Found, rows, at, end) -> tuple[pa.Array, np.ndarray]:
    count = r.number(rows, at, end, np.dtype("<u4")).astype(np.int64)
    at = at + 4
    layout = _row(t.element)
    bad = (count > T.MAX_ITEMS) | (at + count * (layout[0].size if layout else 1) > end)
    if not layout:
        bad |= count > _MOST_STEPS
    r.refuse(rows, bad)
    count = np.where(bad, 0, count)
    ends = np.cumsum(count)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    if layout or not ends.size or not ends[-1]:
        size = layout[0].size if layout else 0
        where = np.repeat(at, count) + size * (np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - count, count))
        owner = np.repeat(np.arange(len(rows)), count)
        items, _ = _read_many(t.element, kind.value_type, r, rows[owner], where, end[owner])
        return pa.ListArray.from_arrays(offsets, items, type=kind), at + count * size
    # item by item for all rows that have so many, then in the rows' order
    made, owners, at = [], [], at.copy()
    for step in range(int(count.max())):
        mine = np.flatnonzero(count > step)
        items, at[mine] = _read_many(t.element, kind.value_type, r, rows[mine], np.where(r.ok[rows[mine]], at[mine], end[mine]), end[mine])
        made.append(items)
        owners.append(mine)
    order = np.argsort(np.concatenate(owners), kind="stable")
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays(made).take(pa.array(order)), type=kind), at


def _read_messages(t: T.Message, kind: pa.DataType, r: _Found, rows, at, end, ok) -> pa.Array:
    """Messages whose bytes are those from ``at`` to ``end``; rows with the same control byte and directory are split together."""
    n = len(rows)
    control = np.where(ok, r.data[np.where(ok, end - 1, 0)], 0xFF).astype(np.int64)
    long = np.array([{EMPTY: 0, **dict(zip(TINY, TINY, strict=True)), **dict(MASKS)}.get(c >> 2 & 7, -1) if not c >> 5 and c & 3 != 3 else -1 for c in range(256)], np.int64)[control]
    bad = (long < 0) | (end - 1 - long < at)
    r.refuse(rows, bad)
    directory = np.zeros(n, np.int64)
    for b in range(4):
        here = ~bad & (b < long)
        directory[here] |= r.data[end[here] - 1 - long[here] + b].astype(np.int64) << 8 * b
    shapes, which = np.unique(np.where(bad, -1, control << 32 | directory), return_inverse=True)
    first, last = (np.zeros((n, len(t.fields)), np.int64) for _ in "ab")
    there = np.zeros((n, len(t.fields)), bool)
    names = {f.tag: (i, f) for i, f in enumerate(t.fields) if not f.deprecated}
    for s, shape in enumerate(shapes.tolist()):
        if shape < 0:
            continue
        mine, c = np.flatnonzero(which == s), shape >> 32
        if c >> 2 & 7 == EMPTY:
            r.refuse(rows[mine], end[mine] - 1 != at[mine])
            continue
        raw = (shape & 0xFFFFFFFF).to_bytes(4, "little")
        tags = list(raw[: c >> 2 & 7]) if c >> 2 & 7 in TINY else [i + 1 for i in range(32) if (shape & 0xFFFFFFFF) >> i & 1]
        if not tags or tags != sorted(set(tags)) or tags[0] < 1 or t.closed and any(tag not in names for tag in tags):
            r.refuse(rows[mine], np.ones(len(mine), bool))
            continue
        w, k = 1 << (c & 3), len(tags) - 1
        stop = end[mine] - 1 - long[mine] - w * k
        short = stop < at[mine]
        r.refuse(rows[mine], short)
        mine, stop = mine[~short], stop[~short]
        inner = np.ascontiguousarray(r.data[stop[:, None] + np.arange(w * k)]).view(f"<u{w}").astype(np.int64).reshape(len(mine), k)
        bounds = np.column_stack([np.zeros(len(mine), np.int64), inner, stop - at[mine]])
        wrong = (np.diff(bounds, axis=1) < 0).any(axis=1)
        r.refuse(rows[mine], wrong)
        mine, bounds = mine[~wrong], bounds[~wrong]
        for j, tag in enumerate(tags):
            if tag in names:
                i = names[tag][0]
                first[mine, i], last[mine, i], there[mine, i] = at[mine] + bounds[:, j], at[mine] + bounds[:, j + 1], True
    columns = []
    for i, f in enumerate(t.fields):
        mine = np.flatnonzero(there[:, i])
        made, done = _read_many(f.type, kind.field(i).type, r, rows[mine], first[mine, i], last[mine, i])
        r.refuse(rows[mine], done != last[mine, i])
        if len(mine) < n:
            place = np.cumsum(there[:, i]) - 1
            made = made.take(pa.array(place, mask=~there[:, i]))
        columns.append(made)
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def _decoded(t: T.Type, kind: pa.DataType, column: pa.Array) -> tuple[pa.Array, np.ndarray] | None:
    """The values of a column of bytes (null where there are none) and the rows that are right; None if they must be read by rows."""
    if not _at_once(t) or not len(column):
        return None
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(data):
        return None
    ok = column.is_valid().to_numpy(zero_copy_only=False).copy()
    rows = np.flatnonzero(ok)
    r = _Found(np.concatenate([data, np.zeros(16, np.uint8)]), ok)
    try:
        made, done = _read_many(t, kind, r, rows, bounds[:-1][rows], bounds[1:][rows])
    except _Slow:
        return None
    r.refuse(rows, done != bounds[1:][rows])
    place = np.full(len(column), -1)
    place[rows] = np.arange(len(rows))
    return made.take(pa.array(place, mask=~ok)), ok


def _encoded(t: T.Type, column: pa.Array) -> pa.Array | None:
    """The bytes of a column of values, null for null; None if they must be written by rows."""
    if not _at_once(t):
        return None
    try:
        parts = _write_many(t, column.drop_null())
    except _Slow:
        return None
    size = np.zeros(len(column), np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    size[valid] = parts.size
    ends = np.concatenate([[0], np.cumsum(size)])
    if ends[-1] > 0x7FFFFFFF:
        return None
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(column), [bits, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(parts.data)])


def read_wire(df: DataFrame, column: str, t: T.Type, name: str = "value", strict: bool = False) -> DataFrame:
    """``df`` with the bytes of ``column`` as a typed column ``name`` and ``<name>_error`` (null if well); ``strict`` raises instead."""
    from pyspark.sql.pandas.types import to_arrow_type

    target = T.to_spark(t)
    arrow = to_arrow_type(target)
    schema = StructType([*df.schema.fields, StructField(name, target), StructField(f"{name}_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(column)
            quick = _decoded(t, arrow, data)
            odd = data if quick is None else data.filter(pa.array(~quick[1]))
            values, errors = [], []
            for one in odd.to_pylist():
                try:
                    values.append(None if one is None else decode(t, one))
                    errors.append(None)
                except (WireError, struct.error, IndexError) as e:
                    if strict:
                        raise
                    values.append(None)
                    errors.append(str(e))
            values, errors = pa.array(values, arrow), pa.array(errors, pa.string())
            if quick is not None:
                # the rows that were read at once, and in their places those that were read by themselves
                made, ok = quick
                place = np.cumsum(~ok) - 1
                errors = errors.take(pa.array(place, mask=ok))
                values = pa.concat_arrays([made, values]).take(pa.array(np.where(ok, np.arange(len(ok)), len(ok) + place))) if len(values) else made
            yield pa.record_batch([*batch.columns, values, errors], [*batch.schema.names, name, f"{name}_error"])

    return df.mapInArrow(run, schema)


def write_wire(df: DataFrame, column: str, t: T.Type, name: str = "wire") -> DataFrame:
    """``df`` with the bytes of the typed ``column`` as ``name``; null stays null."""
    schema = StructType([*df.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _encoded(t, batch.column(column))
            if made is None:
                made = pa.array([None if v is None else encode(t, v) for v in batch.column(column).to_pylist()], pa.binary())
            yield pa.record_batch([*batch.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, column: str, t: T.Type, name: str = "value") -> DataFrame:
    """``df`` with the bytes of ``column`` checked against the type and wrapped as they are: ``name`` struct<spec, payload>, null where they
    don't fit, and ``<name>_error``. Fields and branches that the type doesn't know stay in the payload."""
    read = read_wire(df, column, t, "_checked")
    whole = F.struct(F.lit(T.spec_of(t)).alias("spec"), F.col(column).alias("payload"))
    return read.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(column).isNotNull() & F.col("_checked_error").isNull(), whole).alias(name), F.col("_checked_error").alias(f"{name}_error"))


def spec(value) -> "F.Column":
    """The declaration that a wrapped value carries; ``plans.types.from_spec`` reads it."""
    return value["spec"]


def raw(value) -> "F.Column":
    """The wire bytes of a wrapped value, as they came."""
    return value["payload"]


def wire_size(t: T.Type, x) -> "F.Column":
    """Bytes of a value on the wire, as a column expression, for types without messages (their index depends on the sizes)."""
    fixed = T.fixed_size(t)
    if fixed is not None:
        return F.when(x.isNotNull(), F.lit(fixed)).cast("long")
    match t:
        case T.Scalar("string"):
            return (F.octet_length(x) + 5).cast("long")
        case T.Bytes():
            return (F.octet_length(x) + 4).cast("long")
        case T.Array(element, size):
            each = F.aggregate(F.transform(x, lambda e: wire_size(element, e)), F.lit(0).cast("long"), lambda a, n: a + n)
            return each + (4 if size is None else 0)
        case T.Map(key, value):
            return F.aggregate(F.transform(F.map_entries(x), lambda e: wire_size(key, e["key"]) + wire_size(value, e["value"])), F.lit(0).cast("long"), lambda a, n: a + n) + 4
        case T.Struct(_, fields):
            return sum((wire_size(f.type, x[f.name]) for f in fields), F.lit(0).cast("long"))
    raise T.SchemaError(f"{T.describe(t)} has no size that a column can tell")
