"""32-bit numbers of method names (``/Service/Method``), in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash.
SEED, C1, C2, N, F1, F2 = 0x5AFE5EED, 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x7FEB352D, 0x846CA68B
_MASK = 0xFFFFFFFF


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _times(x: Column, c: int) -> Column:
    """The low 32 bits of a product, without leaving 64 bits."""
    low, high = c & 0xFFFF, c >> 16
    return _let(x, lambda v: _cut(v * low + F.shiftleft((v * high).bitwiseAND(F.lit(0xFFFF)), 16)))


def _turn(x: Column, n: int) -> Column:
    return _let(x, lambda v: _cut(F.shiftleft(v, n)).bitwiseOR(F.shiftright(v, 32 - n)))


def _spread(block: Column) -> Column:
    return _times(_turn(_times(block, C1), 15), C2)


def _fold(x: Column, n: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, n)))


def method_id(name: Column) -> Column:
    data = F.encode(name, "UTF-8")
    size = F.octet_length(data)

    def word(at: Column, width: Column) -> Column:
        """Little-endian number of up to four bytes from ``at``."""
        pairs = F.filter(F.split(F.hex(F.substring(data, at + 1, width)), "(?<=\\G..)"), lambda c: c != "")
        return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")

    blocks = F.when(size >= 4, F.sequence(F.lit(0), F.floor(size / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    body = F.aggregate(blocks, F.lit(SEED).cast("long"), lambda h, i: _cut(_times(_turn(h.bitwiseXOR(_spread(word(i * 4, F.lit(4)))), 13), 5) + N))
    left = size % 4
    tail = F.when(left > 0, body.bitwiseXOR(_spread(word(size - left, left)))).otherwise(body)
    return F.when(name.isNotNull(), _fold(_times(_fold(_times(_fold(tail, 16), F1), 15), F2), 16))
