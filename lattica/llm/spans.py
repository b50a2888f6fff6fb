"""Where patterns match in a text, in DataFrame functions alone.

A span is struct<start int, end int, text string, before string>, in code points, end
exclusive, with the NEAR characters before it.
Positions come from the pieces between the matches: a regular expression that
splits a text finds the same matches as one that extracts them. Texts without
a match (nearly all) cost a single scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string,before:string>>"
#: Characters before a span that it keeps, and how many matches they can reach into (of five characters at least).
NEAR, REACH = 40, 8
_GROUP = 64
_FAR = 2**31 - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array what ``combine`` (associative, with ``zero``) makes of all items before it.

    Items are taken in groups, so that no array that grows is copied once for each item of a long one.
    """
    none = F.slice(F.array(zero), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["all"], x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))

    start = F.struct(zero.alias("all"), none.alias("out"))
    groups = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(_GROUP)), lambda at: F.aggregate(F.slice(a, at, _GROUP), start, step))

    def joined_up(done: Column) -> Column:
        tops = F.aggregate(F.transform(done, lambda g: g["all"]), start, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(done, tops, lambda g, top: F.transform(g["out"], lambda x: combine(top, x))))

    return F.when(F.size(a) > 0, _let(groups, joined_up)).otherwise(none)


def find(text: Column, pattern: str, present: Column | None = None) -> Column:
    """All leftmost non-overlapping matches. ``present``: a cheaper test that must hold where there is a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("m"), F.right(gap, F.lit(NEAR)).alias("tail")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)

        def before(x: Column, i: Column) -> Column:
            back = F.slice(p, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH)))
            earlier = F.array_join(F.transform(back, lambda y: F.concat(y["tail"], y["m"])), "")
            return F.when((x["gap"] >= NEAR) | (i == 0), x["tail"]).otherwise(F.right(F.concat(earlier, x["tail"]), F.lit(NEAR)))

        near = F.transform(p, before)
        with_end = F.zip_with(p, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["m"].alias("text")))
        return F.zip_with(with_end, near, lambda x, b: F.struct(x["start"], x["end"], x["text"], b.alias("before")))

    found = _let(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)
    test = text.rlike(pattern) if present is None else present & text.rlike(pattern)
    return F.when(test, found).otherwise(F.array().cast(SPANS))


def labelled(kinds: list[tuple[str, Column]]) -> Column:
    """Spans of several kinds as one array of struct<start, rank, kind, end, text>, by start, then in the order of ``kinds``."""

    def named(rank: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["text"].alias("text"))

    parts = [F.transform(c, named(i, k)) for i, (k, c) in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of each labelled span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def free_of(spans: Column, others: Column) -> Column:
    """The spans (start, end, text, ...) that share no character with any of ``others``, both by start."""
    start = lambda x, mine: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x["end"].alias("end"))
    merged = F.array_sort(F.concat(F.transform(others, lambda x: start(x, False)), F.transform(spans, lambda x: start(x, True))))

    def kept(m: Column) -> Column:
        ends = running(F.transform(m, lambda x: F.when(x["mine"], 0).otherwise(x["end"])), F.lit(0), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["mine"], _FAR).otherwise(x["start"]))), F.lit(_FAR), F.least))
        free = F.zip_with(F.zip_with(m, ends, lambda x, e: F.struct(x["mine"], x["end"], (e <= x["start"]).alias("after"))), starts, lambda x, s: F.struct(x["mine"], (x["after"] & (s >= x["end"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["mine"]), lambda x: x["free"])

    clear = F.zip_with(spans, _let(merged, kept), lambda x, ok: F.when(ok, x))
    return F.when(F.size(others) == 0, spans).otherwise(F.filter(clear, lambda x: x.isNotNull()))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each labelled span as [KIND]; of overlapping spans the first stands and the text it shares with the next goes too."""
    # characters of four bytes each, so that a piece is found without walking the text up to it
    wide = lambda x, a, n: F.decode(F.substring(x, a * 4 + 1, n * 4), "UTF-32")

    def made(x: Column) -> Column:
        def pieces(at: Column) -> Column:
            each = F.zip_with(spans, at, lambda s, done: F.when(s["start"] >= done, F.concat(wide(x, done, s["start"] - done), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            last = F.greatest(F.get(at, F.size(at) - 1), F.get(spans, F.size(spans) - 1)["end"])
            return F.concat(F.array_join(each, ""), wide(x, last, F.octet_length(x)))

        return _let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest), pieces)

    return F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), made)).otherwise(text)
