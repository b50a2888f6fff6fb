"""Personal data in whole texts, in DataFrame functions alone.

Regular expressions propose spans; checks on the digits (parts of an address,
Luhn, mod-97, number of digits) confirm them; words close before a span raise its
score. The base kinds email, ip, card and phone hold whatever their score;
iban and ssn are added from a score of ``least`` on.

Defined results: null counts as empty; an empty text has no spans; every row
gives one row, repeated ones and null ids too; texts of any length are read whole, in
time that grows with their length and little more with their matches; an empty table gives no rows;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

#: Each pattern finds what the plain form in its comment finds, but never scans a run of characters from every one of them, nor recurses over it.
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# [0-9]([\x20-]?[0-9])+ of 12 digits at least
CARD = r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){11})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: (kind, score of a confirmed span, words that raise it)
KINDS = (
    ("email", 0.9, "mail|contact|write"),
    ("ip", 0.6, "ip|address|server|host|login"),
    ("card", 0.8, "card|visa|credit|payment|amex|mastercard"),
    ("phone", 0.7, "phone|call|tel|mobile|fax"),
    ("iban", 0.8, "iban|bank|account|konto"),
    ("ssn", 0.3, "ssn|social security|tax id|taxpayer"),
)
RAISE = 0.3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    d = F.reverse(F.split(_digits(text), ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(text: Column) -> Column:
    s = F.regexp_replace(text, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _scored(found: Column, base: float, words: str) -> Column:
    score = lambda x: F.when(F.lower(x["before"]).rlike(words), F.least(F.lit(1.0), F.lit(base + RAISE))).otherwise(F.lit(base))
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["text"], score(x).alias("score")))


def find_personal_data(docs: DataFrame, least: float = 0.5, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, text (null as empty), one array of confirmed spans per kind, and ``found``: all of them as labelled spans; and the columns to carry."""
    t = F.col("text")
    out = docs.select("doc_id", F.coalesce(t, F.lit("")).alias("text"), *carry)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    hits = {
        "email": spans.find(t, EMAIL, F.instr(t, "@") > 0),
        "ip": F.filter(spans.find(t, IP), lambda x: x["text"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": F.filter(spans.find(t, CARD), lambda x: _between(F.length(_digits(x["text"])), 12, 19) & _luhn(x["text"])),
        "phone": F.filter(spans.find(t, PHONE, F.instr(t, "+") > 0), lambda x: _between(F.length(_digits(x["text"])), 9, 15)),
        "iban": F.filter(spans.find(t, IBAN), lambda x: _mod97(x["text"])),
        "ssn": spans.find(t, SSN, F.instr(t, "-") > 0),
    }
    out = out.withColumns(hits)
    out = out.withColumns({k: _scored(F.col(k), base, words) for k, base, words in KINDS})
    out = out.withColumns({k: F.filter(k, lambda x: x["score"] >= least) for k in ("iban", "ssn")})
    return out.withColumn("found", spans.labelled([(k, F.col(k)) for k, _, _ in KINDS]))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with each span of its texts as [KIND] and n_chars to match; rows without a span stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = find_personal_data(docs, least, (whole,))
    made = found.select("_row", F.when(F.col("_row.text").isNotNull(), spans.replaced(F.col("text"), F.col("found"))).alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text").cast("long"), F.lit(0))}
    return made.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
