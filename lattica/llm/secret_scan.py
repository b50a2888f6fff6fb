"""Secrets in whole texts, in DataFrame functions alone.

Three base patterns (assign, access, hex) hold as they are. A battery of
randomness tests adds spans of kind ``random``: long runs of encoding
characters, each judged in the smallest alphabet it fits (digits, hex, base32,
base36, base62, base64): chi-squared uniformity, runs above and below the
alphabet's middle, lag-1 serial correlation. A run passes if none of the three
rejects randomness, with the level split among them. Passing runs are then
tested against ordinary text: the likelihood ratio of the uniform alphabet to
letter frequencies bounds the p-value, so longer runs can reach smaller ones,
and Benjamini-Hochberg with weights by length controls the share of false
finds among a document's runs. Runs that touch a base span add nothing.

Defined results: null counts as empty; an empty text has no spans; every row
gives one row, repeated ones and null ids too; runs with equal p-values are found in the
order of the text; texts of any length are read whole, in time that grows with their length
and little more with their matches; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of too few characters of these two has no part with enough of them, so the bounds may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
BASE_KINDS = ("assign", "access", "hex")
#: (characters, alphabet); the first that fits is taken. Base64 holds both of its usual pairs of signs.
ALPHABETS = (
    ("[0-9]+", "0123456789"),
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[A-Z2-7]+", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (".+", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
#: Classes of ordinary text's characters and each character's share.
COMMON, MIDDLE, RARE = ("etaoinshr", 0.075), ("dlucmfwgyp", 0.026), ("bvkxjqz", 0.008)
DIGIT, UPPER, SIGN = 0.008, 0.004, 0.012
REJECT_RANDOM, FALSE_SHARE = 0.001, 0.01


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (rational approximation of erfc, to 1e-7)."""
    x = F.abs(z) / 2**0.5
    k = 1 / (1 + 0.3275911 * x)
    upper = 0.5 * k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _sum(a: Column, f) -> Column:
    return F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, x: s + x)


def _keep(x: Column, *names: str) -> list[Column]:
    return [x[n].alias(n) for n in ("start", "end", "text", *names)]


# A run is measured in steps, each over what the step before has worked out, so no sum is ever inside another.


def _coded(run: Column) -> Column:
    """The run without padding, its length, its letters' codes and its alphabet's size."""
    body = F.regexp_replace(run["text"], "=+$", "")
    alphabet = F.coalesce(*[F.when(body.rlike(f"^{fit}$"), F.lit(a)) for fit, a in ALPHABETS])
    single_case = ~(body.rlike("[a-z]") & body.rlike("[A-Z]"))
    return F.struct(*_keep(run), F.length(body).cast("double").alias("n"), F.split(body, "").alias("letters"), F.split(F.when(single_case, F.lower(body)).otherwise(body), "").alias("folded"), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"))


def _numbered(x: Column) -> Column:
    alphabet = x["alphabet"]
    codes = F.transform(x["letters"], lambda c: F.instr(alphabet, c).cast("double"))
    each = F.transform(F.split(alphabet, ""), lambda c: F.size(F.filter(x["letters"], lambda d: d == c)).cast("double"))
    return F.struct(*_keep(x, "n", "size", "folded"), codes.alias("codes"), each.alias("counts"))


def _shifted(a: Column) -> tuple[Column, Column]:
    return F.slice(a, 2, F.size(a)), F.slice(a, 1, F.size(a) - 1)


def _summed(x: Column) -> Column:
    size, codes = x["size"], x["codes"]
    high = F.transform(codes, lambda c: F.when(c > size / 2, 1.0).otherwise(0.0))
    turns = F.zip_with(*_shifted(codes), lambda a, b: F.when((a > size / 2) != (b > size / 2), 1.0).otherwise(0.0))
    products = F.zip_with(*_shifted(codes), lambda a, b: a * b)
    sums = {"squares": _sum(x["counts"], lambda o: o * o), "high": _sum(high, lambda h: h), "turns": _sum(turns, lambda d: d), "total": _sum(codes, lambda c: c), "power": _sum(codes, lambda c: c * c), "lagged": _sum(products, lambda d: d)}
    ratio = _sum(x["folded"], lambda c: -F.log(size * _share(c, size)))
    return F.struct(*_keep(x, "n", "size"), *[v.alias(k) for k, v in sums.items()], ratio.alias("ratio"), F.get(codes, F.lit(0)).alias("first"), F.element_at(codes, -1).alias("last"))


def _share(c: Column, size: Column) -> Column:
    letters = F.when(c.rlike(f"[{COMMON[0]}]"), COMMON[1]).when(c.rlike(f"[{MIDDLE[0]}]"), MIDDLE[1]).when(c.rlike(f"[{RARE[0]}]"), RARE[1])
    return letters.when(c.rlike("[0-9]"), F.when(size == 10, 0.1).otherwise(DIGIT)).when(c.rlike("[A-Z]"), UPPER).otherwise(SIGN)


def _scored(x: Column) -> Column:
    n, df = x["n"], x["size"] - 1
    chi = x["size"] / n * x["squares"] - n
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    low = n - x["high"]
    mean = 2 * x["high"] * low / n + 1
    z_runs = F.when((x["high"] == 0) | (low == 0), F.lit(9.0)).otherwise((x["turns"] + 1 - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))
    middle = x["total"] / n
    spread = x["power"] - n * middle * middle
    # the lagged products less the middle, each sum lacking one end
    lag = x["lagged"] - middle * (2 * x["total"] - x["first"] - x["last"]) + (n - 1) * middle * middle
    z_serial = F.when(spread <= 1e-9, F.lit(9.0)).otherwise((lag / spread + 1 / n) * F.sqrt(n))
    return F.struct(*_keep(x, "n", "ratio"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"))


def _judged(x: Column) -> Column:
    p_random = F.least(F.lit(1.0), 3 * F.least(_tail(x["z_chi"]), 2 * _tail(F.abs(x["z_runs"])), 2 * _tail(F.abs(x["z_serial"]))))
    return F.struct(*_keep(x, "n"), p_random.alias("p_random"), F.exp(-F.greatest(x["ratio"], F.lit(0.0))).alias("p_text"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), an array of spans per base kind and ``random``, ``base`` and ``found`` (with random): labelled spans."""
    t = F.col("text")
    out = docs.select("doc_id", F.coalesce(t, F.lit("")).alias("text"))
    out = out.withColumns({
        "assign": F.filter(spans.find(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 6),
        "access": spans.find(t, ACCESS, F.instr(t, "AKIA") > 0),
        "hex": spans.find(t, HEX),
        "runs": spans.find(t, RUN),
    })
    out = out.withColumn("base", spans.labelled([(k, F.col(k)) for k in BASE_KINDS]))
    out = out.withColumn("runs", spans.free_of(F.col("runs"), F.col("base")))
    for step in (_coded, _numbered, _summed, _scored, _judged):
        out = out.withColumn("runs", F.transform("runs", step))
    out = out.withColumn("mean", _sum(F.col("runs"), lambda x: x["n"]) / F.greatest(F.size("runs"), F.lit(1)))
    ranked = F.array_sort(F.transform(F.filter("runs", lambda x: x["p_random"] >= REJECT_RANDOM), lambda x: F.struct((x["p_text"] * F.col("mean") / x["n"]).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))
    out = out.withColumn("ranked", ranked)
    # the last rank whose p-value is within its share; all up to it are finds
    last = F.aggregate(F.transform("ranked", lambda x, i: F.when(x["p"] <= FALSE_SHARE * (i + 1) / F.size("runs"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    out = out.withColumn("last", last)
    finds = F.transform(F.slice("ranked", F.lit(1), F.col("last")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    out = out.withColumn("random", finds)
    found = F.array_sort(F.concat("base", F.transform("random", lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE_KINDS)).alias("rank"), F.lit("random").alias("kind"), x["end"].alias("end"), x["text"].alias("text")))))
    return out.select("doc_id", "text", *BASE_KINDS, "random", "base", found.alias("found"))
