"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens. DataFrame functions only.

A token of 20 or more characters whose alphabet is that of an encoding (hexadecimal, base 32, base 36, base 64)
is tested for uniform use of the alphabet (chi-squared over five bins), for runs above and below the middle, and
for correlation between neighbours; Fisher's method combines the three. A token may be random if that p-value is ``least_random`` or more.

Whether it is reported is a test of the other hypothesis, that the token is structured: made of words, of words and numbers, or of
capitals. The largest p-value of chi-squared tests against the bins' shares in such tokens is that of the hypothesis. Among tokens of
a length class, over all documents, the Benjamini-Hochberg rule finds the tokens that are not structured, so that it is the share of
structured tokens among those reported that is controlled, at any length. Its thresholds come from a histogram of p-values, a few hundred
rows whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm._shared import materialise, table

# The base patterns and their kinds, in the order of ties.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs are maximal, so the least length may stand in the pattern
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

# Alphabets in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Bins of each alphabet, by which prose differs from random text: vowels, frequent consonants, other letters, capitals, digits and signs.
BINS = {
    "hex": ("0123", "456", "789", "ace", "bdf"),
    "base32": ("AEIOU", "TNSRHLDCM", "BFGJKP", "QVWXYZ", "234567"),
    "base36": ("aeiou", "tnsrhldcm", "bfgjkp", "qvwxyz", "0123456789"),
    "base64": ("aeiou", "tnsrhldcm", "bfgjkpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/"),
}
# Shares of the bins in tokens of words, of words and numbers, and of capitals or digits alone.
STRUCTURED = {
    "hex": ((0.45, 0.25, 0.26, 0.02, 0.02), (0.05, 0.03, 0.02, 0.55, 0.35), (0.25, 0.15, 0.15, 0.27, 0.18)),
    "base32": ((0.37, 0.45, 0.11, 0.05, 0.02), (0.29, 0.35, 0.09, 0.04, 0.23), (0.11, 0.14, 0.04, 0.02, 0.69)),
    "base36": ((0.37, 0.45, 0.11, 0.05, 0.02), (0.29, 0.35, 0.09, 0.04, 0.23), (0.11, 0.14, 0.04, 0.02, 0.69)),
    "base64": ((0.33, 0.40, 0.15, 0.10, 0.02), (0.25, 0.32, 0.12, 0.08, 0.23), (0.02, 0.02, 0.02, 0.74, 0.20)),
}
_SPAN = "struct<start:bigint,kind:int,end:bigint,body:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that don't overlap: array of (start, kind, end, body), in code points.

    ``split`` gives what lies between the matches, so their places are running sums of lengths. Sums run within lots of 64
    matches and over the lots, so that arrays that grow stay short.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda m, g: F.struct(F.length(g).cast("long").alias("gap"), m.alias("body")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["body"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["body"].alias("body"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def run(pairs):
        lots = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / 64).cast("int") - 1), lambda k: F.slice(pairs, k * 64 + 1, F.lit(64)))
        sums = F.aggregate(lots, F.array(F.lit(0).cast("long")), lambda acc, lot: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(lot, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + F.length(x["body"])))))
        return F.flatten(F.zip_with(lots, F.slice(sums, F.lit(1), F.size(lots)), lambda lot, at: F.aggregate(lot, F.struct(at.alias("at"), F.expr(_NONE).alias("spans")), step)["spans"]))

    return F.when(text.rlike(pattern), F.transform(F.array(pairs), run)[0]).otherwise(F.expr(_NONE))


def base_spans(text: Column) -> Column:
    """All spans of the base patterns, by start and kind."""
    assign = F.filter(found(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2)))


def encoding(token: Column) -> Column:
    """The encoding whose alphabet the token uses, with letters and digits both, or with capitals after small letters; else null."""
    digit, upper, lower = token.rlike("[0-9]"), token.rlike("[A-Z]"), token.rlike("[a-z]")
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & digit & (upper | lower), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$") & digit, "base32")
        .when(token.rlike("^[a-z0-9]+$") & digit & lower, "base36")
        .when((digit & upper & lower) | token.rlike("[a-z][A-Z]"), "base64")
    )


def chi_squared_tail(x: Column, df: int) -> Column:
    """P(X >= x) for an even number of degrees of freedom, which has a closed form."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the normal distribution, by a Chebyshev fit of the complementary error function: relative error under 2e-7 in the
    tails as well."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + x / 2)
    fit = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + fit))


def battery(token: Column, kind: Column) -> Column:
    """uniform, runs, serial: p-values under the hypothesis that the token is uniformly random in its encoding; random: those combined;
    structured: the p-value of the hypothesis that it is structured."""
    text = F.regexp_replace(F.when(kind == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/")), "=+$", "")
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), kind)
    size = F.length(alphabet).cast("double")

    def by_kind(values: dict[str, list]) -> Column:
        return F.element_at(F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]), kind)

    bins = by_kind({k: list(v) for k, v in BINS.items()})
    even = by_kind({k: [len(x) / len(ALPHABETS[k]) for x in v] for k, v in BINS.items()})
    shares = [by_kind({k: list(v[j]) for k, v in STRUCTURED.items()}) for j in range(3)]

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        counts = F.transform(bins, lambda b: n - F.length(F.call_function("translate", text, b, F.lit(""))))  # whatever is no value of the alphabet is in no bin

        def chi(expected: Column) -> Column:
            return chi_squared_tail(F.aggregate(F.zip_with(counts, expected, lambda o, e: F.pow(o - n * e, F.lit(2.0)) / (n * e)), F.lit(0.0), lambda a, x: a + x), 4)

        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        high = F.size(F.filter(v, lambda x: x * 2 >= size)).cast("double")
        low = n - high
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v) - 1).alias("b"))
        turns = 1 + F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= size) != (p["b"] * 2 >= size))).cast("double")
        expected = 1 + 2 * high * low / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, two_sided((turns - expected) / F.sqrt(spread))).otherwise(F.lit(1e-9))
        power = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        serial = F.when(power > 0, two_sided(lagged / power * F.sqrt(n))).otherwise(F.lit(1e-9))
        uniform = chi(even)
        logs = sum((F.ln(F.greatest(F.lit(1e-300), p)) for p in (uniform, runs, serial)), F.lit(0.0))
        return F.struct(uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), chi_squared_tail(-2 * logs, 6).alias("random"), F.greatest(*[chi(x) for x in shares]).alias("structured"))

    values = F.transform(F.split(text, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return F.transform(F.array(F.filter(values, lambda x: x >= 0)), tests)[0]


def length_class(token: Column) -> Column:
    n = F.length(token)
    return F.when(n < 32, 0).when(n < 64, 1).otherwise(2)


def _log_bin(p: Column) -> Column:
    """The bin of a p-value, one for each twentieth of a power of ten; 1e-30 and less are one."""
    return F.ceil(20 * F.log10(F.greatest(F.lit(1e-30), p))).cast("int")


def _scanned(docs: DataFrame, carried: list[str], false_discoveries: float, least_random: float) -> DataFrame:
    """row (struct of the columns ``carried``), base_spans and spans of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.filter(
        F.transform(found(text, TOKEN, 3), lambda s: F.struct(s["start"], s["kind"], s["end"], s["body"], encoding(s["body"]).alias("encoding"))),
        lambda s: s["encoding"].isNotNull(),
    )
    measured = F.transform(tokens, lambda s: F.struct(s["start"], s["kind"], s["end"], s["body"], length_class(s["body"]).alias("length_class"), battery(s["body"], s["encoding"]).alias("p")))
    tested = F.transform(measured, lambda s: F.struct(s["start"], s["kind"], s["end"], s["body"], s["length_class"], _log_bin(s["p"]["structured"]).alias("bin"), (s["p"]["random"] >= least_random).alias("random")))
    rows = materialise(docs.select(F.struct(*carried).alias("row"), base_spans(text).alias("base_spans"), tested.alias("tested")), "secrets")
    # Benjamini and Hochberg: the largest p-value at most q times its rank over the number of tokens, in each class.
    bins = rows.select(F.explode("tested").alias("t")).groupBy(F.col("t.length_class").alias("length_class"), F.col("t.bin").alias("bin")).count()
    inside = Window.partitionBy("length_class")
    ranked = bins.withColumn("rank", F.sum("count").over(inside.orderBy("bin"))).withColumn("all", F.sum("count").over(inside))
    cuts = ranked.where(F.pow(F.lit(10.0), F.col("bin") / 20) <= false_discoveries * F.col("rank") / F.col("all")).groupBy("length_class").agg(F.max("bin").alias("bin"))
    most = {r["length_class"]: r["bin"] for r in cuts.collect()}  # three rows at most
    cut = F.array(*[F.lit(most.get(k, -(1 << 20))) for k in range(3)])
    random = F.transform(F.filter("tested", lambda t: t["random"] & (t["bin"] <= F.element_at(cut, t["length_class"] + 1))), lambda t: F.struct(t["start"], t["kind"], t["end"], t["body"]))
    apart = F.filter(random, lambda t: ~F.exists("base_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("row", "base_spans", F.array_sort(F.concat("base_spans", apart)).alias("spans"))


def scan(docs: DataFrame, false_discoveries: float = 0.05, least_random: float = 0.001, carried: list[str] | None = None) -> DataFrame:
    """``docs`` (text, any other columns) with ``base_spans`` and ``spans``: arrays of (start, kind, end, body).

    A null or empty text has no spans; every row of repeated rows gets its own; the two columns take the place of any of
    that name; ``carried`` names the columns to return, all if None; an empty table gives no rows. Whole texts are read, once.
    """
    kept = [c for c in (docs.columns if carried is None else carried) if c not in ("base_spans", "spans")]
    return _scanned(docs, kept, false_discoveries, least_random).select("row.*", "base_spans", "spans")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [count(kind) for kind in range(3)]
    return scanned.select("doc_id", *n, F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, false_discoveries: float = 0.05, least_random: float = 0.001) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in brackets; other texts stay as they are.

    Overlapping spans are replaced as one, by the kind of the first. All columns stay, whatever their names; null texts stay null,
    repeated rows are each redacted, and an empty table gives no rows.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col("row")["text"].cast("string")

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    return _scanned(docs, docs.columns, false_discoveries, least_random).select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), carried=["doc_id"]))
