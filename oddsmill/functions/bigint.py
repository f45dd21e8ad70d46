"""256-bit integers as decimal text, by arithmetic on limbs in column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, DIGITS = 7, 9


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hex_to_decimal(word: Column) -> Column:
    """The decimal text of 64 hexadecimal digits; null if the word is null or anything else.

    Numbers of 60 bits are converted as they are, those of 124 bits in two parts. Any other number is a sum of limbs of ``WIDTH`` hexadecimal
    digits times powers of two; each power is known in base 10^``DIGITS``, so a digit of the result is a sum of products that fit a long,
    and a carry from the digit below it.
    """
    part = lambda w, at, n: F.conv(F.substring(w, at, n), 16, 10)
    two = lambda w: ((part(w, 34, 15).cast("decimal(19,0)") * F.lit(Decimal(2**64))).cast("decimal(38,0)") + part(w, 49, 16).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")

    def number(w: Column) -> Column:
        return F.when(w.startswith("0" * 49), part(w, 50, 15)).when(w.startswith("0" * 33), two(w)).otherwise(_long_number(w, part))

    return _let(word, lambda w: F.when(w.rlike("^[0-9a-fA-F]{64}$"), number(w)))


def _long_number(w: Column, part) -> Column:
    n, base = -(-64 // WIDTH), 10**DIGITS
    limbs = F.array(*[part(w, max(1, 65 - WIDTH * (i + 1)), min(WIDTH, 64 - WIDTH * i)).cast("long") for i in range(n)])
    powers = [[16 ** (WIDTH * i) // base**k % base for i in range(n)] for k in range(9)]  # 81 digits
    long = lambda v: F.lit(v).cast("long")
    sums = lambda x: F.array(*[sum((x[i] * long(p) for i, p in enumerate(row) if p), long(0)) for row in powers])

    def digit(s: Column, x: Column) -> Column:
        return _let(s["carry"] + x, lambda t: F.struct(F.call_function("div", t, long(base)).alias("carry"), F.concat(F.lpad((t % base).cast("string"), DIGITS, "0"), s["text"]).alias("text")))

    text = F.aggregate(_let(limbs, sums), F.struct(long(0).alias("carry"), F.lit("").alias("text")), digit)["text"]
    return F.regexp_replace(text, "^0+(?=.)", "")
