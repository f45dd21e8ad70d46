"""Joins of points with intervals of any length by equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dyadic_blocks(lo: Column, hi: Column) -> Column:
    """Blocks (level, block) that cover the whole numbers from ``lo`` to ``hi``, none twice: block b of a level holds the numbers
    n with n >> level = b. There are two for each level at most, so their number grows with the logarithm of the length."""
    struct = "struct<lo:long,hi:long,blocks:array<struct<level:int,block:long>>>"
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.array().cast("array<struct<level:int,block:long>>").alias("blocks")).cast(struct)

    def step(s: Column, level: Column) -> Column:
        left, right = s["lo"], s["hi"]
        open_ = left <= right
        first, last = open_ & (left.bitwiseAND(F.lit(1)) == 1), open_ & (right.bitwiseAND(F.lit(1)) == 0)
        one = lambda b: F.array(F.struct(level.alias("level"), b.alias("block")))
        none = F.array().cast("array<struct<level:int,block:long>>")
        blocks = F.concat(s["blocks"], F.when(first, one(left)).otherwise(none), F.when(last & ~(first & (left == right)), one(right)).otherwise(none))
        # What is left starts behind a block taken on the left and ends before one taken on the right.
        new_lo = F.when(open_, F.shiftright(F.when(first, left + 1).otherwise(left), 1)).otherwise(F.lit(1).cast("long"))
        new_hi = F.when(open_, F.shiftright(F.when(last, right - 1).otherwise(right), 1)).otherwise(F.lit(0).cast("long"))
        return F.struct(new_lo.alias("lo"), new_hi.alias("hi"), blocks.alias("blocks")).cast(struct)

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step)["blocks"]


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, unit: int = 3600) -> DataFrame:
    """``points`` with the ``intervals`` of their ``keys`` that hold them (``lo`` <= ``at`` <= ``hi``, whole numbers).

    An interval stands in its dyadic blocks of units, a point in its block of each level that any interval uses; both meet in equal keys and
    blocks, once, so a hot key is as many partitions as it has blocks. An interval without end points, or with ``hi`` < ``lo``, holds nothing.
    """
    at_, lo_, hi_ = (F.floor(F.col(c) / unit) for c in (at, lo, hi))
    cut = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(dyadic_blocks(lo_, hi_))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 63 at most
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    dealt = dealt.withColumn("_block", F.expr(f"shiftright(cast(floor({at} / {unit}) as bigint), _level)")).where(at_.isNotNull())
    met = dealt.join(cut, [*keys, "_level", "_block"]).where(F.col(at).between(F.col(lo), F.col(hi)))
    return met.drop("_level", "_block")


def with_next(df: DataFrame, at: str, columns: Sequence[str], bucket: int) -> DataFrame:
    """``df`` with ``next_<column>`` of the row after each in the order of ``at`` (null: none), found within buckets of ``at`` and, for a
    bucket's last row, from the first row of the next bucket that has one: a row for each bucket, not one task for all."""
    own = F.floor(F.col(at) / bucket)
    order = Window.partitionBy("_bucket").orderBy(at, *[c for c in columns if c != at])
    rows = df.withColumn("_bucket", own)
    head = F.struct(at, *[c for c in columns if c != at])
    firsts = rows.groupBy("_bucket").agg(F.min(head).alias("_first"))
    after = firsts.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_after"))
    near = rows.withColumn("_next", F.lead(head).over(order)).join(after, "_bucket")
    following = F.coalesce("_next", "_after")
    return near.select(*df.columns, *[following[c].alias(f"next_{c}") for c in columns])
