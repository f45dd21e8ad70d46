"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ranks(upper: bool) -> dict[str, Column]:
    """The places (from 0) of the values whose mean is the median."""
    hi = F.floor(F.col("n") / 2)
    return {"hi": hi} if upper else {"lo": F.floor((F.col("n") - 1) / 2), "hi": hi}


def grouped_medians(df: DataFrame, keys: Sequence[str], value: str, write, upper: bool = False, most: int = 100_000, bins: int = 256) -> DataFrame:
    """``keys``, n, median of the values (not null) of each group; ``upper`` takes the upper of two middle values, else their mean.

    Groups of up to ``most`` values are sorted in a task. For larger ones the place of the median is narrowed down by histograms: each round counts
    values in ``bins`` bins of the range that is left, in turn even in the values and in their logarithms, takes the bin with the wanted place and its own smallest and largest value as the next
    range, until these are equal or ``most`` values are left. Counts combine before the shuffle, so a round of a hot group moves its bins. Large
    groups are no more than the rows divided by ``most``. NaN counts as larger than all.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    large = write(sizes.where(F.col("n") > most), "median-groups")
    middle = F.sort_array(F.collect_list("_v"))
    at = lambda place: F.element_at(middle, (place + 1).cast("int"))
    n = F.count("*")
    own = at(F.floor(n / 2)) if upper else (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    if large.isEmpty():
        return rows.groupBy(*keys).agg(n.alias("n"), own.alias("median"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    on = lambda a, b: _all(same(a, b))
    small = rows.alias("r").join(F.broadcast(large.alias("l")), on("r", "l"), "left_anti").groupBy(*keys).agg(n.alias("n"), own.alias("median"))

    places = [large.select(*keys, F.lit(k).alias("_part"), "n", place.cast("long").alias("_place"), "_from", "_to", F.col("n").alias("_left")) for k, place in enumerate(_ranks(upper).values())]
    asked = places[0] if upper else places[0].unionByName(places[1])  # the wanted places of each large group, counted from _from on
    own, found, log = [*keys, "_part", "n", "_place"], [], False
    hit = "struct<_bin:bigint,_c:bigint,_from:double,_to:double>"
    while True:
        is_done = (F.col("_from") == F.col("_to")) | (F.col("_left") <= most)
        found.append(asked.where(is_done))
        asked = asked.where(~is_done)
        if asked.isEmpty():
            break
        met = rows.alias("r").join(F.broadcast(asked.alias("l")), on("r", "l")).where(F.col("_v").between(F.col("_from"), F.col("_to")))
        v, lo, hi = (_by_size(F.col(c)) if log else F.col(c) for c in ("_v", "_from", "_to"))
        share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, as the range itself may be too large for a double
        k = F.when(F.isnan("_v"), bins + 1).when(F.col("_v") == float("inf"), bins).when(F.col("_v") == float("-inf"), -1).otherwise(F.coalesce(F.when((hi > lo) & share.between(0, 1), F.least(F.floor(share * bins), F.lit(bins - 1))), F.lit(0)))
        counts = met.select(*[F.col(f"r.{c}").alias(c) for c in keys], *own[len(keys) :], "_v", k.cast("long").alias("_bin")).groupBy(*own, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        per = counts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_bin", "_c", "_from", "_to"))).alias("_bins"))
        step = F.aggregate(
            "_bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(hit).alias("hit"), F.lit(0).cast("long").alias("before")),
            lambda s, b: F.struct((s["seen"] + b["_c"]).alias("seen"), F.coalesce(s["hit"], F.when(s["seen"] + b["_c"] > F.col("_place"), b.cast(hit))).alias("hit"), F.when(s["hit"].isNull(), s["seen"]).otherwise(s["before"]).alias("before")),
        )
        asked = write(per.withColumn("_s", step).select(*keys, "_part", "n", (F.col("_place") - F.col("_s.before")).alias("_place"), F.col("_s.hit._from").alias("_from"), F.col("_s.hit._to").alias("_to"), F.col("_s.hit._c").alias("_left")), "median-ranges")
        log = not log
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    parts = write(parts, "median-places")
    left = rows.alias("r").join(F.broadcast(parts.where("_from <> _to").alias("l")), on("r", "l")).where(F.col("_v").between(F.col("_from"), F.col("_to")))
    sorted_ = left.groupBy(*[F.col(f"r.{c}").alias(c) for c in keys], "n", "_part", "_place").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    values = sorted_.select(*keys, "n", F.element_at("_s", (F.col("_place") + 1).cast("int")).alias("_x")).unionByName(parts.where("_from = _to").select(*keys, "n", F.col("_from").alias("_x")))
    return small.unionByName(values.groupBy(*keys, "n").agg(F.avg("_x").alias("median")))


def _by_size(v: Column) -> Column:
    """Grows with ``v``, evenly in its logarithm on both sides of 0."""
    return F.signum(v) * (F.coalesce(F.log(F.when(v != 0, F.abs(v))), F.lit(0.0)) + 746)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
