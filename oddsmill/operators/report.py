"""Table queries: newest rows, latest row, counts, look-ups and a tolerant diff."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, key: Sequence[str], ts: str, n: int, ties: Sequence[str | Column] = ()) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(ts), *ties)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest_per_key(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """The row with the largest ``ts`` of each key, without a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(*key, "_r.*")


def counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n"))


def sweeps(df: DataFrame, ts: str = "snapshot_at") -> DataFrame:
    return df.agg(F.count_distinct(ts).alias("sweeps"))


def wallets_on_market(trades: DataFrame, condition_id: str, since: int) -> DataFrame:
    return trades.where((F.col("condition_id") == condition_id) & (F.col("ts") >= since)).select("wallet_address").distinct()


def high_deviation(history: DataFrame, floor: float, n: int) -> DataFrame:
    return history.where(F.abs("deviation") >= floor).orderBy(F.desc(F.abs("deviation")), "event_slug").limit(n)


def mids_in_window(ticks: DataFrame, asset_id: str, until: int, window_s: int) -> DataFrame:
    return ticks.where((F.col("asset_id") == asset_id) & (F.col("snapshot_at") > until - window_s) & (F.col("snapshot_at") <= until) & F.col("mid_price").isNotNull()).select("snapshot_at", "mid_price").orderBy("snapshot_at")


def listing(df: DataFrame, where: str | None = None, order: Iterable[str | Column] = (), n: int | None = None) -> DataFrame:
    """Filtered rows in order: liquid snapshots, active markets, watch lists, clusters, markets by status, bets by time."""
    out = df.where(where) if where else df
    out = out.orderBy(*order) if order else out
    return out if n is None else out.limit(n)


def lookup(df: DataFrame, **key) -> DataFrame:
    for k, v in key.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df


def in_time_window(trades: DataFrame, condition_id: str, lo: int, hi: int) -> DataFrame:
    return trades.where((F.col("condition_id") == condition_id) & F.col("ts").between(lo, hi))


def alert_summary(alerts: DataFrame, last: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), "alert_key").limit(last).groupBy("detector").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


def differing_ranges(left: DataFrame, right: DataFrame, key: Sequence[str], bits: tuple[int, ...] = (12, 20)) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides whose range of key hashes isn't the same on the other side.

    Each level cuts the hashes of keys into 2^bits ranges and compares their digests: a count and two sums over the hashes of whole rows, which
    combine before the shuffle. Only rows of ranges that differ go to the next, finer level; there are 2^bits ranges at most.
    """
    common = [*key, *[c for c in left.columns if c in right.columns and c not in key]]
    sides = [df.select(*common).withColumn("_h", F.shiftrightunsigned(F.xxhash64(*key), 64 - max(bits))) for df in (left, right)]
    for b in bits:
        each = []
        for name, df in zip(("_l", "_r"), sides, strict=True):
            of = F.xxhash64(*common)
            each.append(df.groupBy(F.shiftright("_h", max(bits) - b).alias("_range")).agg(F.struct(F.count("*"), F.bit_xor(of), F.sum(of.cast("decimal(38,0)"))).alias(name)))
        other = each[0].join(each[1], "_range", "full").where(~F.col("_l").eqNullSafe(F.col("_r"))).select("_range")
        sides = [df.withColumn("_range", F.shiftright("_h", max(bits) - b)).join(F.broadcast(other), "_range", "left_semi").drop("_range") for df in sides]
    return tuple(df.drop("_h") for df in sides)


def dataset_diff(left: DataFrame, right: DataFrame, key: Sequence[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """A row for each column with how many keys differ, and ``_only_left`` and ``_only_right`` for keys on one side.

    Numbers may differ by atol + rtol * |right|; null equals null, NaN equals NaN. Ranges of keys that are equal to the bit are told by
    their digests and not joined.
    """
    left, right = differing_ranges(left, right, key)
    common = [c for c in left.columns if c in right.columns and c not in key]
    kinds = dict(left.dtypes)
    a, b = left.select(*key, F.struct(*common).alias("_a")), right.select(*key, F.struct(*common).alias("_b"))
    both = a.join(b, list(key), "full")

    def differs(c: str) -> Column:
        x, y = F.col("_a")[c], F.col("_b")[c]
        if kinds[c] in ("double", "float"):
            same = x.eqNullSafe(y) | (F.abs(x - y) <= atol + rtol * F.abs(y))
        else:
            same = x.eqNullSafe(y)
        return F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.coalesce(same, F.lit(False)), 1))

    sums = both.agg(*[differs(c).alias(c) for c in common], F.count(F.when(F.col("_b").isNull(), 1)).alias("_only_left"), F.count(F.when(F.col("_a").isNull(), 1)).alias("_only_right"))
    return sums.select(F.explode(F.create_map(*[x for c in sums.columns for x in (F.lit(c), F.col(c))])).alias("column", "mismatches"))
