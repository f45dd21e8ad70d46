"""Selection of markets, resolutions and upkeep of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions.categories import categorize_tags, primary_category
from oddsmill.operators.intervals import interval_join, with_next

#: Least volume of a market by category.
VOLUME_GATES = {"esports": 100_000.0}
DEFAULT_GATE = 1_000_000.0


def closed_market_qualifier(events: DataFrame) -> DataFrame:
    """Closed markets of closed events (slug, closed, tags, markets) over the gate of their category."""
    rows = events.where("closed").select("slug", "tags", F.explode("markets").alias("m")).select("slug", "tags", "m.*").withColumn("category", primary_category(F.col("tags")))
    gate = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in VOLUME_GATES.items()], F.lit(DEFAULT_GATE))
    return rows.where(F.col("closed") & (F.col("volume_usd") >= gate) & F.col("condition_id").isNotNull())


def exchange_qualifier(markets: DataFrame, floor: float = 10_000) -> DataFrame:
    return markets.where((F.col("market_type") == "binary") & F.col("result").isin("yes", "no") & (F.col("volume") >= floor) & F.col("status").isin("determined", "amended", "finalized"))


def play_money_qualifier(markets: DataFrame, floor: float = 1000) -> DataFrame:
    return markets.where(F.col("is_resolved") & (F.col("outcome_type") == "BINARY") & (F.col("volume") >= floor))


def work_queue(markets: DataFrame, limit: int) -> DataFrame:
    return markets.where("backfill_state in ('pending', 'in_progress', 'failed')").orderBy(F.desc("total_volume_usd"), F.desc("closed_at"), "condition_id").limit(limit)


def missing_tags(markets: DataFrame) -> DataFrame:
    return markets.where("tags_json = '[]'").orderBy(F.desc("closed_at"), "condition_id")


def refresh_tags(markets: DataFrame, event_tags: DataFrame) -> DataFrame:
    """Tags, categories and primary category by slug; an unknown slug is quarantined."""
    tags = event_tags.select("event_slug", F.col("tags").alias("_tags"))
    found = markets.drop("category", "categories_json", "tags_json").join(tags, "event_slug", "left")
    known = F.col("_tags").isNotNull()
    return found.withColumns(
        {
            "tags_json": F.when(known, F.to_json("_tags")).otherwise('["__ERROR__"]'),
            "categories_json": F.when(known, F.to_json(categorize_tags(F.col("_tags")))).otherwise("[]"),
            "category": F.when(known, primary_category(F.col("_tags"))),
        }
    ).drop("_tags")


def live_market_set(events: DataFrame, accepted: list[str], floor: float, n: int) -> DataFrame:
    rows = events.where(F.arrays_overlap(categorize_tags(F.col("tags")), F.array(*map(F.lit, accepted)))).select("slug", F.explode("markets").alias("m")).select("slug", "m.*")
    return rows.where(F.col("volume_usd") >= floor).orderBy(F.desc("volume_usd"), F.desc("condition_id")).limit(n)


def tick_universe(held: DataFrame, cache: DataFrame, floor: float, cap: int) -> DataFrame:
    """Assets that watched wallets hold come before those of markets with volume; each once, by asset."""
    every = held.select("asset_id", F.lit(0).alias("priority")).unionByName(cache.where(F.col("volume_usd") >= floor).select(F.explode("asset_ids").alias("asset_id"), F.lit(1).alias("priority")))
    return every.groupBy("asset_id").agg(F.min("priority").alias("priority")).orderBy("priority", "asset_id").limit(cap)


def whale_universe(markets: DataFrame, floor: float = 100, n: int = 2000) -> DataFrame:
    return markets.where(F.col("order_book") & (F.col("volume_usd") >= floor)).orderBy("condition_id").limit(n)


def truncated_markets(markets: DataFrame, trades: DataFrame) -> DataFrame:
    span = trades.groupBy("condition_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return markets.where("truncated_at_offset_cap = 1").join(span, "condition_id").orderBy(F.desc("total_volume_usd"), "condition_id")


def recent_wallets(first_seen: DataFrame, now: int, days: int) -> DataFrame:
    return first_seen.where(F.col("first_activity_at") >= now - days * 86_400).orderBy("first_activity_at", "wallet_address")


def roster(tracked: DataFrame, min_positions: int = 20, min_edge: float = 0.05, min_excess_pnl: float = 1000.0) -> DataFrame:
    """Wallets over all floors (inclusive; null is under), most profit first. Works by category as well."""
    return tracked.where((F.col("positions") >= min_positions) & (F.col("mean_edge") >= min_edge) & (F.col("excess_pnl_usd") >= min_excess_pnl)).orderBy(F.desc("excess_pnl_usd"), "wallet_address")


def resolve_by_price(markets: DataFrame, sure: float = 0.99) -> DataFrame:
    """The first outcome priced at ``sure`` or more wins; index 0 is YES; none: no row."""
    index = F.array_position(F.transform("outcome_prices", lambda p: p >= sure), True)
    return markets.withColumn("winning_outcome_index", (index - 1).cast("int")).where("winning_outcome_index >= 0").withColumn("outcome_yes_won", (F.col("winning_outcome_index") == 0).cast("int"))


def resolve_play_money(markets: DataFrame) -> DataFrame:
    return markets.where("resolution in ('YES', 'NO')").withColumn("outcome_yes_won", (F.col("resolution") == "YES").cast("int"))


def resolve_exchange(markets: DataFrame) -> DataFrame:
    return markets.where("status <> 'disputed' and result in ('yes', 'no')").withColumn("outcome_yes_won", (F.col("result") == "yes").cast("int"))


def missing_resolutions(markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    return markets.where("backfill_state = 'complete'").join(resolutions.select("platform", "condition_id"), ["platform", "condition_id"], "left_anti")


def repair_close_times(markets: DataFrame, trades: DataFrame) -> DataFrame:
    last = trades.groupBy("platform", "condition_id").agg(F.max("ts").alias("_last"))
    return markets.join(last, ["platform", "condition_id"], "left").withColumn("closed_at", F.coalesce("_last", "closed_at")).drop("_last")


def repair_resolution_times(resolutions: DataFrame, repaired: DataFrame) -> DataFrame:
    """Resolutions with the repaired closing time of their market as resolved_at."""
    closed = repaired.select("platform", "condition_id", F.col("closed_at").alias("_closed"))
    return resolutions.join(closed, ["platform", "condition_id"], "left").withColumn("resolved_at", F.coalesce("_closed", "resolved_at")).drop("_closed")


def refresh_truncation(markets: DataFrame, trades: DataFrame, enough: int = 3000) -> DataFrame:
    n = trades.groupBy("platform", "condition_id").agg(F.count("*").alias("trades_count"))
    out = markets.join(n, ["platform", "condition_id"], "left").withColumn("trades_count", F.coalesce("trades_count", F.lit(0)))
    return out.withColumn("truncated_at_offset_cap", F.when(F.col("trades_count") >= enough, 0).otherwise(F.col("truncated_at_offset_cap")))


def interpolate_blocks(points: DataFrame, anchors: DataFrame, unit: int = 3600) -> DataFrame:
    """``points`` (ts) with the block between the two anchors (ts, block) around it; clamped at both ends.

    The intervals between neighbouring anchors, of any length, meet the points in dyadic blocks of time; neighbours are found within days.
    """
    spans = with_next(anchors.select("ts", "block"), "ts", ["ts", "block"], 86_400).where("next_ts > ts")
    spans = spans.select((F.col("ts") + 1).alias("_lo"), F.col("next_ts").alias("_hi"), F.col("ts").alias("_t0"), F.col("block").alias("_b0"), F.col("next_block").alias("_b1"))
    ends = anchors.agg(F.min(F.struct("ts", "block")).alias("lo"), F.max(F.struct("ts", "block")).alias("hi"))  # one row
    p = points.join(F.broadcast(ends))
    before, behind = p.where("ts <= lo.ts or ts is null or lo is null"), p.where("ts >= hi.ts and ts > lo.ts")
    inside = interval_join(p.where("ts > lo.ts and ts < hi.ts"), spans, [], "ts", "_lo", "_hi", unit)
    between = F.floor(F.col("_b0") + (F.col("_b1") - F.col("_b0")) * (F.col("ts") - F.col("_t0")) / (F.col("_hi") - F.col("_t0")))
    parts = [before.withColumn("block", F.when(F.col("ts").isNotNull(), F.col("lo.block"))), behind.withColumn("block", F.col("hi.block")), inside.withColumn("block", between)]
    out = [x.select(*points.columns, F.col("block").cast("long").alias("block")) for x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def activity_bounds(trades: DataFrame) -> DataFrame:
    return trades.groupBy("wallet_address").agg(F.min("ts").alias("first_activity_at"), F.count("*").alias("total_trades"))
