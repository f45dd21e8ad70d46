"""State of wallets and markets at a cut-off; ``fold`` has the same state kept by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.sources.tables import lanes

DAYS_30 = 30 * 86_400


def wallet_snapshot(trades: DataFrame, markets: DataFrame, resolutions: DataFrame, as_of: int) -> DataFrame:
    """Accumulators of each wallet over what was known before ``as_of``; open BUYs are kept to be settled later."""
    t, market = trades.where(F.col("ts") < as_of), F.concat("platform", F.lit("\0"), "condition_id").alias("_market")
    tasks = lanes(t.sparkSession, t.count())
    own, known, ends = t.select("*", market), markets.select(market, F.coalesce("category", F.lit("unknown")).alias("category")), resolutions.select(market, "outcome_yes_won", "resolved_at")
    own, known, ends = (df.repartition(tasks, "_market") for df in (own, known, ends))  # one shuffle of the trades for both joins
    t = own.join(known, "_market", "left").join(ends, "_market", "left").drop("_market")
    t = t.repartition(tasks, "wallet_address")  # lists and sums then start behind the shuffle: a list that is begun before it saves nothing
    buy = F.col("bs") == "BUY"
    done = buy & (F.col("resolved_at") >= F.col("ts")) & (F.col("resolved_at") < as_of)
    won = ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("long")
    own = t.groupBy("wallet_address").agg(
        F.count("*").alias("trades_count"), F.count(F.when(buy, 1)).alias("buys_count"), F.min("ts").alias("first_trade_ts"), F.max("ts").alias("last_trade_ts"),
        F.sum(F.when(buy, F.col("price")).otherwise(0.0)).alias("paid"), F.sum(F.when(buy, F.col("notional_usd")).otherwise(0.0)).alias("spent"),
        F.count(F.when(done, 1)).alias("resolved_buys"), F.coalesce(F.sum(F.when(done, won)), F.lit(0)).alias("wins"),
        F.coalesce(F.sum(F.when(done, F.when(won == 1, F.col("size")).otherwise(0.0) - F.col("notional_usd"))), F.lit(0.0)).alias("realized_pnl"),
        F.sort_array(F.collect_list(F.when(F.col("ts") >= as_of - DAYS_30, F.col("ts")))).alias("recent_ts"),
        F.collect_list(F.when(buy & ~F.coalesce(done, F.lit(False)), F.struct("condition_id", "outcome_side", "size", "notional_usd", "ts"))).alias("pending"),
    )
    n = t.where(buy).groupBy("wallet_address", "category").agg(F.count("*").alias("n")).groupBy("wallet_address").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("category_counts"))
    return own.join(n, "wallet_address", "left")


def market_snapshot(trades: DataFrame, as_of: int, prices: int = 20) -> DataFrame:
    t = trades.where(F.col("ts") < as_of)
    last = Window.partitionBy("condition_id").orderBy(F.desc("ts"), F.desc("tx_hash"), F.desc("asset_id"))
    recent = t.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= prices).groupBy("condition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "price"))), lambda x: x["price"]).alias("recent_prices"))
    own = t.groupBy("condition_id").agg(F.sum("notional_usd").alias("volume_usd"), F.count_distinct("wallet_address").alias("unique_traders"), F.max_by("price", F.struct("ts", "tx_hash", "asset_id")).alias("last_price"), F.min("ts").alias("first_ts"), F.count("*").alias("trades_count"))
    return own.join(recent, "condition_id", "left")


def settle_pending(wallets: DataFrame, resolutions: DataFrame, as_of: int) -> DataFrame:
    """wallet_address with the BUYs, wins and profit that resolutions before ``as_of`` add to its open BUYs."""
    p = wallets.select("wallet_address", F.explode("pending").alias("p")).select("wallet_address", "p.*").join(resolutions.select("condition_id", "outcome_yes_won", "resolved_at"), "condition_id")
    p = p.where((F.col("resolved_at") < as_of) & (F.col("resolved_at") >= F.col("ts")))
    won = ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("long")
    return p.groupBy("wallet_address").agg(F.count("*").alias("resolved_buys"), F.sum(won).alias("wins"), F.sum(F.when(won == 1, F.col("size")).otherwise(0.0) - F.col("notional_usd")).alias("realized_pnl"))


def warm_start(closed_positions: DataFrame, wallets: DataFrame) -> DataFrame:
    """State of wallets not seen yet from their closed positions: each is one BUY and its resolution."""
    fresh = closed_positions.join(wallets.select("wallet_address"), "wallet_address", "left_anti")
    cost = F.col("size") * F.col("avg_price")
    return fresh.groupBy("wallet_address").agg(F.count("*").alias("buys_count"), F.count("*").alias("resolved_buys"), F.sum("won").alias("wins"), F.sum("avg_price").alias("paid"), F.sum(cost).alias("spent"), F.sum("realized_pnl").alias("realized_pnl"))


def live_metadata(known: DataFrame, live: DataFrame) -> DataFrame:
    """Corpus metadata with that of open markets over it."""
    return known.join(live.select("condition_id"), "condition_id", "left_anti").unionByName(live, allowMissingColumns=True)


def stream_new_alerts(alerts: DataFrame, path: str, checkpoint: str, watermark: str = "1 day"):
    """Appends alerts (alert_key, created_at) whose key is new within the watermark."""
    timed = alerts.withColumn("event_time", F.timestamp_seconds("created_at")).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["alert_key"])
    return timed.drop("event_time").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
