"""Domain tables derived from the star schema, each with its SQL twin.

A view function takes (spark, sf_dir); ``SQL`` has the same views as common table expressions in the order of their
dependence, and ``with_views`` puts them before a query. Tables with a row for each market are merged in joins: their files look small enough to
broadcast, which the driver's memory would then have to grow with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.operators.ingest import first_write_wins
from oddsmill.sources.tables import built_once, lanes

TRADE_KEY = ("platform", "tx_hash", "asset_id", "wallet_address")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str):
    return F.expr(f"cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) as bigint)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, built once a session and state of the tables: most queries read them several times."""
    return built_once(spark, f"trades {sf_dir}", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders")], lambda: _trades(spark, sf_dir))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the wallet of their order, each key once. A key names its order, so the shuffle of the join serves the choice of a key's first
    line too; lines cross it as numbers and become texts after it. Its tasks grow in number with the lines."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    no, buy = F.col("l_returnflag") == "A", (F.col("l_linestatus") == "O") | (F.col("l_returnflag") == "R")
    lines = lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.coalesce(no, F.lit(False)).alias("no"), F.when(buy, "BUY").otherwise("SELL").alias("bs"), (F.lit(0.05) + 9 * F.col("l_discount")).alias("price"),
        F.col("l_quantity").alias("size"), _epoch("l_shipdate").alias("ts"),
    )
    n = lanes(spark, lines.count())
    raw = lines.repartition(n, "l_orderkey").hint("merge").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = first_write_wins(raw, ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "no", "o_custkey"], ["ts", "size", "price", "bs"])
    side = F.when(F.col("no"), "NO").otherwise("YES")
    return first.select(
        F.lit("polymarket").alias("platform"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("tx_hash"),
        F.concat_ws(":", F.col("l_partkey").cast("string"), side).alias("asset_id"),
        F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("wallet_address"),
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("condition_id"),
        side.alias("outcome_side"),
        "bs",
        "price",
        "size",
        (F.col("price") * F.col("size")).alias("notional_usd"),
        "ts",
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"PROMO": "sports", "ECONOMY": "esports", "MEDIUM": "crypto", "SMALL": "tech", "LARGE": "macro"}
    category = F.expr("case split_part(p_type, ' ', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in kinds.items()) + " end")
    per_market = trades(spark, sf_dir).groupBy("condition_id").agg(F.max("ts").alias("closed_at"), F.sum("notional_usd").alias("total_volume_usd"), F.count("*").alias("trades_pulled_count"))
    part = _table(spark, sf_dir, "part").select(
        F.lit("polymarket").alias("platform"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("condition_id"),
        F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("event_slug"),
        category.alias("category"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('["'), F.coalesce(category, F.lit("thesis")), F.lit('","thesis"]'))).otherwise("[]").alias("categories_json"),
        F.lit("complete").alias("backfill_state"),
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
    )
    return part.hint("merge").join(per_market.hint("merge"), "condition_id", "left").hint("merge")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = trades(spark, sf_dir).groupBy("condition_id").agg(F.max("ts").alias("last_ts"))
    key = F.substring("condition_id", 2, 20).cast("long")
    return last.where(key % 10 != 0).select(F.lit("polymarket").alias("platform"), "condition_id", (key % 2).cast("int").alias("outcome_yes_won"), (F.col("last_ts") - 365 * 86400).alias("resolved_at")).hint("merge")


def event_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of an event with a YES price and a label; events of one market are left out."""
    event = Window.partitionBy("p_brand", "p_size")
    part = _table(spark, sf_dir, "part").withColumn("total", F.sum("p_retailprice").over(event)).withColumn("n", F.count("*").over(event)).where("n > 1")
    label = F.expr(
        "case when p_partkey % 4 = 0 then concat('Above ', p_partkey % 50 * 10, 'K') when p_partkey % 4 = 1 then concat('2025-', lpad(cast(p_partkey % 12 + 1 as string), 2, '0'), '-15') "
        "when p_partkey % 8 = 2 then concat('March ', p_partkey % 28 + 1, ', 2026') when p_partkey % 8 = 6 then concat('Sept. ', p_partkey % 28 + 1, 'th, 2026 at noon') "
        "when p_partkey % 16 = 3 then concat('≤ $', p_partkey % 9 + 1, ',500') when p_partkey % 16 = 11 then concat('under ', p_partkey % 9 + 1, '.5 k per day') when p_partkey % 16 = 7 then concat('by March ', p_partkey % 28 + 1, ', 2026') else p_name end"
    )
    return part.select(
        F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("event_slug"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("condition_id"),
        F.col("p_partkey").alias("position"), (F.col("p_retailprice") / F.col("total") * (1 + (F.col("p_partkey") % 7 - 3) * 0.03)).alias("yes_price"), label.alias("label"),
        (F.col("p_retailprice") * 20).alias("liquidity_usd"), F.lit(True).alias("order_book"),
    )


def market_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("condition_id"), F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("event_slug"),
        (F.col("p_retailprice") * 20).alias("liquidity_usd"), (F.col("p_retailprice") * 500).alias("volume_usd"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        F.array(F.concat(F.col("p_partkey").cast("string"), F.lit(":YES")), F.concat(F.col("p_partkey").cast("string"), F.lit(":NO"))).alias("asset_ids"),
        F.array(F.col("p_partkey") % 19 * 0.05 + 0.05, 1 - (F.col("p_partkey") % 19 * 0.05 + 0.05)).alias("outcome_prices"),
        (F.col("p_partkey") % 3 != 0).alias("active"),
    ).hint("merge")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("asset_id"), _epoch("ts").alias("snapshot_at"), F.col("value").alias("mid_price"), (F.lit(1.0) + F.col("event_id") % 7).alias("spread"),
        (F.lit(10.0) + F.col("event_id") % 50).alias("bid_depth_top5"), (F.lit(10.0) + F.col("event_id") % 37).alias("ask_depth_top5"), "event_id",
    )
    return first_write_wins(raw, ["asset_id", "snapshot_at"], ["event_id"])


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oddsmill.operators.corpus import activity_bounds

    return activity_bounds(trades(spark, sf_dir))


def closed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUYs of resolved markets by (wallet, market, side): size, average price, profit and whether they won."""
    won = ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("int")
    bought, ends = trades(spark, sf_dir).where("bs = 'BUY'"), resolutions(spark, sf_dir).select("condition_id", "outcome_yes_won")
    n = lanes(spark, bought.count())
    bought = bought.repartition(n, "condition_id").join(ends.repartition(n, "condition_id").hint("merge"), "condition_id")
    own = bought.withColumn("won", won).groupBy("wallet_address", "condition_id", "outcome_side", "won").agg(F.sum("size").alias("size"), F.sum("notional_usd").alias("notional"))
    return own.select("wallet_address", "condition_id", "outcome_side", "won", "size", (F.col("notional") / F.col("size")).alias("avg_price"), (F.when(F.col("won") == 1, F.col("size")).otherwise(0.0) - F.col("notional")).alias("realized_pnl"), F.when(F.col("won") == 1, F.col("size")).otherwise(0.0).alias("current_value"))


SQL = {
    "trades": """select * exclude (k) from (
      select *, row_number() over (partition by platform, tx_hash, asset_id, wallet_address order by ts, size, price, bs) as k from (
        select distinct 'polymarket' as platform, l_orderkey || '-' || l_linenumber || '-' || l_suppkey as tx_hash,
          l_partkey || ':' || case when l_returnflag = 'A' then 'NO' else 'YES' end as asset_id, 'w' || o_custkey as wallet_address, 'm' || l_partkey as condition_id,
          case when l_returnflag = 'A' then 'NO' else 'YES' end as outcome_side, case when l_linestatus = 'O' or l_returnflag = 'R' then 'BUY' else 'SELL' end as bs,
          cast(0.05 as double) + 9 * l_discount as price, l_quantity as size, (cast(0.05 as double) + 9 * l_discount) * l_quantity as notional_usd, cast(epoch(l_shipdate) as bigint) as ts
        from lineitem join orders on l_orderkey = o_orderkey)) where k = 1""",
    "per_market": "select condition_id, max(ts) as closed_at, sum(notional_usd) as total_volume_usd, count(*) as trades_pulled_count from trades group by condition_id",
    "typed": "select *, case split_part(p_type, ' ', 1) when 'PROMO' then 'sports' when 'ECONOMY' then 'esports' when 'MEDIUM' then 'crypto' when 'SMALL' then 'tech' when 'LARGE' then 'macro' end as category from part",
    "markets": """select 'polymarket' as platform, 'm' || p_partkey as condition_id, p_brand || '-' || p_size as event_slug, category,
      case when p_partkey % 5 = 0 then '["' || coalesce(category, 'thesis') || '","thesis"]' else '[]' end as categories_json, 'complete' as backfill_state,
      p_partkey, p_name, p_brand, p_size, p_retailprice, closed_at, total_volume_usd, trades_pulled_count from typed left join per_market on condition_id = 'm' || p_partkey""",
    "resolutions": """select 'polymarket' as platform, condition_id, cast(cast(substr(condition_id, 2) as bigint) % 2 as int) as outcome_yes_won, closed_at - 365 * 86400 as resolved_at
      from per_market where cast(substr(condition_id, 2) as bigint) % 10 <> 0""",
    "event_markets": """select p_brand || '-' || p_size as event_slug, 'm' || p_partkey as condition_id, p_partkey as position,
      p_retailprice / total * (1 + (p_partkey % 7 - 3) * cast(0.03 as double)) as yes_price,
      case when p_partkey % 4 = 0 then 'Above ' || (p_partkey % 50 * 10) || 'K' when p_partkey % 4 = 1 then '2025-' || lpad(cast(p_partkey % 12 + 1 as varchar), 2, '0') || '-15'
        when p_partkey % 8 = 2 then 'March ' || (p_partkey % 28 + 1) || ', 2026' when p_partkey % 8 = 6 then 'Sept. ' || (p_partkey % 28 + 1) || 'th, 2026 at noon'
        when p_partkey % 16 = 3 then '≤ $' || (p_partkey % 9 + 1) || ',500' when p_partkey % 16 = 11 then 'under ' || (p_partkey % 9 + 1) || '.5 k per day' when p_partkey % 16 = 7 then 'by March ' || (p_partkey % 28 + 1) || ', 2026' else p_name end as label, p_retailprice * 20 as liquidity_usd
      from (select *, sum(p_retailprice) over (partition by p_brand, p_size) as total, count(*) over (partition by p_brand, p_size) as n from part) where n > 1""",
    "market_cache": """select 'm' || p_partkey as condition_id, p_brand || '-' || p_size as event_slug, p_retailprice * 20 as liquidity_usd, p_retailprice * 500 as volume_usd,
      [p_partkey || ':YES', p_partkey || ':NO'] as asset_ids, p_partkey % 19 * cast(0.05 as double) + cast(0.05 as double) as yes_price, p_partkey % 3 <> 0 as active from part""",
    "ticks": """select * exclude (k) from (select *, row_number() over (partition by asset_id, snapshot_at order by event_id) as k from (
      select cast(user_id as varchar) as asset_id, cast(floor(epoch(ts)) as bigint) as snapshot_at, value as mid_price, cast(1 + event_id % 7 as double) as spread,
        cast(10 + event_id % 50 as double) as bid_depth_top5, cast(10 + event_id % 37 as double) as ask_depth_top5, event_id from events)) where k = 1""",
    "first_seen": "select wallet_address, min(ts) as first_activity_at, count(*) as total_trades from trades group by wallet_address",
    "closed_positions": """select wallet_address, condition_id, outcome_side, won, size, notional / size as avg_price, case when won = 1 then size else 0 end - notional as realized_pnl, case when won = 1 then size else 0 end as current_value from (
      select wallet_address, condition_id, outcome_side, case when (outcome_side = 'YES') = (outcome_yes_won = 1) then 1 else 0 end as won, sum(size) as size, sum(notional_usd) as notional
      from trades join resolutions using (condition_id) where bs = 'BUY' group by all)""",
}


def with_views(query: str, **more: str) -> str:
    """``query`` after all views and the given further ones."""
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in {**SQL, **more}.items()) + "\n" + query
