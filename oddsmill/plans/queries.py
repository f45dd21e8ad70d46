"""Registered queries over the domain views, each with the SQL that states its result.

Doubles are rounded to eight digits on both sides, as sums differ in their last bits with the order of addition; 3e-12 keeps
binary fractions off the middle between two roundings.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmill.functions.categories import categorize_tags, primary_category, with_settings
from oddsmill.operators import corpus, detectors, features, ingest, ledger, model, report
from oddsmill.plans import views
from oddsmill.plans.registry import query, rounded
from oddsmill.sources.tables import built_once, scratch_table

# -- clean tables ---------------------------------------------------------------------------------


@query("select platform, tx_hash, asset_id, wallet_address, condition_id, outcome_side, bs, round(price + 3e-12, 8) as price, size, round(notional_usd + 3e-12, 8) as notional_usd, ts from trades where notional_usd >= 10")
def trades_clean(spark, sf_dir):
    return ingest.load_rules(views.trades(spark, sf_dir))


@query("""select platform, asset_id, condition_id, outcome_side, case when outcome_side = 'YES' then 0 else 1 end as outcome_index from (
  select *, row_number() over (partition by platform, asset_id order by ts, tx_hash) as k from trades) where k = 1""")
def asset_index(spark, sf_dir):
    return ingest.asset_index(views.trades(spark, sf_dir))


@query("select platform, condition_id, event_slug, category, categories_json, closed_at, round(total_volume_usd + 3e-12, 8) as total_volume_usd, trades_pulled_count from markets")
def markets_dim(spark, sf_dir):
    return views.markets(spark, sf_dir).select("platform", "condition_id", "event_slug", "category", "categories_json", "closed_at", "total_volume_usd", "trades_pulled_count")


@query("select * from resolutions")
def resolutions_dim(spark, sf_dir):
    return views.resolutions(spark, sf_dir)


@query("""select tx_hash as transaction_hash, asset_id, 'BUY' as side, wallet_address as wallet, condition_id, size, round(price + 3e-12, 8) as price,
  round(case when size > 25 then notional_usd else size * price end + 3e-12, 8) as usd_value, 'CONFIRMED' as status, ts as "timestamp" from trades where bs = 'BUY'""")
def activity_to_trades(spark, sf_dir):
    """Payloads as a venue sends them: every trade as JSON text, sells as another type, amounts for large ones alone."""
    t = views.trades(spark, sf_dir)
    payload = F.struct(
        F.when(F.col("bs") == "BUY", "TRADE").otherwise("REDEEM").alias("type"), F.col("tx_hash").alias("transactionHash"), F.col("asset_id").alias("asset"), F.lower("bs").alias("side"), F.col("wallet_address").alias("proxyWallet"),
        F.col("condition_id").alias("conditionId"), F.col("size").cast("string").alias("size"), F.col("price").cast("string").alias("price"), F.when(F.col("size") > 25, F.col("notional_usd").cast("string")).alias("usdcSize"), F.col("ts").alias("timestamp"),
    )
    return ingest.activity_trades(t.select(F.to_json(payload).alias("raw")))


@query("""select 'kalshi' as platform, tx_hash, condition_id || ':' || lower(outcome_side) as asset_id, '' as wallet_address, condition_id, outcome_side, 'BUY' as bs,
  round(case when outcome_side = 'YES' then price else 1 - price end + 3e-12, 8) as price, size, round(case when outcome_side = 'YES' then price else 1 - price end * size + 3e-12, 8) as notional_usd, ts from trades""")
def exchange_to_trades(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    return ingest.exchange_trades(
        t.select(F.col("tx_hash").alias("trade_id"), F.col("condition_id").alias("ticker"), F.lower("outcome_side").alias("taker_side"), F.col("price").cast("string").alias("yes_price_dollars"), (1 - F.col("price")).cast("string").alias("no_price_dollars"), F.col("size").cast("string").alias("count_fp"), F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_time"))
    )


@query("""select platform, tx_hash, asset_id, wallet_address, condition_id, outcome_side, bs, round(cash / 1000000 / (tokens / 1000000) + 3e-12, 8) as price, round(tokens / 1000000 + 3e-12, 8) as size, round(cash / 1000000 + 3e-12, 8) as notional_usd
  from (select *, cast(size * 1000000 as bigint) as tokens, cast(round(round(price, 2) * size * 1000000) as bigint) as cash from trades)""")
def fills_to_trades(spark, sf_dir):
    """Fills between makers and takers, rebuilt from trades, through the decoder of the maker's view."""
    t = views.trades(spark, sf_dir)
    tokens, cash = (F.col("size") * 1_000_000).cast("long").cast("string"), F.round(F.round("price", 2) * F.col("size") * 1_000_000).cast("long").cast("string")
    buy = F.col("bs") == "BUY"
    fills = t.select(
        F.col("tx_hash").alias("transaction_hash"), F.col("wallet_address").alias("maker"), F.when(buy, "0").otherwise(F.col("asset_id")).alias("maker_asset_id"), F.when(buy, F.col("asset_id")).otherwise("0").alias("taker_asset_id"),
        F.when(buy, cash).otherwise(tokens).alias("maker_amount"), F.when(buy, tokens).otherwise(cash).alias("taker_amount"), F.col("ts").alias("block_number"),
    )
    return ingest.fills_to_trades(fills, ingest.asset_index(t), "0xexchange")[0].drop("block_number")


@query("""select asset_id, b as snapshot_at, round(max(case when side = 'bid' then price end) + 3e-12, 8) as best_bid, round(min(case when side = 'ask' then price end) + 3e-12, 8) as best_ask from (
    select asset_id, b, side, price, arg_max(size, seq) as size from (
      select e.asset_id, e.b, m.side, m.price, m.size, m.seq from (select distinct cast(user_id as varchar) as asset_id, cast(floor(epoch(ts) / 86400) as bigint) * 86400 + 86400 as b from events) e
      join (select cast(user_id as varchar) as asset_id, cast(floor(epoch(ts)) as bigint) as ts, event_id as seq, case when event_id % 2 = 0 then 'bid' else 'ask' end as side,
        cast(case when event_id % 2 = 0 then event_id % 40 else 60 + event_id % 40 end as double) / 100 as price, cast(event_id % 5 as double) as size from events) m on m.asset_id = e.asset_id and m.ts < e.b)
    group by all) where size > 0 group by asset_id, b""")
def book_to_ticks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bid = F.col("event_id") % 2 == 0
    m = e.select(
        F.col("user_id").cast("string").alias("asset_id"), F.col("event_id").alias("seq"), views._epoch("ts").alias("ts"), F.lit("price_change").alias("event_type"), F.when(bid, "bid").otherwise("ask").alias("side"),
        ((F.when(bid, F.col("event_id") % 40).otherwise(60 + F.col("event_id") % 40)).cast("double") / 100).alias("price"), (F.col("event_id") % 5).cast("double").alias("size"),
    )
    return ingest.book_ticks(m, interval=86_400).where("best_bid is not null or best_ask is not null").select("asset_id", "snapshot_at", "best_bid", "best_ask")


_BOOK_ROWS = """select cast(user_id as varchar) as asset_id, event_id as seq, cast(floor(epoch(ts)) as bigint) as ts, case when event_id % 11 = 0 then 'book' when event_id % 7 = 3 then 'last_trade_price' else 'price_change' end as event_type,
  case when event_id % 2 = 0 then 'bid' else 'ask' end as side, cast(case when event_id % 2 = 0 then event_id % 40 else 60 + event_id % 40 end as double) / 100 as price, cast(event_id % 5 as double) as size from events
  union all select cast(user_id as varchar), event_id, cast(floor(epoch(ts)) as bigint), 'book', case when k < 3 then 'bid' else 'ask' end, cast(case when k < 3 then 41 + 2 * k else 50 + 2 * k end as double) / 100, cast(event_id % 3 + k as double)
  from events, range(6) r(k) where event_id % 11 = 0"""
_BOOK_ENDS = "select asset_id, (ts // 86400 + 1) * 86400 as snapshot_at, max(seq) as upto from book_rows group by all"
_BOOK_LIVE = """select * from (select e.asset_id, e.snapshot_at, m.side, m.price, m.size, m.seq, max(case when m.event_type = 'book' then m.seq end) over (partition by e.asset_id, e.snapshot_at) as since,
  row_number() over (partition by e.asset_id, e.snapshot_at, m.side, m.price order by m.seq desc) as k from book_ends e join book_rows m on m.asset_id = e.asset_id and m.seq <= e.upto and m.event_type <> 'last_trade_price')
  where k = 1 and size > 0 and seq >= coalesce(since, 0)"""


@query(
    """select asset_id, snapshot_at, last_trade_price, best_bid, best_ask, bid_depth_top5, ask_depth_top5, (best_bid + best_ask) / 2 as mid_price, best_ask - best_bid as spread from book_ends
    left join (select asset_id, snapshot_at, max(price) filter (side = 'bid') as best_bid, min(price) filter (side = 'ask') as best_ask, sum(size) filter (side = 'bid' and r <= 5) as bid_depth_top5, sum(size) filter (side = 'ask' and r <= 5) as ask_depth_top5
      from (select *, row_number() over (partition by asset_id, snapshot_at, side order by case when side = 'bid' then -price else price end) as r from book_live) group by all) using (asset_id, snapshot_at)
    left join (select e.asset_id, e.snapshot_at, arg_max(m.price, m.seq) as last_trade_price from book_ends e join book_rows m on m.asset_id = e.asset_id and m.seq <= e.upto and m.event_type = 'last_trade_price' group by all) using (asset_id, snapshot_at)""",
    book_rows=_BOOK_ROWS, book_ends=_BOOK_ENDS, book_live=_BOOK_LIVE,
)
def order_book_ticks(spark, sf_dir):
    """Snapshots, changes of a level and trades: the top of the book, its depth, mid, spread and last trade price."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, bid = F.col("event_id"), F.col("event_id") % 2 == 0
    base = [F.col("user_id").cast("string").alias("asset_id"), n.alias("seq"), views._epoch("ts").alias("ts")]
    own = e.select(
        *base, F.when(n % 11 == 0, "book").when(n % 7 == 3, "last_trade_price").otherwise("price_change").alias("event_type"), F.when(bid, "bid").otherwise("ask").alias("side"),
        (F.when(bid, n % 40).otherwise(60 + n % 40).cast("double") / 100).alias("price"), (n % 5).cast("double").alias("size"),
    )
    k = F.col("k")
    more = e.where(n % 11 == 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        *base, F.lit("book").alias("event_type"), F.when(k < 3, "bid").otherwise("ask").alias("side"), (F.when(k < 3, 41 + 2 * k).otherwise(50 + 2 * k).cast("double") / 100).alias("price"), (n % 3 + k).cast("double").alias("size")
    )
    return ingest.book_ticks(own.unionByName(more), interval=86_400)


# -- categories, selection, upkeep ----------------------------------------------------------------

_TAGGED = """select 'm' || p_partkey as condition_id, p_brand || '-' || p_size as event_slug, [case p_partkey % 9 when 0 then 'ESPORTS' when 1 then 'Bitcoin' when 2 then 'AI' when 3 then 'Fed Rates' when 4 then 'Middle East' when 5 then 'Movies' when 6 then 'US Election' when 7 then 'Crypto Prices' else 'Weather' end,
  case p_partkey % 4 when 0 then 'Sports' when 1 then 'Bitcoin' else 'Other' end] as tags from part"""


def _tagged(spark, sf_dir):
    first, second = ["ESPORTS", "Bitcoin", "AI", "Fed Rates", "Middle East", "Movies", "US Election", "Crypto Prices", "Weather"], ["Sports", "Bitcoin", "Other", "Other"]
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = [F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")) for names in (first, second)]
    return p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("condition_id"), F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("event_slug"), F.array(*tags).alias("tags"))


_CATEGORIZED = """select condition_id, event_slug, list_filter([case when list_contains(tags, 'Sports') then 'sports' end, case when list_contains(tags, 'ESPORTS') then 'esports' end, case when list_contains(tags, 'Fed Rates') then 'macro' end,
  case when list_contains(tags, 'Bitcoin') and not list_contains(tags, 'Crypto Prices') then 'crypto' end, case when list_contains(tags, 'US Election') then 'elections' end, case when list_contains(tags, 'Middle East') then 'geopolitics' end,
  case when list_contains(tags, 'AI') then 'tech' end, case when list_contains(tags, 'Movies') then 'culture' end], lambda x: x is not null) as found from tagged"""


@query("select condition_id, case when len(found) > 0 then array_to_string(found, ',') else 'thesis' end as categories, coalesce(found[1], 'thesis') as category from categorized", tagged=_TAGGED, categorized=_CATEGORIZED)
def categorize(spark, sf_dir):
    return _tagged(spark, sf_dir).select("condition_id", F.array_join(categorize_tags(F.col("tags")), ",").alias("categories"), primary_category(F.col("tags")).alias("category"))


@query(
    """select condition_id, category, cast(case category when 'sports' then 0.1 else 0.05 end as double) as min_edge, case category when 'sports' then 21600 when 'esports' then 86400 when 'tech' then 3600 else 172800 end as window_s, category in ('sports', 'esports') as mispricing_skip
    from (select condition_id, coalesce(found[1], 'thesis') as category from categorized)""",
    tagged=_TAGGED, categorized=_CATEGORIZED,
)
def category_settings(spark, sf_dir):
    """With a run's own window for one category."""
    overrides = spark.sql("select 'tech' as category, 3600L as window_s")
    return with_settings(_tagged(spark, sf_dir).select("condition_id", primary_category(F.col("tags")).alias("category")), overrides).select("condition_id", "category", "min_edge", "window_s", "mispricing_skip")


@query("select condition_id, event_slug, round(total_volume_usd + 3e-12, 8) as total_volume_usd from markets where backfill_state = 'complete' and condition_id not in (select condition_id from resolutions) and total_volume_usd is not null")
def missing_resolutions(spark, sf_dir):
    return corpus.missing_resolutions(views.markets(spark, sf_dir), views.resolutions(spark, sf_dir)).where("total_volume_usd is not null").select("condition_id", "event_slug", "total_volume_usd")


@query("select condition_id, round(total_volume_usd + 3e-12, 8) as total_volume_usd from markets where p_partkey % 3 = 0 order by total_volume_usd desc nulls last, closed_at desc nulls last, condition_id limit 25")
def work_queue(spark, sf_dir):
    m = views.markets(spark, sf_dir).withColumn("backfill_state", F.when(F.col("p_partkey") % 3 == 0, "pending").otherwise("complete"))
    return corpus.work_queue(m, 25).select("condition_id", "total_volume_usd")


@query("select condition_id, coalesce(last_ts, 0) as closed_at from (select 'm' || p_partkey as condition_id from part) left join (select condition_id, max(ts) as last_ts from trades group by condition_id) using (condition_id)")
def close_time_repair(spark, sf_dir):
    m = views.markets(spark, sf_dir).withColumn("closed_at", F.lit(0).cast("long"))
    return corpus.repair_close_times(m, views.trades(spark, sf_dir)).select("condition_id", "closed_at")


@query("select condition_id, coalesce(trades_pulled_count, 0) as trades_count, case when trades_pulled_count >= 30 then 0 else 1 end as truncated_at_offset_cap from markets")
def truncation_refresh(spark, sf_dir):
    m = views.markets(spark, sf_dir).withColumn("truncated_at_offset_cap", F.lit(1))
    return corpus.refresh_truncation(m, views.trades(spark, sf_dir), 30).select("condition_id", "trades_count", "truncated_at_offset_cap")


@query(
    """select p.tx_hash, p.asset_id, p.wallet_address, p.ts, case when p.ts <= lo then lo_block when p.ts >= hi then hi_block else cast(floor(b0 + (b1 - b0) * (p.ts - t0) / (t1 - t0)) as bigint) end as block
    from trades p cross join (select min(ts) as lo, min(block) as lo_block, max(ts) as hi, max(block) as hi_block from anchors)
    left join (select ts as t0, block as b0, lead(ts) over (order by ts) as t1, lead(block) over (order by ts) as b1 from anchors) on p.ts > t0 and p.ts <= t1""",
    anchors="select ts, cast(1000 + row_number() over (order by ts) * 5000 as bigint) as block from (select distinct cast(floor(ts / 2592000) as bigint) * 2592000 as ts from trades where ts % 7 < 5)",
)
def ts_interpolate(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    anchors = t.where("ts % 7 < 5").select((F.floor(F.col("ts") / 2_592_000) * 2_592_000).alias("ts")).distinct()
    anchors = anchors.select("ts", (1000 + F.row_number().over(Window.orderBy("ts")) * 5000).cast("long").alias("block"))  # a row for each month
    return corpus.interpolate_blocks(t.select("tx_hash", "asset_id", "wallet_address", "ts"), anchors)


# -- features -------------------------------------------------------------------------------------

_SQL_FEATURES = {
    "enriched": "select t.*, coalesce(m.category, 'unknown') as category, m.categories_json, m.closed_at from trades t join markets m using (condition_id)",
    "firsts": "select *, case when row_number() over (partition by condition_id, wallet_address order by ts, tx_hash, asset_id) = 1 then 1 else 0 end as is_first from enriched",
    "market_aggs": """select * exclude (is_first), coalesce(sum(notional_usd) over past, 0) as market_volume_so_far_usd, cast(coalesce(sum(is_first) over past, 0) as bigint) as market_unique_traders_so_far,
      last_value(price ignore nulls) over past as last_trade_price, case when count(price) over last20 >= 2 then stddev_pop(price) over last20 end as price_volatility_recent,
      ts - coalesce(min(ts) over past, 0) as market_age_seconds, closed_at - ts as time_to_resolution_seconds
      from firsts window past as (partition by condition_id order by ts, tx_hash, asset_id, wallet_address rows between unbounded preceding and 1 preceding),
        last20 as (partition by condition_id order by ts, tx_hash, asset_id, wallet_address rows between 20 preceding and 1 preceding)""",
    "happened": """select 0 as kind, null as won, null as pnl, * from market_aggs union all by name
      select 1 as kind, case when (outcome_side = 'YES') = (outcome_yes_won = 1) then 1 else 0 end as won,
        case when (outcome_side = 'YES') = (outcome_yes_won = 1) then size else 0 end - notional_usd as pnl, wallet_address, condition_id, tx_hash, asset_id, resolved_at as ts
      from enriched join resolutions using (condition_id) where bs = 'BUY' and resolved_at >= ts""",
    "wallet_aggs": """select *, cast(coalesce(sum(case when kind = 0 then 1 end) over past, 0) as bigint) as prior_trades_count, cast(coalesce(sum(case when bs = 'BUY' and kind = 0 then 1 end) over past, 0) as bigint) as prior_buys_count,
      cast(coalesce(sum(kind) over past, 0) as bigint) as prior_resolved_buys, cast(coalesce(sum(won) over past, 0) as bigint) as prior_wins, coalesce(sum(pnl) over past, 0) as prior_realized_pnl_usd,
      sum(case when bs = 'BUY' and kind = 0 then price end) over past as paid, sum(case when bs = 'BUY' and kind = 0 then notional_usd end) over past as spent,
      min(case when kind = 0 then ts end) over (partition by wallet_address) as first_ts, max(case when kind = 0 then ts end) over past as last_ts,
      cast(coalesce(sum(case when kind = 0 then 1 end) over (partition by wallet_address order by ts range between unbounded preceding and 2592001 preceding), 0) as bigint) as old, """
    + "list_filter(["
    + ", ".join(
        f"{{'n': -coalesce(sum(case when bs = 'BUY' and kind = 0 and category = '{c}' then 1 end) over past, 0), 'f': min(case when bs = 'BUY' and kind = 0 and category = '{c}' then {{'ts': ts, 'tx': tx_hash, 'a': asset_id}} end) over past, 'c': '{c}'}}"
        for c in ("sports", "esports", "macro", "crypto", "tech", "unknown")
    )
    + "], lambda x: x.n < 0) as used from happened window past as (partition by wallet_address order by ts, kind, tx_hash, asset_id rows between unbounded preceding and 1 preceding)",
    "known_trades": """select *, case when prior_resolved_buys > 0 then prior_wins / prior_resolved_buys end as win_rate, case when prior_buys_count > 0 then paid / prior_buys_count end as avg_implied_prob_paid,
      case when prior_buys_count > 0 then spent / prior_buys_count end as avg_bet_size_usd from wallet_aggs where kind = 0""",
    "examples": """select k.*, win_rate - avg_implied_prob_paid as realized_edge_pp, case when avg_bet_size_usd > 0 then notional_usd / avg_bet_size_usd end as bet_size_rel_to_avg, list_sort(used)[1].c as top_category,
      cast(len(used) as bigint) as category_diversity, greatest(0.0, (ts - first_ts) / 86400) as wallet_age_days, ts - last_ts as seconds_since_last_trade, prior_trades_count - old as prior_trades_30d,
      case when (outcome_side = 'YES') = (outcome_yes_won = 1) then 1 else 0 end as label_won, price as implied_prob_at_buy, resolved_at
      from known_trades k join resolutions using (condition_id) where bs = 'BUY'""",
    "scored": "select *, round(least(0.99, cast(0.2 as double) + cast(0.6 as double) * implied_prob_at_buy + cast(0.3 as double) * coalesce(win_rate, 0)) + 3e-12, 4) as pred from examples",
}


def _examples(spark, sf_dir):
    return features.build_features(views.trades(spark, sf_dir), views.markets(spark, sf_dir), views.resolutions(spark, sf_dir))


@query(
    """select tx_hash, asset_id, wallet_address, round(market_volume_so_far_usd + 3e-12, 8) as market_volume_so_far_usd, market_unique_traders_so_far, round(last_trade_price + 3e-12, 8) as last_trade_price,
    round(price_volatility_recent + 3e-12, 8) as price_volatility_recent, market_age_seconds, time_to_resolution_seconds from market_aggs""",
    **_SQL_FEATURES,
)
def pit_market_features(spark, sf_dir):
    t = features.market_features(features.enriched_trades(views.trades(spark, sf_dir), views.markets(spark, sf_dir), "polymarket"))
    return t.select("tx_hash", "asset_id", "wallet_address", "market_volume_so_far_usd", "market_unique_traders_so_far", "last_trade_price", "price_volatility_recent", "market_age_seconds", "time_to_resolution_seconds")


_EXAMPLE_COLUMNS = {
    "prior_trades_count": 0, "prior_buys_count": 0, "prior_resolved_buys": 0, "prior_wins": 0, "prior_losses": 0, "prior_realized_pnl_usd": 1, "win_rate": 1, "avg_implied_prob_paid": 1, "realized_edge_pp": 1, "avg_bet_size_usd": 1,
    "bet_size_usd": 1, "bet_size_rel_to_avg": 1, "edge_confidence_weighted": 1, "win_rate_confidence_weighted": 1, "is_high_quality_wallet": 0, "wallet_age_days": 1, "seconds_since_last_trade": 0, "prior_trades_30d": 0, "top_category": 0,
    "category_diversity": 0, "market_volume_so_far_usd": 1, "market_unique_traders_so_far": 0, "last_trade_price": 1, "price_volatility_recent": 1, "market_age_seconds": 0, "time_to_resolution_seconds": 0, "market_category": 0, "side": 0,
    "implied_prob_at_buy": 1, "label_won": 0, "cat_sports": 0, "cat_thesis": 0,
}


@query(
    "select platform, tx_hash, asset_id, wallet_address, condition_id, "
    + ", ".join(f"round({c} + 3e-12, 8) as {c}" if is_double else c for c, is_double in _EXAMPLE_COLUMNS.items())
    + """ from (select *, prior_resolved_buys - prior_wins as prior_losses, notional_usd as bet_size_usd, realized_edge_pp * least(1.0, prior_resolved_buys / 20) as edge_confidence_weighted,
      (win_rate - 0.5) * least(1.0, prior_resolved_buys / 20) as win_rate_confidence_weighted, case when prior_resolved_buys >= 20 and win_rate > 0.55 then 1 else 0 end as is_high_quality_wallet, category as market_category, outcome_side as side,
      case when categories_json <> '[]' then cast(contains(categories_json, '"sports"') as int) else cast(category = 'sports' as int) end as cat_sports,
      case when categories_json <> '[]' then 1 else cast(category = 'thesis' as int) end as cat_thesis from examples)""",
    **_SQL_FEATURES,
)
def training_examples(spark, sf_dir):
    return _examples(spark, sf_dir).select("platform", "tx_hash", "asset_id", "wallet_address", "condition_id", *_EXAMPLE_COLUMNS)


@query("""select wallet_address, count(*) as trades_count, count(*) filter (bs = 'BUY') as buys_count, min(ts) as first_trade_ts, max(ts) as last_trade_ts, round(sum(case when bs = 'BUY' then price else 0 end) + 3e-12, 8) as paid,
  round(sum(case when bs = 'BUY' then notional_usd else 0 end) + 3e-12, 8) as spent, cast(coalesce(sum(case when resolved_at >= ts and resolved_at < 1000000000 and bs = 'BUY' then 1 end), 0) as bigint) as resolved_buys
  from trades left join resolutions using (condition_id) where ts < 1000000000 group by wallet_address""")
def wallet_state(spark, sf_dir):
    from oddsmill.streaming.state import wallet_snapshot

    s = wallet_snapshot(views.trades(spark, sf_dir), views.markets(spark, sf_dir), views.resolutions(spark, sf_dir), 1_000_000_000)
    return s.select("wallet_address", "trades_count", "buys_count", "first_trade_ts", "last_trade_ts", "paid", "spent", "resolved_buys")


@query("""select condition_id, round(sum(notional_usd) + 3e-12, 8) as volume_usd, count(distinct wallet_address) as unique_traders, round(arg_max(price, (ts, tx_hash, asset_id)) + 3e-12, 8) as last_price, count(*) as trades_count from trades where ts < 1000000000 group by condition_id""")
def market_state(spark, sf_dir):
    from oddsmill.streaming.state import market_snapshot

    return market_snapshot(views.trades(spark, sf_dir), 1_000_000_000).select("condition_id", "volume_usd", "unique_traders", "last_price", "trades_count")


# -- detectors ------------------------------------------------------------------------------------

_SKILL = """select wallet_address, count(*) as positions, cast(sum(won) as bigint) as wins, round(avg(won) + 3e-12, 8) as winrate, round(avg(won - avg_price) + 3e-12, 8) as mean_edge, round(sum(size * avg_price) + 3e-12, 8) as total_stake_usd,
  round(sum(realized_pnl) + 3e-12, 8) as excess_pnl_usd, round(sum((won - avg_price) * size * avg_price) / sum(size * avg_price) + 3e-12, 8) as weighted_edge
  from closed_positions where avg_price > 0 and avg_price < 1 and not (realized_pnl = 0 and current_value = 0) group by wallet_address"""


@query(_SKILL)
def wallet_skill(spark, sf_dir):
    return detectors.wallet_skill(views.closed_positions(spark, sf_dir))


@query(f"select * from ({_SKILL}) where positions >= 10 and mean_edge >= 0.05 and excess_pnl_usd >= 10")
def smart_roster(spark, sf_dir):
    return corpus.roster(rounded(detectors.wallet_skill(views.closed_positions(spark, sf_dir))), 10, 0.05, 10.0)  # floors are met by what is returned


@query(f"""select wallet_address, condition_id, outcome_side, snapshot_at, round(g.size + 3e-12, 8) as size, round(delta_usd + 3e-12, 8) as delta_usd,
  case when delta_usd / 10000 * greatest(coalesce(mean_edge, 0), 0) >= 0.5 then 'high' when delta_usd / 10000 * greatest(coalesce(mean_edge, 0), 0) >= 0.1 then 'med' else 'low' end as severity from (select * from (
  select *, (size - lag(size) over (partition by wallet_address, condition_id, outcome_side order by snapshot_at)) * price as delta_usd from (
    select wallet_address, condition_id, outcome_side, ts as snapshot_at, max(price) as price, 100 * sum(sum(size)) over (partition by wallet_address, condition_id, outcome_side order by ts) as size from trades group by wallet_address, condition_id, outcome_side, ts)) where delta_usd >= 500) g left join ({_SKILL}) using (wallet_address)""")
def position_growth(spark, sf_dir):
    w = Window.partitionBy("wallet_address", "condition_id", "outcome_side").orderBy("snapshot_at")
    per = views.trades(spark, sf_dir).groupBy("wallet_address", "condition_id", "outcome_side", F.col("ts").alias("snapshot_at")).agg(F.max("price").alias("avg_price"), F.sum("size").alias("size"))
    history = per.withColumn("size", 100 * F.sum("size").over(w))
    skill = detectors.wallet_skill(views.closed_positions(spark, sf_dir))
    return detectors.position_growth(history, skill, 500.0).select("wallet_address", "condition_id", "outcome_side", "snapshot_at", "size", "delta_usd", "severity")


@query("select event_slug, count(yes_price) as n_priced, round(sum(yes_price) + 3e-12, 8) as price_sum, round(sum(yes_price) - 1 + 3e-12, 8) as deviation from event_markets group by event_slug having count(yes_price) >= 2")
def event_price_sum(spark, sf_dir):
    return detectors.event_price_sum(views.event_markets(spark, sf_dir))


_MISPRICED = """select event_slug, condition_id, n_priced, price_sum, deviation, case when abs(deviation) > 0.10 then 'high' when abs(deviation) > 0.05 then 'med' else 'low' end as severity,
  case when yes_price > yes_price / price_sum then 'NO' else 'YES' end as target_side, case when yes_price > yes_price / price_sum then 1 - yes_price else yes_price end as current_price,
  case when yes_price > yes_price / price_sum then 1 - yes_price / price_sum else yes_price / price_sum end as fair_price from (
  select e.*, n_priced, price_sum, price_sum - 1 as deviation, row_number() over (partition by e.event_slug order by abs(yes_price - yes_price / price_sum) desc, position) as k
  from event_markets e join (select event_slug, count(yes_price) as n_priced, sum(yes_price) as price_sum from event_markets group by event_slug) using (event_slug)
  where abs(price_sum - 1) > 0.03 and abs(price_sum - 1) <= 0.5) where k = 1"""


@query(f"select * replace (round(price_sum + 3e-12, 8) as price_sum, round(deviation + 3e-12, 8) as deviation, round(current_price + 3e-12, 8) as current_price, round(fair_price + 3e-12, 8) as fair_price) from ({_MISPRICED})")
def mispricing_target(spark, sf_dir):
    return detectors.mispricing_alerts(views.event_markets(spark, sf_dir))


_AXES = """select *, case when label like '2025-%' then datediff('day', date '1970-01-01', cast(label as date)) when label like 'March %' then datediff('day', date '1970-01-01', make_date(2026, 3, cast(regexp_extract(label, 'March (\\d+),', 1) as int)))
    when label like 'Sept. %' then datediff('day', date '1970-01-01', make_date(2026, 9, cast(regexp_extract(label, 'Sept. (\\d+)th', 1) as int))) end as date_axis,
  case when label like 'Above %' then cast(regexp_extract(label, 'Above (\\d+)K', 1) as double) * 1000 end as higher_axis,
  case when label like '≤ $%' then cast(regexp_extract(label, '(\\d),500', 1) as double) * 1000 + 500 when label like 'under %' then cast(regexp_extract(label, 'under (\\d.5) k', 1) as double) * 1000 end as lower_axis from event_markets"""


@query(f"select event_slug, condition_id, label, cast(date_axis as int) as date_axis, higher_axis, lower_axis from ({_AXES})")
def axis_extract(spark, sf_dir):
    return views.event_markets(spark, sf_dir).withColumns(detectors.axes(F.col("label"))).select("event_slug", "condition_id", "label", "date_axis", "higher_axis", "lower_axis")


@query(f"""select event_slug, axis, condition_id as strict_id, round(yes_price + 3e-12, 8) as strict_price, loose_id, round(loose_price + 3e-12, 8) as loose_price, round(yes_price - loose_price, 6) as gap,
  case when round(yes_price - loose_price, 6) > 0.10 then 'high' when round(yes_price - loose_price, 6) > 0.05 then 'med' else 'low' end as severity from (
  select *, lead(condition_id) over w as loose_id, lead(yes_price) over w as loose_price, lead(strictness) over w as loose_at from (
    select *, case when axis = 'date' then -date_axis when axis = 'higher' then higher_axis when axis = 'lower' then -lower_axis end as strictness from (
      select *, case when count(date_axis) over (partition by event_slug) >= 2 then 'date' when count(higher_axis) over (partition by event_slug) >= 2 then 'higher' when count(lower_axis) over (partition by event_slug) >= 2 then 'lower' end as axis from (
        select * from ({_AXES}) where liquidity_usd >= 18050 and event_slug in (select event_slug from event_markets group by event_slug having count(*) between 2 and 12 and max(case when position % 17 <> 0 then liquidity_usd end) >= 18200)))) where strictness is not null
  window w as (partition by event_slug order by strictness desc, position)) where loose_at < strictness and round(yes_price - loose_price, 6) >= 0.02""")
def monotone_violations(spark, sf_dir):
    """Events with floors of their own and for their markets."""
    m = views.event_markets(spark, sf_dir)
    events = m.groupBy("event_slug").agg(F.max(F.when(F.col("position") % 17 != 0, F.col("liquidity_usd"))).alias("liquidity_usd"))
    return detectors.monotone_violations(detectors.with_axis(detectors.monotone_eligible(m, events, 18_200.0, 12, 18_050.0)))


@query("""select tx_hash, asset_id, wallet_address, condition_id, round(notional_usd + 3e-12, 8) as notional_usd, liquidity_usd, round((ts - first_activity_at) / 86400 + 3e-12, 8) as wallet_age_days, total_trades, case when notional_usd > 40 or notional_usd / liquidity_usd > 0.002 then 'high' else 'med' end as severity
  from trades join market_cache using (condition_id) join first_seen using (wallet_address)
  where notional_usd >= 20 and liquidity_usd <= 25000 and liquidity_usd > 0 and notional_usd / liquidity_usd >= 0.001 and (ts - first_activity_at) / 86400 <= 365 and total_trades <= 50""")
def whale_alerts(spark, sf_dir):
    out = detectors.whale_alerts(views.trades(spark, sf_dir), views.market_cache(spark, sf_dir), views.first_seen(spark, sf_dir), 25_000, 20, 0.001, 365, 50, 40, 0.002)
    return out.select("tx_hash", "asset_id", "wallet_address", "condition_id", "notional_usd", "liquidity_usd", "wallet_age_days", "total_trades", "severity")


_MOVES = """select asset_id, snapshot_at, mid_price, start_price, n_ticks, (mid_price - start_price) / start_price as change, coalesce(start_spread / spread > 5, false) as consolidated,
  coalesce(least(bid_depth_top5, ask_depth_top5) / greatest(bid_depth_top5, ask_depth_top5) >= 0.05 and least(bid_depth_top5, ask_depth_top5) * mid_price >= 100, false) as liquid from (
  select *, w[1].m as start_price, w[1].s as start_spread, cast(len(w) as int) as n_ticks from (
    select * exclude (w), list_filter(w, lambda x: x.t > snapshot_at - 43200) as w from (select *, list({'t': snapshot_at, 'm': mid_price, 's': spread}) over (partition by asset_id order by snapshot_at rows between 31 preceding and current row) as w from ticks where mid_price is not null)))
  where n_ticks >= 2 and start_price > 0 and abs((mid_price - start_price) / start_price) >= 0.05"""


@query(
    """select alert_key, asset_id, condition_id, snapshot_at, round(change + 3e-12, 8) as change, case when consolidated then 'low' when abs(change) > 0.10 then 'high' else 'med' end as severity from (
    select *, row_number() over (partition by alert_key order by snapshot_at, asset_id) as k from (
      select *, 'velocity:' || coalesce(condition_id, asset_id) || ':' || cast(floor(snapshot_at / 60) as bigint) as alert_key from moves
      left join (select cast(p_partkey as varchar) as asset_id, 'm' || cast(floor(p_partkey / 2) as bigint) as condition_id from part where p_partkey % 5 <> 0) using (asset_id) where liquid)) where k = 1""",
    moves=_MOVES,
)
def velocity_alerts(spark, sf_dir):
    assets = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("asset_id"), F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("condition_id"))
    return detectors.velocity_alerts(detectors.velocity(views.ticks(spark, sf_dir), 43_200), assets).select("alert_key", "asset_id", "condition_id", "snapshot_at", "change", "severity")


@query("select * replace (round(change + 3e-12, 8) as change) from moves", moves=_MOVES)
def velocity_moves(spark, sf_dir):
    t = detectors.velocity(views.ticks(spark, sf_dir), 43_200)
    return t.select("asset_id", "snapshot_at", "mid_price", "start_price", "n_ticks", "change", "consolidated", "liquid")


_BURST_ALERTS = "select condition_id as alert_key, condition_id, max(ts) as at_ts from trades group by condition_id"


@query(
    """select alert_key, condition_id, at_ts - coalesce(min(case when quiet and before then k end) * 86400, 864000) as since, at_ts as until from (
    select *, lag(quiet, 1, false) over (partition by alert_key order by k) as before from (
      select a.alert_key, a.condition_id, a.at_ts, s.k, coalesce(c.n, 0) < 3.0 * (coalesce(b.n, 0) / 31536000 * 86400) as quiet
      from burst_alerts a cross join (select unnest(range(0, 10)) as k) s
      left join (select alert_key, count(*) as n from burst_alerts a join trades t using (condition_id) where t.ts between a.at_ts - 31536000 and a.at_ts group by alert_key) b using (alert_key)
      left join (select alert_key, s.k, count(*) as n from burst_alerts a cross join (select unnest(range(0, 10)) as k) s join trades t using (condition_id) where t.ts >= a.at_ts - (s.k + 1) * 86400 and t.ts < a.at_ts - s.k * 86400 group by all) c on c.alert_key = a.alert_key and c.k = s.k))
    group by alert_key, condition_id, at_ts""",
    burst_alerts=_BURST_ALERTS,
)
def burst_start(spark, sf_dir):
    a = views.trades(spark, sf_dir).groupBy("condition_id").agg(F.max("ts").alias("at")).select(F.col("condition_id").alias("alert_key"), "condition_id", "at")
    return detectors.burst_windows(a, views.trades(spark, sf_dir), step=86_400, back=864_000, baseline_s=31_536_000)


@query("""select condition_id, outcome_side, bs, bucket, n_wallets, round(median_size + 3e-12, 8) as median_size, round(cv + 3e-12, 8) as cv,
  list_aggregate(list_sort(list_transform(list_sort(near)[1:3], lambda x: x.w)), 'string_agg', ',') as wallets from (
  select *, row_number() over (partition by condition_id order by least(n_wallets, 3) desc, bucket, outcome_side, bs) as k from (
    select condition_id, outcome_side, bs, bucket, count(*) as n_wallets, median(size) as median_size, stddev_pop(size) / avg(size) as cv,
      list_transform(list({'s': size, 'w': wallet_address}), lambda x: {'d': abs(x.s - median(size)), 'w': x.w}) as near from (
      select *, row_number() over (partition by condition_id, outcome_side, bs, bucket, wallet_address order by ts, tx_hash, asset_id) as r from (select * replace (case when ts % 11 = 0 then 0 else size end as size), cast(floor(ts / 31536000) as bigint) * 31536000 as bucket from trades)) where r = 1 and size > 0
    group by all having count(*) >= 4 and stddev_pop(size) / avg(size) <= 0.4)) where k <= 5""".replace("list_transform(list({'s': size, 'w': wallet_address}), lambda x: {'d': abs(x.s - median(size)), 'w': x.w}) as near", "list({'s': size, 'w': wallet_address}) as own").replace("list_sort(near)", "list_sort(list_transform(own, lambda x: {'d': abs(x.s - median_size), 'w': x.w}))"))
def burst_hits(spark, sf_dir):
    t = views.trades(spark, sf_dir).withColumn("size", F.when(F.col("ts") % 11 == 0, 0.0).otherwise(F.col("size")))
    hits = detectors.burst_hits(t, bucket=31_536_000, contributors=3)
    return hits.select("condition_id", "outcome_side", "bs", "bucket", "n_wallets", "median_size", "cv", F.array_join("wallets", ",").alias("wallets"))


@query(
    """select condition_id, tx_hash, asset_id, wallet_address, ts, n_wallets, round(total_usd + 3e-12, 8) as total_usd, case when n_wallets >= 3 then 'high' else 'med' end as severity from (
    select a.condition_id, a.tx_hash, a.asset_id, a.wallet_address, a.ts, count(distinct b.wallet_address) as n_wallets, sum(case when b.newness <= 10 then b.notional_usd else 0 end) as total_usd
    from chosen a join chosen b on a.condition_id = b.condition_id and b.ts between a.ts - 2592000 and a.ts group by all) where n_wallets >= 2""",
    chosen="""select *, row_number() over (partition by wallet_address order by ts desc, tx_hash desc, asset_id desc) as newness from trades
      where wallet_address in (select wallet_address from closed_positions where avg_price > 0 and avg_price < 1 group by wallet_address having sum(realized_pnl) >= 0.005)""",
)
def convergence_alerts(spark, sf_dir):
    """With the roster of wallets that earned; only each one's ten newest trades add to the volume."""
    roster = corpus.roster(detectors.wallet_skill(views.closed_positions(spark, sf_dir)), 1, -1.0, 0.005)
    return detectors.convergence(views.trades(spark, sf_dir), roster.select("wallet_address"), window_s=2_592_000, newest=10)


@query(
    """select condition_id, tx_hash, asset_id, wallet_address, ts, category, n_wallets, round(total_usd + 3e-12, 8) as total_usd, case when n_wallets >= 3 then 'high' else 'med' end as severity from (
    select a.condition_id, a.tx_hash, a.asset_id, a.wallet_address, a.ts, a.category, count(distinct b.wallet_address) as n_wallets, sum(b.notional_usd) as total_usd
    from chosen a join chosen b on a.condition_id = b.condition_id and b.ts between a.ts - case a.category when 'sports' then 21600 when 'esports' then 86400 else 172800 end and a.ts group by all) where n_wallets >= 2""",
    tagged=_TAGGED, categorized=_CATEGORIZED,
    skilled="""select wallet_address, c as category from (select p.*, coalesce(found[1], 'thesis') as c from closed_positions p join categorized using (condition_id)) where avg_price > 0 and avg_price < 1 group by wallet_address, c
      having count(*) >= 2 and sum(realized_pnl) >= 0 and avg(won - avg_price) >= case c when 'sports' then 0.10 else 0.05 end""",
    chosen="select t.*, s.category from (select * replace (ts - ts % 604800 + ts % 86400 as ts) from trades) t join categorized c using (condition_id) join skilled s on s.wallet_address = t.wallet_address and s.category = coalesce(c.found[1], 'thesis')",
)
def convergence_by_category(spark, sf_dir):
    """By the windows and rosters of categories; the days of a week are laid on one another, as trades of the tables are sparse."""
    t = views.trades(spark, sf_dir).withColumn("ts", F.col("ts") - F.col("ts") % 604_800 + F.col("ts") % 86_400)
    tags = _tagged(spark, sf_dir)
    positions = views.closed_positions(spark, sf_dir).join(tags.select("condition_id", primary_category(F.col("tags")).alias("category")), "condition_id")
    skill = detectors.wallet_skill(positions, ("wallet_address", "category"))
    return detectors.convergence_by_category(t, tags, skill, min_positions=2)


@query("""select wallet_address, first_activity_at, wave, members from (select *, count(*) over (partition by g) as members, min(first_activity_at) over (partition by g) as wave from (
  select *, sum(new) over (order by first_activity_at, wallet_address) as g from (
    select *, case when first_activity_at - lag(first_activity_at) over (order by first_activity_at, wallet_address) <= 86400 then 0 else 1 end as new from first_seen))) where members >= 3""")
def creation_waves(spark, sf_dir):
    return detectors.creation_waves(views.first_seen(spark, sf_dir))


_EDGES = """select a.wallet_address as a, b.wallet_address as b, count(*) as shared from held a join held b on a.condition_id = b.condition_id and a.wallet_address < b.wallet_address group by all having count(*) >= 3"""
_HELD = "select distinct wallet_address, condition_id from trades semi join (select * from market_cache where liquidity_usd <= 19000 and volume_usd <= 1000000) using (condition_id)"


def _edges(spark, sf_dir):
    return detectors.cotrade_edges(views.trades(spark, sf_dir), detectors.obscure_markets(views.market_cache(spark, sf_dir), 19_000))


@query(_EDGES, held=_HELD)
def cotrade_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


_COMPONENTS = {
    "held": _HELD,
    "edges": _EDGES,
    "linked": "select a, b from edges union all select b, a from edges",
    "reached": "select distinct a as node, a as other from linked union select r.node, l.b from reached r join linked l on l.a = r.other",
    "parts": "select node as wallet_address, min(other) as component from reached group by node",
}


@query("select * from parts", **_COMPONENTS)
def wallet_components(spark, sf_dir):
    return detectors.components(_edges(spark, sf_dir), scratch_table)


@query(
    """select component, member_count, dated, first_created, last_created, shared_markets, round(size_cv + 3e-12, 8) as size_cv, round(buy_ratio + 3e-12, 8) as buy_ratio, burst_wallets, 'cluster-' || substr(sha256(who), 1, 16) as cluster_id, score,
    case when buy_ratio is null then null when buy_ratio between 0.5 and 0.8 then 'farmer' when buy_ratio > 0.9 then 'trader' else 'mixed' end as behavior_tag, case when score >= 7 then 'high' when score >= 5 then 'med' end as severity from (
    select *, case when dated >= 3 and last_created - first_created <= 86400 then 2 else 0 end + case when shared_markets >= 3 then 2 else 0 end + case when size_cv < 0.3 then 1 else 0 end + case when burst_wallets >= 3 then 2 else 0 end as score from (
      select component, count(*) as member_count, count(first_activity_at) as dated, min(first_activity_at) as first_created, max(first_activity_at) as last_created, string_agg(lower(wallet_address), '|' order by lower(wallet_address)) as who
      from members left join first_seen using (wallet_address) group by component)
    left join (select component, count(*) as shared_markets, min(cv) as size_cv, sum(buys) / sum(n) as buy_ratio from (
      select component, condition_id, case when count(*) filter (size > 0) >= 2 then stddev_pop(size) filter (size > 0) / avg(size) filter (size > 0) end as cv, count(*) as n, count(*) filter (bs = 'BUY') as buys from in_shared group by all) group by component) using (component)
    left join (select component, max(w) as burst_wallets from (select component, condition_id, asset_id, bs, cast(floor(ts / 2592000) as bigint) as b, count(distinct wallet_address) as w from in_shared group by all) group by component) using (component))""",
    **_COMPONENTS,
    members="select wallet_address, component from (select *, count(*) over (partition by component) as n from parts) where n >= 3",
    own="select m.component, t.* from trades t join members m using (wallet_address) semi join (select * from market_cache where liquidity_usd <= 19000 and volume_usd <= 1000000) c using (condition_id)",
    in_shared="select o.* from own o join (select component, condition_id from own group by all having count(distinct wallet_address) >= 3) using (component, condition_id)",
)
def cluster_scores(spark, sf_dir):
    groups = detectors.cluster_groups(detectors.components(_edges(spark, sf_dir), scratch_table))
    obscure = detectors.obscure_markets(views.market_cache(spark, sf_dir), 19_000)
    return detectors.cluster_scores(groups, views.trades(spark, sf_dir), views.first_seen(spark, sf_dir), obscure, bucket=2_592_000)


@query("""select component, condition_id, tx_hash, asset_id, wallet_address, ts, n_active, case when n_active * 2 >= member_count then 'high' else 'med' end as severity from (
  select c_nationkey as component, condition_id, tx_hash, asset_id, wallet_address, ts,
    (select count(distinct b.wallet_address) from trades b join customer d on b.wallet_address = 'w' || d.c_custkey where b.condition_id = t.condition_id and d.c_nationkey = c.c_nationkey and b.ts between t.ts - 864000 and t.ts) as n_active
  from trades t join customer c on t.wallet_address = 'w' || c.c_custkey) join (select c_nationkey as component, count(*) as member_count from customer group by all) using (component) where n_active >= 2""")
def cluster_active(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("wallet_address"), F.col("c_nationkey").alias("component"))
    return detectors.cluster_active(views.trades(spark, sf_dir), m, 864_000).select("component", "condition_id", "tx_hash", "asset_id", "wallet_address", "ts", "n_active", "severity")


_SEEDS = "select 'w' || c_custkey as wallet_address from customer where c_custkey % 40 = 0"


def _seeds(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 40 = 0").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("wallet_address"))


_SEED_MARKETS = "select condition_id, count(*) as n_trades, count(distinct wallet_address) as n_wallets, min(ts) as first_ts, max(ts) as last_ts from trades semi join seeds using (wallet_address) group by condition_id having count(distinct wallet_address) >= 3 or count(*) >= 4"


@query(_SEED_MARKETS, seeds=_SEEDS)
def seed_markets(spark, sf_dir):
    return detectors.seed_markets(views.trades(spark, sf_dir), _seeds(spark, sf_dir))


_SHARES = "avg(case when bs = 'SELL' then 1.0 else 0 end) as sell_rate, avg(case when price >= 0.95 then 1.0 else 0 end) as high_price, avg(case when size < 100 then 1.0 else 0 end) as small, avg(case when size between 500 and 999 then 1.0 else 0 end) as round"


@query(
    """select wallet_address, n_trades, n_markets, round(n.sell_rate + 3e-12, 8) as sell_rate, round(n.high_price + 3e-12, 8) as high_price, round(n.small + 3e-12, 8) as small, round(n."round" + 3e-12, 8) as "round", median_size,
    round(4 - abs(n.sell_rate - t.sell_rate) - abs(n.high_price - t.high_price) - abs(n.small - t.small) - abs(n."round" - t."round") + 0.5 * least(n_markets, 5) + 3e-12, 8) as score from near n cross join target t""",
    seeds=_SEEDS, spans=_SEED_MARKETS, target=f"select {_SHARES} from trades semi join seeds using (wallet_address)",
    near=f"""select wallet_address, count(*) as n_trades, count(distinct condition_id) as n_markets, {_SHARES}, list_sort(list(size))[cast(floor(count(*) / 2) as int) + 1] as median_size
      from trades join spans using (condition_id) where ts between first_ts - 3600 and last_ts + 3600 and wallet_address not in (select wallet_address from seeds) group by wallet_address""",
)
def cluster_expand(spark, sf_dir):
    return detectors.expand_cluster(views.trades(spark, sf_dir), _seeds(spark, sf_dir))


# -- signals and ledger ---------------------------------------------------------------------------

_GATED = {
    **_SQL_FEATURES,
    "gated": "select tx_hash || '|' || asset_id || '|' || wallet_address as alert_key, *, pred - implied_prob_at_buy as edge from scored where top_category in ('sports', 'crypto', 'tech') and pred >= 0.5 and pred - implied_prob_at_buy >= 0.05",
    "asset_ticks": "select asset_id, ts as snapshot_at, max(price) + 0.01 as best_ask, max(price) as last_trade_price from trades group by asset_id, ts",
    "assets": "select condition_id, 'YES' as side, asset_ids[1] as asset_id, yes_price as cached_price from market_cache union all select condition_id, 'NO', asset_ids[2], 1 - yes_price from market_cache",
    "priced": """select g.alert_key, g.condition_id, g.outcome_side as side, a.asset_id, g.ts as created_at, g.pred, g.wallet_address,
      coalesce((select case when best_ask > 0 and best_ask < 1 then best_ask when last_trade_price > 0 and last_trade_price < 1 then last_trade_price end from asset_ticks t where t.asset_id = a.asset_id and t.snapshot_at <= g.ts order by t.snapshot_at desc limit 1),
        case when cached_price > 0 and cached_price < 1 then cached_price end) as price
      from gated g join assets a on a.condition_id = g.condition_id and a.side = g.outcome_side""",
    "entries": "select *, cast(5 as double) as cost_usd, cast(5 as double) / price as shares from priced where price > 0 and price < 1",
    "booked": "select e.*, case when r.condition_id is not null and cast(substr(condition_id, 2) as bigint) % 3 <> 0 then case when (side = 'YES') = (outcome_yes_won = 1) then shares else 0 end end as proceeds from entries e left join resolutions r using (condition_id)",
    "settled": "select *, proceeds - cost_usd as pnl from booked",
}


def _gate_alerts(spark, sf_dir):
    """Alerts of the gate, built once: prices and ledgers read them several times, and each time would build all features."""
    return built_once(spark, f"gate alerts {sf_dir}", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")], lambda: _built_gate_alerts(spark, sf_dir))


def _built_gate_alerts(spark, sf_dir):
    g = detectors.gate_alerts(model.scored(_examples(spark, sf_dir)), ["sports", "crypto", "tech"])
    g = g.select("tx_hash", "asset_id", "wallet_address", "condition_id", "side", "pred", "implied_prob_at_buy", "ts")
    return detectors.alerts(g, "gate_buy", F.concat_ws("|", "tx_hash", "asset_id", "wallet_address"), F.lit("med"), F.lit("model edge"), F.col("ts"))


def _priced(spark, sf_dir):
    """Trades are the ticks; of several of one second the highest price counts, as fill prices have it."""
    t = views.trades(spark, sf_dir).select("asset_id", F.col("ts").alias("snapshot_at"), (F.col("price") + 0.01).alias("best_ask"), F.col("price").alias("last_trade_price"))
    return ledger.fill_prices(ledger.gate_signals(_gate_alerts(spark, sf_dir)), ledger.outcome_assets(views.market_cache(spark, sf_dir)), t)


def _ledger(spark, sf_dir):
    sized = ledger.size_entries(_priced(spark, sf_dir)).select(F.concat(F.lit("entry-"), "alert_key").alias("trade_id"), F.lit("entry").alias("trade_kind"), F.lit(None).cast("string").alias("parent_trade_id"), "alert_key", "source", "rule_variant", "condition_id", "asset_id", "shares", "price", "cost_usd", F.col("created_at").alias("ts"))
    won = views.resolutions(spark, sf_dir).select("condition_id", F.col("outcome_yes_won").cast("double").alias("w"))
    cache = views.market_cache(spark, sf_dir).hint("merge").join(won, "condition_id").withColumns({"outcome_prices": F.array("w", 1 - F.col("w")), "active": F.substring("condition_id", 2, 20).cast("long") % 3 == 0})
    entries = scratch_table(sized, "entries")
    return entries.unionByName(ledger.book_exits(entries, cache, 1_700_000_000))


@query("select alert_key, condition_id, side, asset_id, created_at, round(price + 3e-12, 8) as price from priced", **_GATED)
def fill_price_asof(spark, sf_dir):
    return _priced(spark, sf_dir).select("alert_key", "condition_id", "side", "asset_id", "created_at", "price")


@query("select alert_key, condition_id, asset_id, round(shares + 3e-12, 8) as shares, round(price + 3e-12, 8) as price, cost_usd from entries", **_GATED)
def ledger_entries(spark, sf_dir):
    return ledger.size_entries(_priced(spark, sf_dir)).select("alert_key", "condition_id", "asset_id", "shares", "price", "cost_usd")


@query("select alert_key, condition_id, asset_id, round(proceeds + 3e-12, 8) as proceeds, round(pnl + 3e-12, 8) as pnl from settled", **_GATED)
def ledger_settled(spark, sf_dir):
    return ledger.settled(_ledger(spark, sf_dir)).select("alert_key", "condition_id", "asset_id", "proceeds", "pnl")


@query("select alert_key, condition_id, asset_id, round(cost_usd + 3e-12, 8) as cost_usd from settled where pnl is null", **_GATED)
def open_positions(spark, sf_dir):
    return ledger.open_positions(_ledger(spark, sf_dir)).select("alert_key", "condition_id", "asset_id", "cost_usd")


@query("select 'gate_buy' as source, cast(null as varchar) as rule_variant, count(*) filter (pnl is null) as open, count(pnl) as resolved, round(sum(pnl) + 3e-12, 8) as pnl, round(avg(case when pnl > 0 then 1.0 when pnl <= 0 then 0.0 end) + 3e-12, 8) as win_rate from settled", **_GATED)
def pnl_by_source(spark, sf_dir):
    return ledger.pnl_by(_ledger(spark, sf_dir), "source", "rule_variant")


@query("""select case when pred < 0.6 then '0.5-0.6' when pred < 0.7 then '0.6-0.7' when pred < 0.8 then '0.7-0.8' when pred < 0.9 then '0.8-0.9' else '0.9-1.0' end as bucket, count(*) filter (pnl is null) as open, count(pnl) as resolved,
  round(coalesce(sum(pnl), 0) + 3e-12, 8) as pnl, round(coalesce(avg(case when pnl > 0 then 1.0 when pnl <= 0 then 0.0 end), 0) + 3e-12, 8) as win_rate from settled where pred >= 0.5 group by 1""", **_GATED)
def pnl_by_pred_bucket(spark, sf_dir):
    return ledger.pnl_by_prediction(_ledger(spark, sf_dir), _gate_alerts(spark, sf_dir))


@query("select wallet_address, count(*) as entries, round(coalesce(sum(pnl), 0) + 3e-12, 8) as pnl from settled group by wallet_address", **_GATED)
def wallet_leaderboard(spark, sf_dir):
    return ledger.wallet_leaderboard(_ledger(spark, sf_dir), _gate_alerts(spark, sf_dir))


@query("select round(coalesce(sum(pnl), 0) + 3e-12, 8) as realized_pnl, count(*) filter (pnl is null) as open_positions, count(pnl) as closed_positions, round(1000 + coalesce(sum(pnl), 0) + 3e-12, 8) as nav, round(coalesce(sum(pnl), 0) / 10 + 3e-12, 8) as return_pct from settled", **_GATED)
def ledger_summary(spark, sf_dir):
    return ledger.summary(_ledger(spark, sf_dir))


@query(f"select event_slug as alert_key, 'mispricing' as source, condition_id, target_side as side, cast(null as varchar) as rule_variant, 1700000000 as created_at from ({_MISPRICED}) where abs(fair_price - current_price) >= 0.01")
def mispricing_signals(spark, sf_dir):
    a = detectors.mispricing_alerts(views.event_markets(spark, sf_dir))
    return ledger.mispricing_signals(detectors.alerts(a, "mispricing", F.col("event_slug"), F.col("severity"), F.lit("mispriced"), F.lit(1_700_000_000)), 0.01)


# -- model reports --------------------------------------------------------------------------------


@query("""select condition_id, case when k <= round(n * 0.7) then 'train' when k <= round(n * 0.7) + round(n * 0.15) then 'validation' else 'test' end as split
  from (select *, row_number() over (order by resolved_at, condition_id) as k, cast(count(*) over () as double) as n from resolutions)""")
def temporal_split(spark, sf_dir):
    return model.temporal_split(views.resolutions(spark, sf_dir))


_EDGE_SQL = "count(*) filter (pred > implied_prob_at_buy) as n_taken, round(coalesce(avg(label_won - implied_prob_at_buy) filter (pred > implied_prob_at_buy), -1) + 3e-12, 8) as edge"


@query(f"select {_EDGE_SQL} from scored", **_SQL_FEATURES)
def realized_edge(spark, sf_dir):
    return model.realized_edge(model.scored(_examples(spark, sf_dir)))


_MEAN_EDGE = "count(*) as n, round(avg(label_won - implied_prob_at_buy) + 3e-12, 8) as mean_edge from scored"


@query(f"""select case when implied_prob_at_buy < 0.1 then 0 when implied_prob_at_buy < 0.2 then 1 when implied_prob_at_buy < 0.3 then 2 when implied_prob_at_buy < 0.4 then 3 when implied_prob_at_buy < 0.5 then 4 when implied_prob_at_buy < 0.6 then 5
  when implied_prob_at_buy < 0.7 then 6 when implied_prob_at_buy < 0.8 then 7 when implied_prob_at_buy < 0.9 then 8 else 9 end as decile, {_MEAN_EDGE} where pred > implied_prob_at_buy group by 1""", **_SQL_FEATURES)
def edge_by_decile(spark, sf_dir):
    return model.edge_by_decile(model.scored(_examples(spark, sf_dir)))


@query(f"""select case when v < 250000 then '<250K' when v < 1000000 then '250K-1M' when v < 5000000 then '1M-5M' when v < 25000000 then '5M-25M' else '25M+' end as bucket, {_MEAN_EDGE}
  join (select condition_id, total_volume_usd * total_volume_usd * 10 as v from per_market) using (condition_id) where pred > implied_prob_at_buy group by 1""", **_SQL_FEATURES)
def edge_by_volume(spark, sf_dir):
    """Volumes of the tables are small; their squares spread over the buckets."""
    m = views.markets(spark, sf_dir).withColumn("total_volume_usd", F.col("total_volume_usd") * F.col("total_volume_usd") * 10)
    return model.edge_by_volume(model.scored(_examples(spark, sf_dir)), m)


@query(f"select coalesce(top_category, '__none__') as category, count(*) as n, {_EDGE_SQL} from scored group by 1", **_SQL_FEATURES)
def edge_by_category(spark, sf_dir):
    return model.edge_by_category(model.scored(_examples(spark, sf_dir)))


@query("""select round(sum(case when label_won = 1 then r else 0 end) - sum(label_won) * (sum(label_won) + 1) / 2.0 + 3e-12, 8) / (sum(label_won) * sum(1 - label_won)) as auc from (
  select label_won, rank() over (order by pred) + (count(*) over (partition by pred) - 1) / 2.0 as r from scored)""".replace("select round(sum", "select round((sum", 1).replace(" / 2.0 + 3e-12, 8) / (sum(label_won) * sum(1 - label_won)) as auc", " / 2.0) / (sum(label_won) * sum(1 - label_won)) + 3e-12, 8) as auc", 1), **_SQL_FEATURES)
def auc(spark, sf_dir):
    return model.auc(model.scored(_examples(spark, sf_dir)))


@query(
    """select round(avg(case when (pred >= 0.5) = (label_won = 1) then 1.0 else 0 end) + 3e-12, 8) as accuracy, round(avg(case when label_won = 1 then -ln(pred) else -ln(1 - pred) end) + 3e-12, 8) as log_loss,
    round(avg(label_won - implied_prob_at_buy) filter (top_category in ('sports', 'esports') and pred > implied_prob_at_buy) + 3e-12, 8) as filtered_edge from scored""",
    **_SQL_FEATURES,
)
def classification(spark, sf_dir):
    return model.classification(model.scored(_examples(spark, sf_dir)), ["sports", "esports"])


# -- table queries --------------------------------------------------------------------------------


@query("select wallet_address, tx_hash, asset_id, ts, round(notional_usd + 3e-12, 8) as notional_usd from (select *, row_number() over (partition by wallet_address order by ts desc, tx_hash, asset_id) as k from trades) where k <= 5")
def newest_trades(spark, sf_dir):
    return report.newest_per_key(views.trades(spark, sf_dir), ["wallet_address"], "ts", 5, ["tx_hash", "asset_id"]).select("wallet_address", "tx_hash", "asset_id", "ts", "notional_usd")


@query("select asset_id, max(snapshot_at) as snapshot_at, arg_max(mid_price, snapshot_at) as mid_price, arg_max(spread, snapshot_at) as spread from ticks group by asset_id")
def latest_tick(spark, sf_dir):
    return report.latest_per_key(views.ticks(spark, sf_dir), ["asset_id"], "snapshot_at").select("asset_id", "snapshot_at", "mid_price", "spread")


@query("select condition_id, count(*) as n from trades group by condition_id")
def trades_per_market(spark, sf_dir):
    return report.counts(views.trades(spark, sf_dir), ["condition_id"])


@query("select event_slug, count(yes_price) as n_priced, round(sum(yes_price) + 3e-12, 8) as price_sum, round(sum(yes_price) - 1 + 3e-12, 8) as deviation from event_markets group by event_slug having count(yes_price) >= 2 and abs(sum(yes_price) - 1) >= 0.03 order by abs(sum(yes_price) - 1) desc, event_slug limit 20")
def high_deviation_events(spark, sf_dir):
    return report.high_deviation(detectors.event_price_sum(views.event_markets(spark, sf_dir)), 0.03, 20)


@query("""select 'mid_price' as "column", count(*) filter (event_id % 10 = 3) as mismatches from ticks where event_id % 17 <> 0 union all select 'spread', 0 union all select '_only_left', count(*) from ticks where event_id % 17 = 0 union all select '_only_right', 0""")
def dataset_diff(spark, sf_dir):
    t = views.ticks(spark, sf_dir).select("asset_id", "snapshot_at", "mid_price", "spread", "event_id")
    other = t.where("event_id % 17 <> 0").withColumn("mid_price", F.when(F.col("event_id") % 10 == 3, F.col("mid_price") + 1).otherwise(F.col("mid_price") * (1 + 1e-12)))
    return report.dataset_diff(t.drop("event_id"), other.drop("event_id"), ["asset_id", "snapshot_at"])
