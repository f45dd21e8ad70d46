"""Registered queries of market selection, resolutions, state and feature upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.functions.categories import categorize_tags, primary_category
from oddsmill.operators import corpus, features
from oddsmill.plans import views
from oddsmill.plans.queries import _CATEGORIZED, _SQL_FEATURES, _TAGGED, _examples, _tagged
from oddsmill.plans.registry import query
from oddsmill.streaming import state


def _key():
    return F.substring("condition_id", 2, 20).cast("long")



def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("condition_id", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))


# -- which markets --------------------------------------------------------------------------------


def _tagged_events(spark, sf_dir):
    """Events of one market each: closed unless the key divides by 4; volumes from 0 to 1.4 million."""
    p = _part(spark, sf_dir).join(_tagged(spark, sf_dir).select("condition_id", "tags"), "condition_id")
    market = F.struct(F.when(F.col("p_partkey") % 11 != 0, F.col("condition_id")).alias("condition_id"), (F.col("p_partkey") % 6 != 0).alias("closed"), ((F.col("p_partkey") % 15) * 100_000.0).alias("volume_usd"))
    return p.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("slug"), (F.col("p_partkey") % 4 != 0).alias("closed"), "tags", F.array(market).alias("markets"))


_VOLUMES = "select condition_id, cast(substr(condition_id, 2) as bigint) as k, cast(substr(condition_id, 2) as bigint) % 15 * 100000.0 as v, coalesce(found[1], 'thesis') as category, found from categorized"


@query("select condition_id, 'e' || k as slug, category, cast(v as double) as volume_usd from volumes where k % 4 <> 0 and k % 6 <> 0 and k % 11 <> 0 and v >= case category when 'esports' then 100000 else 1000000 end", tagged=_TAGGED, categorized=_CATEGORIZED, volumes=_VOLUMES)
def qualified_markets(spark, sf_dir):
    return corpus.closed_market_qualifier(_tagged_events(spark, sf_dir)).select("condition_id", "slug", "category", "volume_usd")


@query("select condition_id, cast(v as double) as volume_usd from volumes where k % 11 <> 0 and v >= 300000 and (list_contains(found, 'esports') or list_contains(found, 'tech')) order by v desc, condition_id desc limit 40", tagged=_TAGGED, categorized=_CATEGORIZED, volumes=_VOLUMES)
def live_market_set(spark, sf_dir):
    events = _tagged_events(spark, sf_dir).where(F.col("markets")[0]["condition_id"].isNotNull())
    return corpus.live_market_set(events, ["esports", "tech"], 300_000, 40).select("condition_id", "volume_usd")


@query("select 'm' || p_partkey as condition_id, cast(p_size * 700.0 as double) as volume from part where p_partkey % 5 <> 0 and p_partkey % 3 <> 2 and p_size * 700 >= 10000 and p_partkey % 7 in (0, 2, 5)")
def exchange_qualified(spark, sf_dir):
    p = _part(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, ["determined", "settled", "amended", "closed", "active", "finalized", "disputed"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    m = p.select("condition_id", F.when(F.col("p_partkey") % 5 != 0, "binary").otherwise("scalar").alias("market_type"), F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("result"), (F.col("p_size") * 700.0).alias("volume"), status.alias("status"))
    return corpus.exchange_qualifier(m).select("condition_id", "volume")


@query("select 'm' || p_partkey as condition_id, cast(p_size * 40.0 as double) as volume from part where p_partkey % 4 <> 0 and p_partkey % 3 <> 0 and p_size * 40 >= 1000")
def play_money_qualified(spark, sf_dir):
    m = _part(spark, sf_dir).select("condition_id", (F.col("p_partkey") % 4 != 0).alias("is_resolved"), F.when(F.col("p_partkey") % 3 != 0, "BINARY").otherwise("MULTIPLE_CHOICE").alias("outcome_type"), (F.col("p_size") * 40.0).alias("volume"))
    return corpus.play_money_qualifier(m).select("condition_id", "volume")


@query("select condition_id, closed_at from markets where p_partkey % 4 = 1 order by closed_at desc, condition_id")
def missing_tags(spark, sf_dir):
    m = views.markets(spark, sf_dir).withColumn("tags_json", F.when(F.col("p_partkey") % 4 == 1, "[]").otherwise('["x"]'))
    return corpus.missing_tags(m).select("condition_id", "closed_at")


@query("""select condition_id, case when cast(substr(condition_id, 2) as bigint) % 3 <> 0 then cast(to_json(tags) as varchar) else '["__ERROR__"]' end as tags_json,
  case when cast(substr(condition_id, 2) as bigint) % 3 <> 0 then cast(to_json(case when len(found) > 0 then found else ['thesis'] end) as varchar) else '[]' end as categories_json, case when cast(substr(condition_id, 2) as bigint) % 3 <> 0 then coalesce(found[1], 'thesis') end as category
  from tagged join categorized using (condition_id)""", tagged=_TAGGED, categorized=_CATEGORIZED)
def refresh_tags(spark, sf_dir):
    """Each third market's event is unknown."""
    t = _tagged(spark, sf_dir).select("condition_id", "tags")
    m = t.select("condition_id", F.concat(F.lit("e"), "condition_id").alias("event_slug"), F.lit("old").alias("category"), F.lit("[]").alias("categories_json"), F.lit("[]").alias("tags_json"))
    known = t.where(_key() % 3 != 0).select(F.concat(F.lit("e"), "condition_id").alias("event_slug"), "tags")
    return corpus.refresh_tags(m, known).select("condition_id", "tags_json", "categories_json", "category")


@query("""select asset_id, min(priority) as priority from (select distinct asset_id, 0 as priority from trades where wallet_address in ('w1', 'w2', 'w3', 'w4', 'w5')
  union all select unnest(asset_ids), 1 from market_cache where volume_usd >= 480000) group by asset_id order by priority, asset_id limit 150""")
def tick_universe(spark, sf_dir):
    held = views.trades(spark, sf_dir).where("wallet_address in ('w1', 'w2', 'w3', 'w4', 'w5')")
    return corpus.tick_universe(held, views.market_cache(spark, sf_dir), 480_000, 150)


@query("select condition_id from market_cache where cast(substr(condition_id, 2) as bigint) % 3 <> 0 and volume_usd >= 455000 order by condition_id limit 45")
def whale_universe(spark, sf_dir):
    return corpus.whale_universe(views.market_cache(spark, sf_dir).withColumn("order_book", _key() % 3 != 0), 455_000, 45).select("condition_id")


@query("select condition_id, min(ts) as first_ts, max(ts) as last_ts from trades where cast(substr(condition_id, 2) as bigint) % 5 = 0 group by condition_id")
def truncated_markets(spark, sf_dir):
    m = views.markets(spark, sf_dir).withColumn("truncated_at_offset_cap", (F.col("p_partkey") % 5 == 0).cast("int"))
    return corpus.truncated_markets(m, views.trades(spark, sf_dir)).select("condition_id", "first_ts", "last_ts")


@query("select wallet_address, first_activity_at from first_seen where first_activity_at >= 810000000 - 200 * 86400")
def recent_wallets(spark, sf_dir):
    return corpus.recent_wallets(views.first_seen(spark, sf_dir), 810_000_000, 200).select("wallet_address", "first_activity_at")


# -- resolutions ----------------------------------------------------------------------------------


@query("""select 'm' || p_partkey as condition_id, cast(case p_partkey % 4 when 1 then 1 else 0 end as int) as winning_outcome_index, cast(case p_partkey % 4 when 1 then 0 else 1 end as int) as outcome_yes_won from part where p_partkey % 4 in (1, 2, 3)""")
def price_resolutions(spark, sf_dir):
    """Prices [0.98, 0.97], [0.01, 0.99], [0.99, 0.995] and [1, 0]: the first of them at 0.99 or more wins."""
    prices = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.98, 0.97), (0.01, 0.99), (0.99, 0.995), (1.0, 0.0))])
    m = _part(spark, sf_dir).select("condition_id", F.element_at(prices, (F.col("p_partkey") % 4 + 1).cast("int")).alias("outcome_prices"))
    return corpus.resolve_by_price(m).select("condition_id", "winning_outcome_index", "outcome_yes_won")


@query("select 'm' || p_partkey as condition_id, cast(p_partkey % 5 = 0 as int) as outcome_yes_won from part where p_partkey % 5 in (0, 1)")
def play_money_resolutions(spark, sf_dir):
    said = F.element_at(F.array(F.lit("YES"), F.lit("NO"), F.lit("MKT"), F.lit("CANCEL"), F.lit(None)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return corpus.resolve_play_money(_part(spark, sf_dir).withColumn("resolution", said)).select("condition_id", "outcome_yes_won")


@query("select 'm' || p_partkey as condition_id, cast(p_partkey % 4 = 0 as int) as outcome_yes_won from part where p_partkey % 4 in (0, 1) and p_partkey % 3 <> 0")
def exchange_resolutions(spark, sf_dir):
    said = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("scalar"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    m = _part(spark, sf_dir).withColumns({"result": said, "status": F.when(F.col("p_partkey") % 3 == 0, "disputed").otherwise("finalized")})
    return corpus.resolve_exchange(m).select("condition_id", "outcome_yes_won")


@query("select condition_id, coalesce(closed_at, 1) as resolved_at from resolutions left join per_market using (condition_id)")
def resolution_time_repair(spark, sf_dir):
    m = corpus.repair_close_times(views.markets(spark, sf_dir).withColumn("closed_at", F.lit(0).cast("long")), views.trades(spark, sf_dir))
    return corpus.repair_resolution_times(views.resolutions(spark, sf_dir), m).select("condition_id", "resolved_at")


# -- state and feature upkeep ---------------------------------------------------------------------


@query("select distinct coalesce(category, 'unknown') as category from markets join (select distinct condition_id from trades) using (condition_id) where coalesce(category, 'unknown') in ('tech', 'crypto')")
def unknown_categories(spark, sf_dir):
    enriched = features.enriched_trades(views.trades(spark, sf_dir), views.markets(spark, sf_dir), "polymarket")
    return features.unknown_categories(enriched, ["sports", "esports", "macro"])


@query("select count(*) filter (cast(size as bigint) % 3 = 0) as dropped from trades")
def dropped_duplicates(spark, sf_dir):
    """Each third trade is there twice."""
    t = views.trades(spark, sf_dir)
    return features.dropped_duplicates(t.unionByName(t.where(F.col("size").cast("long") % 3 == 0)))


@query("select tx_hash, asset_id, wallet_address, label_won from examples where cast(size as bigint) % 2 = 1", **_SQL_FEATURES)
def new_examples(spark, sf_dir):
    """Those whose key an earlier build doesn't have."""
    built = views.trades(spark, sf_dir).where(F.col("size").cast("long") % 2 == 0)
    return features.only_new(_examples(spark, sf_dir), built).select("tx_hash", "asset_id", "wallet_address", "label_won")


_SETTLED = """select wallet_address, count(*) as resolved_buys, cast(sum(case when (outcome_side = 'YES') = (outcome_yes_won = 1) then 1 else 0 end) as bigint) as wins, round(sum(case when (outcome_side = 'YES') = (outcome_yes_won = 1) then size else 0 end - notional_usd) + 3e-12, 8) as realized_pnl
  from trades join resolutions using (condition_id) where bs = 'BUY' and ts < 930000000 and resolved_at >= ts and resolved_at >= 930000000 and resolved_at < 960000000 group by wallet_address"""


@query(_SETTLED)
def settled_pending(spark, sf_dir):
    """What resolutions after a snapshot settle of its open buys."""
    t, m, r = views.trades(spark, sf_dir), views.markets(spark, sf_dir), views.resolutions(spark, sf_dir)
    return state.settle_pending(state.wallet_snapshot(t, m, r, 930_000_000), r, 960_000_000)


@query("""select wallet_address, count(*) as buys_count, count(*) as resolved_buys, cast(sum(won) as bigint) as wins, round(sum(avg_price) + 3e-12, 8) as paid, round(sum(size * avg_price) + 3e-12, 8) as spent, round(sum(realized_pnl) + 3e-12, 8) as realized_pnl
  from closed_positions where cast(substr(wallet_address, 2) as bigint) % 3 <> 0 group by wallet_address""")
def warm_start(spark, sf_dir):
    known = views.first_seen(spark, sf_dir).where(F.substring("wallet_address", 2, 20).cast("long") % 3 == 0)
    return state.warm_start(views.closed_positions(spark, sf_dir), known)


@query("""select condition_id, category, closed_at from markets where p_partkey % 7 <> 0 union all select 'm' || p_partkey, 'live', null from part where p_partkey % 7 = 0""")
def live_metadata(spark, sf_dir):
    known = views.markets(spark, sf_dir).select("condition_id", "category", "closed_at")
    return state.live_metadata(known, _part(spark, sf_dir).where("p_partkey % 7 = 0").select("condition_id", F.lit("live").alias("category")))


@query("""select wallet_address, trades_30d, category_counts, n_pending, wins, round(realized_pnl + 3e-12, 8) as realized_pnl from (select wallet_address, count(*) filter (ts >= 800000000 - 2592000) as trades_30d, cast(coalesce(sum(case when bs = 'BUY' and not coalesce(resolved_at >= ts and resolved_at < 800000000, false) then 1 end), 0) as int) as n_pending,
    cast(coalesce(sum(case when bs = 'BUY' and resolved_at >= ts and resolved_at < 800000000 then case when (outcome_side = 'YES') = (outcome_yes_won = 1) then 1 else 0 end end), 0) as bigint) as wins,
    coalesce(sum(case when bs = 'BUY' and resolved_at >= ts and resolved_at < 800000000 then case when (outcome_side = 'YES') = (outcome_yes_won = 1) then size else 0 end - notional_usd end), 0) as realized_pnl
    from trades left join resolutions using (condition_id) where ts < 800000000 group by wallet_address)
  left join (select wallet_address, string_agg(category || ':' || n, ',' order by category) as category_counts from (select wallet_address, coalesce(category, 'unknown') as category, count(*) as n from trades join markets using (condition_id) where ts < 800000000 and bs = 'BUY' group by all) group by wallet_address) using (wallet_address)""")
def wallet_state_lists(spark, sf_dir):
    """The rest of a wallet's state: trades of the last 30 days, buys by category, open buys, wins and profit."""
    s = state.wallet_snapshot(views.trades(spark, sf_dir), views.markets(spark, sf_dir), views.resolutions(spark, sf_dir), 800_000_000)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("category_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return s.select("wallet_address", F.size("recent_ts").cast("long").alias("trades_30d"), F.when(F.col("category_counts").isNotNull(), counts).alias("category_counts"), F.size("pending").alias("n_pending"), "wins", "realized_pnl")


@query("""select condition_id, list_aggregate(list_transform(list_sort(list({'k': -k, 'p': price})), lambda x: cast(cast(round(x.p * 100) as int) as varchar)), 'string_agg', ',') as recent_prices from (
  select *, row_number() over (partition by condition_id order by ts desc, tx_hash desc, asset_id desc) as k from trades where ts < 900000000) where k <= 20 group by condition_id""")
def market_recent_prices(spark, sf_dir):
    """The last twenty prices of a market, in cents and oldest first."""
    s = state.market_snapshot(views.trades(spark, sf_dir), 900_000_000)
    return s.select("condition_id", F.array_join(F.transform("recent_prices", lambda p: F.round(p * 100).cast("int").cast("string")), ",").alias("recent_prices"))


@query("""select condition_id, case when len(found) > 0 then array_to_string(list_sort(found), ',') else 'thesis' end as flags from categorized""", tagged=_TAGGED, categorized=_CATEGORIZED)
def category_flags(spark, sf_dir):
    """All nine flags of a market, from its list of categories or, where that is empty, its category."""
    found = categorize_tags(F.col("tags"))
    m = _tagged(spark, sf_dir).select("condition_id", F.when(_key() % 2 == 0, F.to_json(found)).when(F.size(found) > 1, F.to_json(found)).otherwise("[]").alias("categories_json"), primary_category(F.col("tags")).alias("category"))
    flags = features.category_flags()
    named = F.array_sort(F.array_compact(F.array(*[F.when(c == 1, k.removeprefix("cat_")) for k, c in flags.items()])))
    return m.select("condition_id", F.array_join(named, ",").alias("flags"))
