"""Registered queries of further detectors, signals, the ledger and model preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.operators import detectors, ledger, model
from oddsmill.plans import views
from oddsmill.plans.queries import _CATEGORIZED, _GATED, _MOVES, _SEEDS, _SKILL, _SQL_FEATURES, _TAGGED, _examples, _gate_alerts, _ledger, _priced, _seeds, _tagged
from oddsmill.plans.registry import query, rounded
from oddsmill.sources.tables import scratch_table

_CUSTOMERS = "select 'w' || c_custkey as wallet_address, c_custkey from customer"


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("wallet_address"), "c_custkey")


def _body(**fields):
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


# -- detectors ------------------------------------------------------------------------------------


@query(f"select wallet_address, positions, mean_edge, excess_pnl_usd from ({_SKILL}) where positions >= 8 and mean_edge >= 0.02 and excess_pnl_usd >= 5 and wallet_address in (select wallet_address from customers where c_custkey % 3 <> 0)", customers=_CUSTOMERS)
def qualified_wallets(spark, sf_dir):
    board = _customers(spark, sf_dir).where("c_custkey % 3 <> 0")
    skill = detectors.wallet_skill(views.closed_positions(spark, sf_dir))
    return detectors.qualified(rounded(skill), board, 8, 0.02, 5.0).select("wallet_address", "positions", "mean_edge", "excess_pnl_usd")


@query("""select wallet_address, category, count(*) as positions, round(avg(won - avg_price) + 3e-12, 8) as mean_edge, round(sum(realized_pnl) + 3e-12, 8) as excess_pnl_usd from (
  select p.*, case when k % 7 = 0 then 'thesis' when k % 5 <> 0 then coalesce(found[1], 'thesis') end as category from (select *, cast(substr(condition_id, 2) as bigint) as k from closed_positions) p left join categorized using (condition_id))
  where category is not null and avg_price > 0 and avg_price < 1 group by all""", tagged=_TAGGED, categorized=_CATEGORIZED)
def skill_by_category(spark, sf_dir):
    """Each seventh market has no event slug, and each fifth one that is not known."""
    k = F.substring("condition_id", 2, 20).cast("long")
    p = views.closed_positions(spark, sf_dir).withColumn("event_slug", F.when(k % 7 == 0, "").when(k % 5 == 0, "unknown").otherwise(F.concat(F.lit("e"), "condition_id")))
    tags = _tagged(spark, sf_dir).select(F.concat(F.lit("e"), "condition_id").alias("event_slug"), "tags")
    return detectors.skill_by_category(p, tags).select("wallet_address", "category", "positions", "mean_edge", "excess_pnl_usd")


def _event_liquidity(event_markets):
    """An event's own liquidity: that of its most liquid market whose position 17 doesn't divide, else unknown."""
    return event_markets.groupBy("event_slug").agg(F.max(F.when(F.col("position") % 17 != 0, F.col("liquidity_usd"))).alias("liquidity_usd"))


@query("""select event_slug, condition_id from event_markets where event_slug in (select event_slug from event_markets group by event_slug having count(*) between 2 and 8 and min(liquidity_usd) >= 18050 and max(case when position % 17 <> 0 then liquidity_usd end) >= 18200
    and min(case when label like 'Above %' or label like 'under %' or label like '≤ %' or label like '2025-%' or label like 'March %' then 1 else 0 end) = 0)
  and event_slug not in (select event_slug from event_tags where skip)""",
  tagged=_TAGGED, categorized=_CATEGORIZED, event_tags="select event_slug, arg_min(coalesce(found[1], 'thesis'), cast(substr(condition_id, 2) as bigint)) in ('sports', 'esports') as skip from categorized group by event_slug")
def mispricing_eligible(spark, sf_dir):
    """Events and markets have floors of their own. An event's tags are those of its first market."""
    tags = _tagged(spark, sf_dir).groupBy("event_slug").agg(F.min_by("tags", F.substring("condition_id", 2, 20).cast("long")).alias("tags"))
    m = views.event_markets(spark, sf_dir)
    return detectors.mispricing_eligible(m, _event_liquidity(m), 18_200.0, tags, 18_050.0).select("event_slug", "condition_id")


@query("select wallet_address || ':' || ts as alert_key, case when k % 5 <> 0 then condition_id end as condition_id, ts as at from (select *, cast(substr(wallet_address, 2) as bigint) as k from trades) where k % 2 = 0 and k % 5 <> 0 and cast(size as bigint) = 50")
def attribution_triggers(spark, sf_dir):
    k = F.substring("wallet_address", 2, 20).cast("long")
    t = views.trades(spark, sf_dir).where("cast(size as bigint) = 50")
    alerts = t.select(F.concat_ws(":", "wallet_address", F.col("ts").cast("string")).alias("alert_key"), F.when(k % 2 == 0, "velocity").otherwise("whales").alias("detector"), _body(condition_id=F.when(k % 5 != 0, F.col("condition_id"))).alias("body"), F.col("ts").alias("created_at"))
    return detectors.triggers(alerts)


@query("""select distinct wallet_address as address from (select *, count(*) over (partition by condition_id, outcome_side, bs, bucket) as n, stddev_pop(size) over (partition by condition_id, outcome_side, bs, bucket) / avg(size) over (partition by condition_id, outcome_side, bs, bucket) as cv from (
  select *, row_number() over (partition by condition_id, outcome_side, bs, bucket, wallet_address order by ts, tx_hash, asset_id) as r from (select *, cast(floor(ts / 31536000) as bigint) * 31536000 as bucket from trades)) where r = 1 and size > 0) where n >= 4 and cv <= 0.4""")
def candidate_wallets(spark, sf_dir):
    return detectors.candidate_wallets(detectors.burst_wallets(views.trades(spark, sf_dir), bucket=31_536_000), 9).select("address")


@query("""select cast(count(*) filter (f.first_activity_at between lo and hi) as bigint) as inside, cast(count(*) filter (f.first_activity_at < lo or f.first_activity_at > hi) as bigint) as outside, cast(count(*) filter (f.first_activity_at is null) as bigint) as "unknown"
  from customers c left join (select * from first_seen where cast(substr(wallet_address, 2) as bigint) % 9 <> 0) f using (wallet_address) cross join (select min(first_activity_at) as lo, max(first_activity_at) as hi from first_seen semi join seeds using (wallet_address))""", customers=_CUSTOMERS, seeds=_SEEDS)
def candidate_summary(spark, sf_dir):
    seen = views.first_seen(spark, sf_dir)
    known = seen.where(F.substring("wallet_address", 2, 20).cast("long") % 9 != 0)
    return detectors.candidate_summary(_customers(spark, sf_dir), seen.join(_seeds(spark, sf_dir), "wallet_address", "left_semi"), known)


@query("select wallet_address, count(distinct condition_id) as n_markets, count(*) as n_hits, round(sum(notional_usd) + 3e-12, 8) as usd from trades where price >= 0.75 group by wallet_address having count(distinct condition_id) >= 3")
def signature_wallets(spark, sf_dir):
    return detectors.signature_wallets(views.trades(spark, sf_dir), 3, 0.75)


@query("select cast(floor(first_activity_at / 864000) as bigint) * 864000 as bucket, count(*) as wallets from first_seen group by 1")
def creation_histogram(spark, sf_dir):
    return detectors.creation_histogram(views.first_seen(spark, sf_dir), 864_000)


@query("select count(*) as positions, round(sum(realized_pnl) + 3e-12, 8) as pnl, round(sum(realized_pnl) / sum(size * avg_price) + 3e-12, 8) as roi, round(avg(won) + 3e-12, 8) as win_rate from closed_positions semi join seeds using (wallet_address)", seeds=_SEEDS)
def group_performance(spark, sf_dir):
    return detectors.group_performance(views.closed_positions(spark, sf_dir).join(_seeds(spark, sf_dir), "wallet_address", "left_semi"))


# -- signals --------------------------------------------------------------------------------------


@query(f"select t.tx_hash || t.asset_id as alert_key, 'smart_money' as source, condition_id, outcome_side as side, cast(null as varchar) as rule_variant, ts as created_at from trades t join ({_SKILL}) using (wallet_address) where weighted_edge > 0.01 and cast(size as bigint) = 40")
def smart_money_signals(spark, sf_dir):
    t = views.trades(spark, sf_dir).where("cast(size as bigint) = 40")
    alerts = t.select(F.concat("tx_hash", "asset_id").alias("alert_key"), F.lit("smart_money").alias("detector"), _body(wallet_address=F.col("wallet_address"), condition_id=F.col("condition_id"), outcome_side=F.col("outcome_side")).alias("body"), F.col("ts").alias("created_at"))
    return ledger.smart_money_signals(alerts, detectors.wallet_skill(views.closed_positions(spark, sf_dir)), 0.01)


@query("""select condition_id || ':' || outcome_side as alert_key, 'move_attribution' as source, condition_id, outcome_side as side, cast(null as varchar) as rule_variant, 9 as created_at from (
  select condition_id, outcome_side, count(distinct wallet_address) as n, cast(substr(condition_id, 2) as bigint) % 3 as grade from trades group by condition_id, outcome_side) where n >= 8 and grade >= 1""")
def burst_signals(spark, sf_dir):
    per = views.trades(spark, sf_dir).groupBy("condition_id", "outcome_side").agg(F.count_distinct("wallet_address").alias("n"))
    grade = F.element_at(F.array(F.lit("low"), F.lit("med"), F.lit("high")), (F.substring("condition_id", 2, 20).cast("long") % 3 + 1).cast("int"))
    alerts = per.select(F.concat_ws(":", "condition_id", "outcome_side").alias("alert_key"), F.lit("move_attribution").alias("detector"), grade.alias("severity"), _body(condition_id=F.col("condition_id"), outcome_side=F.col("outcome_side"), n_wallets=F.col("n")).alias("body"), F.lit(9).alias("created_at"))
    return ledger.burst_signals(alerts, 8)


@query("""select a.alert_key, 'velocity' as source, 'm' || p.p_partkey as condition_id, v.side, v.rule_variant, a.snapshot_at as created_at from (
    select asset_id || '@' || snapshot_at as alert_key, *, case when cast(asset_id as bigint) % 3 = 0 then cast(asset_id as bigint) + 1 else cast(asset_id as bigint) end as market from moves where not consolidated and abs(change) > 0.05) a
  join part p on p.p_partkey = a.market and cast(p.p_partkey as varchar) = a.asset_id cross join (values ('Yes', 'follow'), ('No', 'fade')) v(side, rule_variant)""", moves=_MOVES)
def velocity_signals(spark, sf_dir):
    """Each asset of the ticks is the YES of the market with its number; each third alert names another market, which has no such asset."""
    moves, number = detectors.velocity(views.ticks(spark, sf_dir), 43_200), F.col("asset_id").cast("long")
    alerts = moves.select(
        F.concat_ws("@", "asset_id", F.col("snapshot_at").cast("string")).alias("alert_key"), F.lit("velocity").alias("detector"), F.when(F.col("consolidated"), "low").when(F.abs("change") > 0.10, "high").otherwise("med").alias("severity"),
        _body(asset_id=F.col("asset_id"), condition_id=F.concat(F.lit("m"), (number + F.when(number % 3 == 0, 1).otherwise(0)).cast("string")), consolidated=F.col("consolidated")).alias("body"), F.col("snapshot_at").alias("created_at"),
    )
    cache = views.market_cache(spark, sf_dir).withColumn("asset_ids", F.array(F.substring("condition_id", 2, 20), F.concat(F.substring("condition_id", 2, 20), F.lit(":NO"))))
    return ledger.velocity_signals(alerts, cache, "med")


@query(f"""select event_slug as alert_key, 'monotone' as source, unnest([condition_id, loose_id]) as condition_id, unnest(['NO', 'YES']) as side, unnest(['strict_no', 'loose_yes']) as rule_variant, 5 as created_at from (
  select event_slug, condition_id, position, yes_price, lead(condition_id) over w as loose_id, lead(yes_price) over w as loose_price, lead(event_slug) over w as same from event_markets window w as (partition by event_slug order by position)) where round(yes_price - loose_price, 6) >= 0.02""")
def monotone_signals(spark, sf_dir):
    """Of neighbours by position in place of an axis, so that there are many."""
    m = views.event_markets(spark, sf_dir).withColumns({"axis": F.lit("higher"), "strictness": -F.col("position").cast("double")})
    v = detectors.monotone_violations(m)
    alerts = v.select(F.col("event_slug").alias("alert_key"), F.lit("monotone").alias("detector"), _body(strict_id=F.col("strict_id"), loose_id=F.col("loose_id"), gap=F.col("gap")).alias("body"), F.lit(5).alias("created_at"))
    return ledger.monotone_signals(alerts)


@query("select alert_key, asset_id, cost_usd from entries where cast(substr(condition_id, 2) as bigint) % 2 = 1", **_GATED)
def new_entries(spark, sf_dir):
    """Signals come twice, and those of even markets are booked already."""
    sized = scratch_table(ledger.size_entries(_priced(spark, sf_dir)), "sized")
    booked = sized.where(F.substring("condition_id", 2, 20).cast("long") % 2 == 0)
    return ledger.new_entries(sized.unionByName(sized.withColumn("created_at", F.col("created_at") + 1)), booked).select("alert_key", "asset_id", "cost_usd")


@query("select alert_key, round(pnl + 3e-12, 8) as pnl from settled where pnl is not null order by pnl desc, 'entry-' || alert_key limit 15", **_GATED)
def best_trades(spark, sf_dir):
    return ledger.extreme_trades(_ledger(spark, sf_dir), 15).select("alert_key", "pnl")


@query("select alert_key, round(pnl + 3e-12, 8) as pnl from settled where pnl is not null order by pnl, 'entry-' || alert_key limit 15", **_GATED)
def worst_trades(spark, sf_dir):
    return ledger.extreme_trades(_ledger(spark, sf_dir), 15, best=False).select("alert_key", "pnl")


@query("select alert_key, created_at from (select alert_key, ts as created_at from gated union all select 'later-' || alert_key, ts from gated where ts % 3 = 0) where created_at >= 980000000 and alert_key not in (select alert_key from entries)", **_GATED)
def unbooked_alerts(spark, sf_dir):
    """Alerts of times that divide by 3 come again under another key, which no entry has."""
    alerts = _gate_alerts(spark, sf_dir).unionByName(_gate_alerts(spark, sf_dir).where("created_at % 3 = 0").withColumn("alert_key", F.concat(F.lit("later-"), "alert_key")))
    return ledger.unbooked_alerts(alerts, _ledger(spark, sf_dir), 980_000_000).select("alert_key", "created_at")


@query("""select alert_key, round(pnl + 3e-12, 8) as pnl, round(1000 + sum(pnl) over (order by exit_ts, 'entry-' || alert_key rows unbounded preceding) + 3e-9, 6) as nav from (select *, 1700000000 as exit_ts from settled where pnl is not null)""", **_GATED)
def nav_curve(spark, sf_dir):
    return ledger.nav_curve(_ledger(spark, sf_dir)).select(F.expr("substring(trade_id, 7)").alias("alert_key"), "pnl", F.round(F.col("nav") + 3e-9, 6).alias("nav"))


@query("select sum(n) as legs, count(distinct event_slug) as events from (select event_slug, count(*) as n from event_markets group by event_slug having count(*) >= 2)".replace("sum(n) as legs", "cast(sum(n) as bigint) as legs"))
def event_legs(spark, sf_dir):
    m = views.event_markets(spark, sf_dir)
    return detectors.event_price_sum(m).agg(F.sum("n_priced").alias("legs"), F.count("event_slug").alias("events"))


# -- model preparation ----------------------------------------------------------------------------

_SPLIT = """select condition_id, case when k <= round(n * 0.7) then 'train' when k <= round(n * 0.7) + round(n * 0.15) then 'validation' else 'test' end as split
  from (select *, row_number() over (order by resolved_at, condition_id) as k, cast(count(*) over () as double) as n from resolutions)"""


@query("select split, count(*) as rows, round(avg(label_won) + 3e-12, 8) as label_rate from examples join split_of using (condition_id) group by split", **_SQL_FEATURES, split_of=_SPLIT)
def split_counts(spark, sf_dir):
    return model.split_counts(model.with_split(_examples(spark, sf_dir), model.temporal_split(views.resolutions(spark, sf_dir))))


@query("""select tx_hash, asset_id, wallet_address, cast(outcome_side = 'NO' as int) as "side=NO", cast(outcome_side = 'YES' as int) as "side=YES", cast(top_category is null as int) as "top_category=__none__", cast(coalesce(top_category, '') = 'crypto' as int) as "top_category=crypto" from examples""", **_SQL_FEATURES)
def one_hot_features(spark, sf_dir):
    """Levels are those of training markets."""
    rows = model.with_split(_examples(spark, sf_dir), model.temporal_split(views.resolutions(spark, sf_dir)))
    rows = scratch_table(rows.select("tx_hash", "asset_id", "wallet_address", "split", *model.CATEGORICAL), "to-encode")  # levels and flags each read them
    levels = model.fit_levels(rows.where("split = 'train'"))
    return model.one_hot(rows, levels).select("tx_hash", "asset_id", "wallet_address", "`side=NO`", "`side=YES`", "`top_category=__none__`", "`top_category=crypto`")


@query("""select category, count(*) as n, count(*) filter (pred > implied_prob_at_buy) as n_taken, round(coalesce(avg(label_won - implied_prob_at_buy) filter (pred > implied_prob_at_buy), -1) + 3e-12, 8) as edge from (
  select s.*, unnest(list_distinct(case when categories_json <> '[]' then list_filter([case when contains(categories_json, '"sports"') then 'sports' end, case when contains(categories_json, '"esports"') then 'esports' end, case when contains(categories_json, '"macro"') then 'macro' end,
    case when contains(categories_json, '"crypto"') then 'crypto' end, case when contains(categories_json, '"tech"') then 'tech' end, case when contains(categories_json, '"thesis"') then 'thesis' end], lambda x: x is not null) when category <> 'unknown' then [category] else [] end)) as flag from scored s) x(y) group by 1""".replace(" x(y)", "").replace("select category,", "select flag as category,"), **_SQL_FEATURES)
def edge_by_flag(spark, sf_dir):
    return model.edge_by_flag(model.scored(_examples(spark, sf_dir)))


def trained_rows(spark, sf_dir):
    """Examples with their split and without what names them, written once: levels, fits and figures each read them."""
    rows = model.split_in_place(_examples(spark, sf_dir), views.resolutions(spark, sf_dir))
    return scratch_table(rows.drop("platform", "tx_hash", "asset_id", "wallet_address"), "examples")


@query(None)
def trained_gate(spark, sf_dir):
    """Trees chosen by validation edge, fitted again and tested once: split, rows, edge, accuracy and log loss of each split."""
    rows = trained_rows(spark, sf_dir)
    return model.train_and_test(rows, {"maxDepth": [2, 4], "stepSize": [0.1], "maxIter": [8]}, n_min=20).metrics
