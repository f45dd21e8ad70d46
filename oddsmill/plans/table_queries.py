"""Registered table queries: sweeps, look-ups, listings and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.operators import detectors, report
from oddsmill.plans import views
from oddsmill.plans.queries import _MOVES, _SKILL
from oddsmill.plans.registry import query


def _alerts(spark, sf_dir):
    """Alerts of large moves, in the store's form."""
    moves = detectors.velocity(views.ticks(spark, sf_dir), 43_200)
    key = F.concat_ws("@", "asset_id", F.col("snapshot_at").cast("string"))
    return moves.select(key.alias("alert_key"), F.when(F.col("consolidated"), "consolidation").otherwise("velocity").alias("detector"), F.col("snapshot_at").alias("created_at"))


@query("select count(distinct snapshot_at) as sweeps from ticks")
def tick_sweeps(spark, sf_dir):
    return report.sweeps(views.ticks(spark, sf_dir))


@query("select distinct wallet_address from trades where condition_id = 'm7' and ts >= 850000000")
def wallets_on_market(spark, sf_dir):
    return report.wallets_on_market(views.trades(spark, sf_dir), "m7", 850_000_000)


@query("select snapshot_at, mid_price from ticks t where asset_id = '3' and mid_price is not null and snapshot_at <= (select max(snapshot_at) - 86400 from ticks where asset_id = '3') and snapshot_at > (select max(snapshot_at) - 86400 from ticks where asset_id = '3') - 864000")
def mids_in_window(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    until = t.where("asset_id = '3'").agg(F.max("snapshot_at")).first()[0] - 86_400
    return report.mids_in_window(t, "3", until, 864_000)


@query("select asset_id, snapshot_at, bid_depth_top5, ask_depth_top5 from ticks where bid_depth_top5 >= 30 and ask_depth_top5 >= 30 order by snapshot_at desc, asset_id limit 40")
def liquid_snapshots(spark, sf_dir):
    out = report.listing(views.ticks(spark, sf_dir), "bid_depth_top5 >= 30 and ask_depth_top5 >= 30", [F.desc("snapshot_at"), "asset_id"], 40)
    return out.select("asset_id", "snapshot_at", "bid_depth_top5", "ask_depth_top5")


@query("select condition_id, round(volume_usd + 3e-12, 8) as volume_usd from market_cache where active order by volume_usd desc, condition_id")
def active_markets(spark, sf_dir):
    return report.listing(views.market_cache(spark, sf_dir), "active", [F.desc("volume_usd"), "condition_id"]).select("condition_id", "volume_usd")


@query("select condition_id, closed_at from markets where backfill_state = 'complete' order by closed_at nulls last, condition_id limit 70")
def markets_by_status(spark, sf_dir):
    return report.listing(views.markets(spark, sf_dir), "backfill_state = 'complete'", [F.asc_nulls_last("closed_at"), "condition_id"], 70).select("condition_id", "closed_at")


@query("select condition_id, p_size from markets where event_slug = (select min(event_slug) from markets)")
def markets_of_event(spark, sf_dir):
    m = views.markets(spark, sf_dir)
    return report.lookup(m, event_slug=m.agg(F.min("event_slug")).first()[0]).select("condition_id", "p_size")


@query("select tx_hash, wallet_address, ts from trades where asset_id = '9:YES' order by ts, tx_hash, wallet_address")
def trades_of_asset(spark, sf_dir):
    return report.listing(report.lookup(views.trades(spark, sf_dir), asset_id="9:YES"), None, ["ts", "tx_hash", "wallet_address"]).select("tx_hash", "wallet_address", "ts")


@query("select asset_id as detector, n, newest from (select case when consolidated then 'consolidation' else 'velocity' end as asset_id, count(*) as n, max(snapshot_at) as newest from (select * from moves order by snapshot_at desc, asset_id || '@' || snapshot_at limit 50) group by 1)", moves=_MOVES)
def alert_summary(spark, sf_dir):
    return report.alert_summary(_alerts(spark, sf_dir))


@query("select wallet_address, first_activity_at, total_trades from first_seen where wallet_address = 'w11'")
def wallet_lookup(spark, sf_dir):
    return report.lookup(views.first_seen(spark, sf_dir), wallet_address="w11")


@query("select condition_id, category from markets where category is null")
def null_lookup(spark, sf_dir):
    """A key that is null finds the rows where it is."""
    return report.lookup(views.markets(spark, sf_dir), category=None).select("condition_id", "category")


@query(f"select wallet_address, winrate, positions from ({_SKILL}) order by winrate desc, wallet_address")
def wallets_by_winrate(spark, sf_dir):
    return report.listing(detectors.wallet_skill(views.closed_positions(spark, sf_dir)), None, [F.desc("winrate"), "wallet_address"]).select("wallet_address", "winrate", "positions")


@query("select condition_id, outcome_side, round(size + 3e-12, 8) as size from closed_positions where wallet_address = 'w4' order by size desc, condition_id, outcome_side")
def positions_of_wallet(spark, sf_dir):
    own = report.lookup(views.closed_positions(spark, sf_dir), wallet_address="w4")
    return report.listing(own, None, [F.desc("size"), "condition_id", "outcome_side"]).select("condition_id", "outcome_side", "size")


@query("select tx_hash, wallet_address, ts from trades where condition_id = 'm12' and ts between 820000000 and 950000000")
def trades_in_time_window(spark, sf_dir):
    return report.in_time_window(views.trades(spark, sf_dir), "m12", 820_000_000, 950_000_000).select("tx_hash", "wallet_address", "ts")
