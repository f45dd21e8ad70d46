"""Signals from alerts, and the ledger of entries and exits that back-tests them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.operators.features import hot_values
from oddsmill.operators.ingest import insert_or_ignore

SEVERITY_RANK = "case severity when 'high' then 2 when 'med' then 1 else 0 end"

#: Share of the bankroll that a source may put into one entry.
FRACTIONS = {"smart_money": 0.01, "move_attribution": 0.01, "velocity": 0.0025, "mispricing": 0.01, "monotone": 0.005, "gate_buy": 0.005}


def _body(path: str, kind: str = "string") -> Column:
    return F.get_json_object("body", f"$.{path}").cast(kind)


def _signals(df: DataFrame, condition: Column, side: Column, variant: Column | None = None) -> DataFrame:
    return df.select("alert_key", F.col("detector").alias("source"), condition.alias("condition_id"), side.alias("side"), (variant if variant is not None else F.lit(None).cast("string")).alias("rule_variant"), "created_at")


def smart_money_signals(alerts: DataFrame, tracked: DataFrame, min_edge: float = 0.0) -> DataFrame:
    own = alerts.where("detector = 'smart_money'").withColumn("wallet_address", _body("wallet_address"))
    own = own.join(tracked.where(F.col("weighted_edge") > min_edge).select("wallet_address"), "wallet_address")
    return _signals(own, _body("condition_id"), _body("outcome_side"))


def burst_signals(alerts: DataFrame, min_wallets: int = 3) -> DataFrame:
    own = alerts.where(f"detector = 'move_attribution' and {SEVERITY_RANK} >= 1").where(_body("n_wallets", "int") >= min_wallets)
    return _signals(own, _body("condition_id"), _body("outcome_side"))


def velocity_signals(alerts: DataFrame, cache: DataFrame, min_severity: str = "high", allow_consolidation: bool = False) -> DataFrame:
    """Two signals for an alert of ``min_severity`` or more in the market that its body names: with the move, by the outcome of its asset, and
    against it, by the first other outcome. Consolidating moves count only if allowed; an asset that isn't the market's gives nothing."""
    own = alerts.where(f"detector = 'velocity' and {SEVERITY_RANK} >= {('low', 'med', 'high').index(min_severity)}").withColumns({"condition_id": _body("condition_id"), "asset_id": _body("asset_id")})
    if not allow_consolidation:
        own = own.where(~F.coalesce(_body("consolidated", "boolean"), F.lit(False)))
    zs = F.arrays_zip("outcomes", "asset_ids")
    market = cache.select("condition_id", zs.alias("zs"))
    is_own = lambda z: z["asset_ids"] == F.col("asset_id")
    first = lambda found: F.try_element_at(found, F.lit(1))["outcomes"]
    found = own.join(market, "condition_id").where(F.exists("zs", is_own))
    sides = F.array(F.struct(F.lit("follow").alias("variant"), F.element_at(F.filter("zs", is_own), -1)["outcomes"].alias("side")), F.struct(F.lit("fade").alias("variant"), first(F.filter("zs", lambda z: ~is_own(z))).alias("side")))
    both = found.withColumn("v", F.explode(sides))
    return _signals(both.where("v.side is not null"), F.col("condition_id"), F.col("v.side"), F.col("v.variant"))


def mispricing_signals(alerts: DataFrame, min_gap: float = 0.05) -> DataFrame:
    own = alerts.where("detector = 'mispricing'").where(F.abs(_body("fair_price", "double") - _body("current_price", "double")) >= min_gap)
    return _signals(own, _body("condition_id"), _body("target_side"))


def monotone_signals(alerts: DataFrame, min_gap: float = 0.02) -> DataFrame:
    own = alerts.where("detector = 'monotone'").where(_body("gap", "double") >= min_gap)
    legs = F.array(F.struct(_body("strict_id").alias("id"), F.lit("NO").alias("side"), F.lit("strict_no").alias("variant")), F.struct(_body("loose_id").alias("id"), F.lit("YES").alias("side"), F.lit("loose_yes").alias("variant")))
    both = own.withColumn("l", F.explode(legs))
    return _signals(both, F.col("l.id"), F.col("l.side"), F.col("l.variant"))


def gate_signals(alerts: DataFrame, min_edge: float = 0.05) -> DataFrame:
    own = alerts.where("detector = 'gate_buy'").where(_body("pred", "double") - _body("implied_prob_at_buy", "double") >= min_edge)
    return _signals(own, _body("condition_id"), _body("side"))


def outcome_assets(cache: DataFrame) -> DataFrame:
    """condition_id, side (trimmed, upper case), asset_id, cached_price; markets whose lists differ in length give none."""
    even = cache.where((F.size("outcomes") == F.size("asset_ids")) & (F.size("outcomes") == F.size("outcome_prices")))
    z = even.select("condition_id", "active", F.explode(F.arrays_zip("outcomes", "asset_ids", "outcome_prices")).alias("z"))
    return z.select("condition_id", "active", F.upper(F.trim("z.outcomes")).alias("side"), F.col("z.asset_ids").alias("asset_id"), F.col("z.outcome_prices").alias("cached_price"))


def as_of(points: DataFrame, known: DataFrame, key: str, value: str, day: int = 86_400, most: int = 5_000_000) -> DataFrame:
    """``points`` (key, at, ...) with the ``value`` of the latest row of ``known`` (key, at, value) at that time or before; null if none. Of
    several rows of that time the largest value counts.

    Both lie in one series of the key. A key that ``known`` has on more than ``most`` rows is cut into days, and a day starts with what the days
    before it left, which are one row each: so a key of long history is many tasks.
    """
    known = known.select(key, "at", value).where(F.col(key).isNotNull())
    hot = hot_values(known, {key: most})[key]
    if hot is None:
        return _carried(points, known, [key], value).drop("_new")
    cold, warm = ((points.join(F.broadcast(hot), key, how), known.join(F.broadcast(hot), key, how)) for how in ("left_anti", "left_semi"))
    return _carried(*cold, [key], value).drop("_new").unionByName(_as_of_days(*warm, key, value, day))


def _carried(points: DataFrame, known: DataFrame, by: list[str], value: str) -> DataFrame:
    """``points`` with the last ``value`` known before them in the series of ``by``."""
    both = points.withColumn("_new", F.lit(1)).unionByName(known.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy(*by).orderBy("at", "_new", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(past)).where("_new = 1")


def _as_of_days(points: DataFrame, known: DataFrame, key: str, value: str, day: int) -> DataFrame:
    points, known = (df.withColumn("_day", F.floor(F.col("at") / day)) for df in (points, known))
    left = known.groupBy(key, "_day").agg(F.max_by(value, F.struct("at", value)).alias("_left"))
    days = points.select(key, "_day").distinct().join(left, [key, "_day"], "full")
    past = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_left", F.last("_left", ignorenulls=True).over(past))
    carried = _carried(points, known, [key, "_day"], value)
    return carried.join(days, [key, "_day"]).withColumn(value, F.coalesce(value, "_left")).drop("_left", "_new", "_day")


def fill_prices(signals: DataFrame, assets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Signals with the price of their asset as of created_at: the latest tick's best ask, its last trade, or the cached
    price, whichever first lies in (0, 1). ``assets`` grow with the markets; they are merged, as their files look small enough to broadcast."""
    s = signals.withColumn("side", F.upper(F.trim("side"))).join(assets.select("condition_id", "side", "asset_id", "cached_price").hint("merge"), ["condition_id", "side"])
    last = as_of(s.withColumn("at", F.col("created_at")), ticks.select("asset_id", F.col("snapshot_at").alias("at"), F.struct("best_ask", "last_trade_price").alias("t")), "asset_id", "t").drop("at")

    def valid(c: Column) -> Column:
        return F.when((c > 0) & (c < 1), c)

    return last.withColumn("price", F.coalesce(valid(F.col("t.best_ask")), valid(F.col("t.last_trade_price")), valid(F.col("cached_price")))).drop("t")


def size_entries(priced: DataFrame, bankroll: float = 1000.0, min_cost: float = 0.5) -> DataFrame:
    """Cost by the source's fraction of a constant bankroll; prices outside (0, 1) and small costs are rejected."""
    fraction = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in FRACTIONS.items()], F.lit(0.0))
    out = priced.withColumn("cost_usd", F.lit(bankroll) * fraction).where((F.col("cost_usd") >= min_cost) & (F.col("price") > 0) & (F.col("price") < 1))
    return out.withColumn("shares", F.col("cost_usd") / F.col("price"))


def new_entries(sized: DataFrame, ledger: DataFrame) -> DataFrame:
    key = ["alert_key", "_variant"]
    tagged = [df.withColumn("_variant", F.coalesce("rule_variant", F.lit(""))) for df in (sized, ledger)]
    return insert_or_ignore(tagged[0], tagged[1], key, ["created_at", "asset_id"]).drop("_variant")


def resolved_assets(cache: DataFrame) -> DataFrame:
    """Winning asset of inactive markets with one price of exactly 1 and a sum of 1."""
    total = F.aggregate("outcome_prices", F.lit(0.0), lambda a, x: a + x)
    won = F.filter(F.arrays_zip("asset_ids", "outcome_prices"), lambda z: z["outcome_prices"] == 1.0)
    return cache.where(~F.col("active") & (total == 1.0) & (F.size(won) == 1)).select("condition_id", won[0]["asset_ids"].alias("winning_asset"))


def open_positions(ledger: DataFrame) -> DataFrame:
    """Entries without an exit, oldest first."""
    exits = ledger.where("trade_kind = 'exit'").select(F.col("parent_trade_id").alias("trade_id"))
    return ledger.where("trade_kind = 'entry'").join(exits, "trade_id", "left_anti").orderBy("ts", "trade_id")


def book_exits(ledger: DataFrame, cache: DataFrame, at: int) -> DataFrame:
    """Exit rows of open entries on resolved markets: a share is worth 1 if it won, else 0."""
    own = open_positions(ledger).join(resolved_assets(cache).hint("merge"), "condition_id")
    worth = (F.col("asset_id") == F.col("winning_asset")).cast("double")
    return own.select(F.concat(F.lit("exit-"), "trade_id").alias("trade_id"), F.lit("exit").alias("trade_kind"), F.col("trade_id").alias("parent_trade_id"), "alert_key", "source", "rule_variant", "condition_id", "asset_id", "shares", worth.alias("price"), (F.col("shares") * worth).alias("cost_usd"), F.lit(at).alias("ts"))


def settled(ledger: DataFrame) -> DataFrame:
    """Entries with the proceeds and profit of their exit; both null while open."""
    exits = ledger.where("trade_kind = 'exit'").select(F.col("parent_trade_id").alias("trade_id"), F.col("cost_usd").alias("proceeds"), F.col("ts").alias("exit_ts"))
    return ledger.where("trade_kind = 'entry'").join(exits, "trade_id", "left").withColumn("pnl", F.col("proceeds") - F.col("cost_usd"))


def nav_curve(ledger: DataFrame, bankroll: float = 1000.0) -> DataFrame:
    """Net asset value after each exit, in the order of time and trade_id: sums of the days, then of each day's exits."""
    exits = settled(ledger).where("pnl is not null").select("trade_id", "exit_ts", "pnl", F.floor(F.col("exit_ts") / 86_400).alias("day"))
    days = exits.groupBy("day").agg(F.sum("pnl").alias("of_day"))
    days = days.select("day", (F.sum("of_day").over(Window.orderBy("day")) - F.col("of_day")).alias("before"))  # a row for each day
    inside = Window.partitionBy("day").orderBy("exit_ts", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return exits.join(days, "day").select("trade_id", "exit_ts", "pnl", (F.lit(bankroll) + F.col("before") + F.sum("pnl").over(inside)).alias("nav"))


def summary(ledger: DataFrame, bankroll: float = 1000.0) -> DataFrame:
    s = settled(ledger).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realized_pnl"), F.count(F.when(F.col("pnl").isNull(), 1)).alias("open_positions"), F.count("pnl").alias("closed_positions"))
    return s.withColumns({"nav": F.lit(bankroll) + F.col("realized_pnl"), "return_pct": F.col("realized_pnl") / bankroll * 100})


def pnl_by(ledger: DataFrame, *by: str) -> DataFrame:
    own = settled(ledger)
    return own.groupBy(*by).agg(F.count(F.when(F.col("pnl").isNull(), 1)).alias("open"), F.count("pnl").alias("resolved"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))


def pnl_by_prediction(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    """The gate's entries by their alert's prediction, 0.5 or more, in tenths; 0.9 and over are the last bucket."""
    own = settled(ledger.where("source = 'gate_buy'")).join(alerts.select("alert_key", _body("pred", "double").alias("pred")), "alert_key").where("pred >= 0.5")
    label = F.when(F.col("pred") < 0.6, "0.5-0.6").when(F.col("pred") < 0.7, "0.6-0.7").when(F.col("pred") < 0.8, "0.7-0.8").when(F.col("pred") < 0.9, "0.8-0.9").otherwise("0.9-1.0")
    return own.groupBy(label.alias("bucket")).agg(
        F.count(F.when(F.col("pnl").isNull(), 1)).alias("open"), F.count("pnl").alias("resolved"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"), F.coalesce(F.avg((F.col("pnl") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
    )


def wallet_leaderboard(ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    own = settled(ledger).join(alerts.select("alert_key", _body("wallet_address").alias("wallet_address")), "alert_key").where("wallet_address is not null")
    return own.groupBy("wallet_address").agg(F.count("*").alias("entries"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl")).orderBy(F.desc("pnl"), "wallet_address")


def extreme_trades(ledger: DataFrame, n: int = 5, best: bool = True) -> DataFrame:
    return settled(ledger).where("pnl is not null").orderBy(F.desc("pnl") if best else F.asc("pnl"), "trade_id").limit(n)


def unbooked_alerts(alerts: DataFrame, ledger: DataFrame, since: int) -> DataFrame:
    return alerts.where(F.col("created_at") >= since).join(ledger.where("trade_kind = 'entry'").select("alert_key"), "alert_key", "left_anti")


def dedupe_alerts(new: DataFrame, known: DataFrame) -> DataFrame:
    return insert_or_ignore(new, known, ["alert_key"], ["created_at", "body"])

