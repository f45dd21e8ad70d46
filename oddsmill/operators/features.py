"""Point-in-time features of every BUY on a resolved market.

Two shuffles carry the build: by market for what was known of the market, its resolution included, by wallet for what was known of the
wallet and for the choice of each key's first row. Resolutions enter a wallet's history as events of their own, so one pass of windows over (time, kind,
transaction, asset) sees trades and outcomes in the order in which they became known.

A market or wallet with more rows than one task should take is cut into spans of thirty days: each starts from what the spans before it
add up to, which is a row a span, so windows never hold the whole history of a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.operators.ingest import first_write_wins
from oddsmill.sources.tables import lanes, scratch_table

ORDER = ("ts", "kind", "tx_hash", "asset_id")
KEY = ("platform", "tx_hash", "asset_id", "wallet_address")
DAYS_30 = 30 * 86_400
SLOTS = 2**16
CATEGORIES = ("sports", "esports", "thesis", "macro", "geopolitics", "elections", "crypto", "tech", "culture")


def enriched_trades(trades: DataFrame, markets: DataFrame, platform: str) -> DataFrame:
    """Trades with their market's category (null: ``unknown``), categories and closing time."""
    known = markets.where(F.col("platform") == platform).select("platform", "condition_id", F.coalesce("category", F.lit("unknown")).alias("category"), "categories_json", "closed_at")
    return trades.where(F.col("platform") == platform).join(known.drop("platform"), "condition_id")


def unknown_categories(enriched: DataFrame, known: Iterable[str]) -> DataFrame:
    """Categories that are none of ``known``, for a build to refuse."""
    return enriched.select("category").distinct().where(~F.col("category").isin("unknown", *known))


def resolution_events(enriched: DataFrame, resolutions: DataFrame) -> DataFrame:
    """An event for each BUY whose market resolved at the time of the trade or later."""
    won = ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("long")
    bought = enriched.where("bs = 'BUY'").join(resolutions.select("platform", "condition_id", "outcome_yes_won", "resolved_at"), ["platform", "condition_id"]).where("resolved_at >= ts")
    pnl = F.when(won == 1, F.col("size")).otherwise(0.0) - F.col("notional_usd")
    return bought.select("platform", "wallet_address", "condition_id", "tx_hash", "asset_id", F.lit(1).alias("kind"), F.col("resolved_at").alias("ts"), won.alias("won"), pnl.alias("pnl"))


def hot_values(df: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame | None]:
    """For each column of ``limits`` its values on more rows than that, None where there are none. One pass counts all columns by hash slots, which combine
    before the shuffle; only the values of a slot over the limit are then counted one by one. Empty and null values are never hot."""
    both = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in limits])).alias("x")).select("x.*").where("key <> ''")
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(most)) for k, most in limits.items()])
    both = both.withColumn("slot", F.pmod(F.xxhash64("kind", "key"), F.lit(SLOTS)))
    full = scratch_table(both.groupBy("kind", "slot").agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"), "full-slots")
    if full.isEmpty():
        return dict.fromkeys(limits)
    hot = scratch_table(both.join(F.broadcast(full), ["kind", "slot"], "left_semi").groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit), "hot-keys")
    found = {r["kind"] for r in hot.select("kind").distinct().collect()}  # a row for each column at most
    return {k: hot.where(F.col("kind") == k).select(F.col("key").alias(k)) if k in found else None for k in limits}


def hot_keys(enriched: DataFrame, most: int) -> dict[str, DataFrame | None]:
    """Markets with more than ``most`` trades and wallets that may have more than ``most`` events (a trade has one resolution at most), of which there
    are no more than the trades divided by ``most``, twice."""
    return hot_values(enriched, {"condition_id": most, "wallet_address": most / 2})


def _in_spans(df: DataFrame) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col("ts") / DAYS_30))


def market_features(enriched: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """What was known of the market before each trade; ``hot`` markets are cut into spans."""
    if hot is None:
        return _market_windows(enriched.repartition("condition_id"))  # both windows are then met by one shuffle
    cold, warm = (enriched.join(F.broadcast(hot), "condition_id", how) for how in ("left_anti", "left_semi"))
    cold = cold.repartition("condition_id")
    return _market_windows(cold).unionByName(_market_spans(warm))


_TRADE_ORDER = ("ts", "tx_hash", "asset_id", "wallet_address")


def _market_windows(enriched: DataFrame) -> DataFrame:
    rows = enriched
    by_wallet = Window.partitionBy("condition_id", "wallet_address").orderBy("ts", "tx_hash", "asset_id")
    past = Window.partitionBy("condition_id").orderBy(*_TRADE_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    last20 = past.rowsBetween(-20, -1)
    rows = rows.withColumn("_first", (F.row_number().over(by_wallet) == 1).cast("long"))
    return rows.withColumns(
        {
            "market_volume_so_far_usd": F.coalesce(F.sum("notional_usd").over(past), F.lit(0.0)),
            "market_unique_traders_so_far": F.coalesce(F.sum("_first").over(past), F.lit(0)),
            "last_trade_price": F.last("price", ignorenulls=True).over(past),
            "price_volatility_recent": F.when(F.count("price").over(last20) >= 2, F.stddev_pop("price").over(last20)),
            "market_age_seconds": F.col("ts") - F.coalesce(F.min("ts").over(past), F.lit(0)),
            "time_to_resolution_seconds": F.col("closed_at") - F.col("ts"),
        }
    ).drop("_first")


def _market_spans(enriched: DataFrame) -> DataFrame:
    # All trades without a wallet count as one trader, whose first trade is found by a minimum: a window would hold them all.
    by_wallet = Window.partitionBy("condition_id", "wallet_address").orderBy("ts", "tx_hash", "asset_id")
    named = enriched.where("wallet_address <> ''").withColumn("_first", (F.row_number().over(by_wallet) == 1).cast("long"))
    nameless = enriched.where("wallet_address = ''")
    firsts = nameless.groupBy("condition_id").agg(F.min(F.struct("ts", "tx_hash", "asset_id")).alias("_x"))  # a row for each hot market
    nameless = nameless.join(F.broadcast(firsts), "condition_id").withColumn("_first", (F.struct("ts", "tx_hash", "asset_id") == F.col("_x")).cast("long")).drop("_x")
    rows = _in_spans(named.unionByName(nameless))
    span = ["condition_id", "_span"]
    order = Window.partitionBy(*span).orderBy(*_TRADE_ORDER)
    newest = Window.partitionBy(*span).orderBy(*[F.desc(c) for c in _TRADE_ORDER])
    tail = rows.withColumn("_k", F.row_number().over(newest)).where("_k <= 20").groupBy(*span).agg(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), "price"))).alias("_tail"))
    priced = F.when(F.col("price").isNotNull(), F.struct(*_TRADE_ORDER, "price"))
    spans = rows.groupBy(*span).agg(F.sum("notional_usd").alias("_volume"), F.sum("_first").alias("_traders"), F.max(priced)["price"].alias("_price"), F.min("ts").alias("_since")).join(tail, span)
    past_spans = Window.partitionBy("condition_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    spans = spans.select(
        *span, F.coalesce(F.sum("_volume").over(past_spans), F.lit(0.0)).alias("_volume"), F.coalesce(F.sum("_traders").over(past_spans), F.lit(0)).alias("_traders"), F.last("_price", ignorenulls=True).over(past_spans).alias("_price"),
        F.min("_since").over(past_spans).alias("_since"), F.flatten(F.collect_list("_tail").over(past_spans.rowsBetween(-20, -1)))["price"].alias("_tail"),
    )
    past, last20 = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(-20, -1)
    rows = rows.join(spans, span).withColumn("_recent", F.concat("_tail", F.collect_list(F.struct("price")).over(last20)["price"]))
    recent = F.filter(F.slice("_recent", F.greatest(F.size("_recent") - 19, F.lit(1)), 20), lambda p: p.isNotNull())
    n = F.size(recent)
    mean = F.aggregate(recent, F.lit(0.0), lambda a, p: a + p) / n
    spread = F.sqrt(F.aggregate(recent, F.lit(0.0), lambda a, p: a + (p - mean) * (p - mean)) / n)
    return rows.withColumns(
        {
            "market_volume_so_far_usd": F.col("_volume") + F.coalesce(F.sum("notional_usd").over(past), F.lit(0.0)),
            "market_unique_traders_so_far": F.col("_traders") + F.coalesce(F.sum("_first").over(past), F.lit(0)),
            "last_trade_price": F.coalesce(F.last("price", ignorenulls=True).over(past), "_price"),
            "price_volatility_recent": F.when(n >= 2, spread),
            "market_age_seconds": F.col("ts") - F.coalesce("_since", F.min("ts").over(past), F.lit(0)),
            "time_to_resolution_seconds": F.col("closed_at") - F.col("ts"),
        }
    ).drop("_first", "_span", "_volume", "_traders", "_price", "_since", "_tail", "_recent")


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def _history(categories: list[str]) -> dict[str, tuple[Column, str]]:
    """What a wallet's history adds up to: the value of each event and how values are put together."""
    is_trade, is_buy = F.col("kind") == 0, (F.col("kind") == 0) & (F.col("bs") == "BUY")
    out = {
        "trades": (_flag(is_trade), "sum"), "buys": (_flag(is_buy), "sum"), "resolved": (_flag(~is_trade), "sum"), "wins": (F.when(~is_trade, F.col("won")).otherwise(0), "sum"), "pnl": (F.when(~is_trade, F.col("pnl")), "sum"),
        "paid": (F.when(is_buy, F.col("price")), "sum"), "spent": (F.when(is_buy, F.col("notional_usd")), "sum"), "last_ts": (F.when(is_trade, F.col("ts")), "max"),
    }
    for c in categories:
        own = is_buy & (F.col("category") == c)
        out |= {f"n_{c}": (_flag(own), "sum"), f"first_{c}": (F.when(own, F.struct("ts", "tx_hash", "asset_id")), "min")}
    return out


def wallet_features(events: DataFrame, categories: Iterable[str], hot: DataFrame | None = None, finish=lambda df: df, expand=None, tasks: int | None = None, nameless: bool = True) -> DataFrame:
    """What was known of the wallet before each event of ``events`` (trades, kind 0; resolutions, kind 1).

    An anonymous wallet (empty address) has no history: its rows go past the windows, which would put a whole
    venue into one partition. ``hot`` wallets are cut into spans. ``finish`` is applied to each part, which has all rows of its wallets and,
    where it went through windows, is still dealt by wallet. ``expand`` makes the events of ``events``, where those are trades only; the trades
    are then dealt by wallet, to ``tasks`` tasks where given, and their resolutions made behind that shuffle. Where no row is ``nameless``, the rows
    before it are computed once, not once more for the anonymous ones.
    """
    categories = [*dict.fromkeys([*categories, "unknown"])]
    history = _history(categories)
    named, anonymous = events.where("wallet_address <> ''"), events.where("wallet_address = ''")
    if expand is not None:
        named, anonymous = expand(named.repartition(*([tasks] if tasks else []), "wallet_address") if hot is None else named), expand(anonymous)
    all_time = Window.partitionBy("wallet_address")
    first_ts = F.min(F.when(F.col("kind") == 0, F.col("ts")))
    past = all_time.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    old = all_time.orderBy("ts").rangeBetween(Window.unboundedPreceding, -DAYS_30 - 1)

    def over(x: Column, how: str, frame) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[how](x).over(frame)

    def windows(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_{k}": over(x, how, past) for k, (x, how) in history.items()} | {"_first_ts": first_ts.over(all_time), "_old": F.sum(history["trades"][0]).over(old)}).where("kind = 0")

    def spans(df: DataFrame) -> DataFrame:
        """The same from spans: each has the rows of the span before it for context, and the sums of those before that."""
        own = _in_spans(df)
        sums = own.groupBy("wallet_address", "_span").agg(*[{"sum": F.sum, "max": F.max, "min": F.min}[how](x).alias(f"_{k}") for k, (x, how) in history.items()], first_ts.alias("_first_ts"))
        before = all_time.orderBy("_span").rangeBetween(Window.unboundedPreceding, -2)  # a row for each span
        sums = sums.select("wallet_address", "_span", *[over(F.col(f"_{k}"), how, before).alias(f"_before_{k}") for k, (_, how) in history.items()], F.min("_first_ts").over(all_time).alias("_first_ts"))
        both = own.withColumn("_own", F.lit(True)).unionByName(own.withColumns({"_span": F.col("_span") + 1, "_own": F.lit(False)}))
        inside = Window.partitionBy("wallet_address", "_span")
        near = inside.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumns({f"_{k}": over(x, how, near) for k, (x, how) in history.items()} | {"_old": F.sum(history["trades"][0]).over(inside.orderBy("ts").rangeBetween(Window.unboundedPreceding, -DAYS_30 - 1))})
        both = both.where("_own and kind = 0").join(sums, ["wallet_address", "_span"])
        add = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
        joined = {f"_{k}": add[how](F.col(f"_{k}"), F.col(f"_before_{k}")) for k, (_, how) in history.items()}
        joined["_old"] = F.coalesce(F.col("_old") + F.col("_before_trades"), "_old", "_before_trades")
        return both.withColumns(joined).drop("_own", "_span", *[f"_before_{k}" for k in history])

    if hot is None:
        parts = [windows(named)]
    else:
        parts = [windows(named.join(F.broadcast(hot), "wallet_address", "left_anti")), spans(named.join(F.broadcast(hot), "wallet_address", "left_semi"))]
    used = [F.struct((-F.coalesce(f"_n_{c}", F.lit(0))).alias("n"), F.col(f"_first_{c}").alias("first"), F.lit(c).alias("category")) for c in categories]
    parts = [p.withColumn("_by_category", F.filter(F.array(*used), lambda x: x["n"] < 0)).drop(*[f"_{k}_{c}" for c in categories for k in ("n", "first")]) for p in parts]
    if nameless:
        anonymous = anonymous.where("kind = 0").withColumn("_first_ts", F.col("ts"))
        parts.append(anonymous.withColumns({c: F.lit(None).cast(kind) for c, kind in ((x.name, x.dataType) for x in parts[0].schema) if c not in anonymous.columns}))
    out = None
    for rows in parts:
        rows = rows.withColumns({"top_category": F.array_min("_by_category")["category"], "category_diversity": F.coalesce(F.size("_by_category"), F.lit(0)).cast("long")})
        rows = finish(derived_features(rows).drop("_by_category", "kind", "won", "pnl"))
        out = rows if out is None else out.unionByName(rows)
    return out


def derived_features(rows: DataFrame) -> DataFrame:
    """Features of a wallet from what its history adds up to: columns _trades, _buys, _resolved, _wins, _pnl, _paid, _spent, _first_ts,
    _last_ts and _old (trades more than thirty days ago), which go."""
    rows = rows.withColumns(
        {
            "prior_trades_count": F.coalesce("_trades", F.lit(0)),
            "prior_buys_count": F.coalesce("_buys", F.lit(0)),
            "prior_resolved_buys": F.coalesce("_resolved", F.lit(0)),
            "prior_wins": F.coalesce("_wins", F.lit(0)),
            "prior_realized_pnl_usd": F.coalesce("_pnl", F.lit(0.0)),
            "_old": F.coalesce("_old", F.lit(0)),
        }
    )
    resolved, buys = F.col("prior_resolved_buys"), F.col("prior_buys_count")
    win_rate = F.when(resolved > 0, F.col("prior_wins") / resolved)
    paid = F.when(buys > 0, F.col("_paid") / buys)
    bet = F.when(buys > 0, F.col("_spent") / buys)
    sure = F.least(F.lit(1.0), resolved / 20.0)
    rows = rows.withColumns({"win_rate": win_rate, "avg_implied_prob_paid": paid, "avg_bet_size_usd": bet})
    rows = rows.withColumn("realized_edge_pp", F.col("win_rate") - F.col("avg_implied_prob_paid"))
    return rows.withColumns(
        {
            "prior_losses": resolved - F.col("prior_wins"),
            "bet_size_usd": F.col("notional_usd"),
            "bet_size_rel_to_avg": F.when(F.col("avg_bet_size_usd") > 0, F.col("notional_usd") / F.col("avg_bet_size_usd")),
            "bet_size_relative_to_history": F.lit(1.0),
            "median_bet_size_usd": F.lit(None).cast("double"),
            "edge_confidence_weighted": F.col("realized_edge_pp") * sure,
            "win_rate_confidence_weighted": (F.col("win_rate") - 0.5) * sure,
            "is_high_quality_wallet": F.when((resolved >= 20) & (F.col("win_rate") > 0.55), 1).otherwise(0),
            "wallet_age_days": F.greatest(F.lit(0.0), (F.col("ts") - F.col("_first_ts")) / 86_400.0),
            "seconds_since_last_trade": F.col("ts") - F.col("_last_ts"),
            "prior_trades_30d": F.col("prior_trades_count") - F.col("_old"),
        }
    ).drop("_trades", "_buys", "_resolved", "_wins", "_pnl", "_paid", "_spent", "_first_ts", "_last_ts", "_old")


def category_flags() -> dict[str, Column]:
    """``cat_*``: from the market's list of categories, or from its category where the list is empty."""
    listed = F.from_json("categories_json", "array<string>")
    return {f"cat_{c}": F.when(F.size(listed) > 0, F.array_contains(listed, c)).otherwise(F.col("category") == c).cast("int") for c in CATEGORIES}


def build_features(trades: DataFrame, markets: DataFrame, resolutions: DataFrame, platform: str = "polymarket", built_at: int = 0, most: int = 5_000_000) -> DataFrame:
    """``training_examples`` of a platform: a row for each BUY on a resolved market, each key once.

    Nulls: a trade of an unknown market gives no row; a category that is null counts as ``unknown``. Empty
    tables give no rows. Markets and wallets of more than ``most`` rows are cut into spans of time, which changes no value.
    """
    own = trades.where(F.col("platform") == platform)
    hot, tasks = hot_keys(own, most), lanes(trades.sparkSession, own.count())
    nameless = not own.where("wallet_address = ''").isEmpty()
    known = resolutions.where(F.col("platform") == platform).select("condition_id", "outcome_yes_won", "resolved_at", F.lit(True).alias("_ends"))
    if hot["condition_id"] is None:
        own, markets, known = (df.repartition(tasks, "condition_id") for df in (own, markets, known))
        rows = _market_windows(enriched_trades(own, markets, platform).join(known, "condition_id", "left"))  # one shuffle for joins and windows
    else:
        rows = market_features(enriched_trades(own, markets, platform), hot["condition_id"]).join(known, "condition_id", "left")
    finish = lambda df: _first_labelled(df.where("bs = 'BUY' and _ends").drop("_ends"), built_at)
    return wallet_features(rows, CATEGORIES, hot["wallet_address"], finish, _with_resolutions, tasks, nameless)


def _with_resolutions(rows: DataFrame) -> DataFrame:
    """Events of trades that have their market's resolution: each trade (kind 0) and, for a BUY that its market's resolution is not before, the
    resolution (kind 1), of which only what the wallet's history takes stays."""
    won = ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("long")
    pnl = F.when(won == 1, F.col("size")).otherwise(0.0) - F.col("notional_usd")
    kinds = F.when((F.col("bs") == "BUY") & (F.col("resolved_at") >= F.col("ts")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = rows.withColumns({"won": won, "pnl": pnl, "kind": F.explode(kinds)})
    ends, kept = F.col("kind") == 1, ("platform", "wallet_address", "condition_id", "tx_hash", "asset_id", "kind")
    own = {"ts": F.when(ends, F.col("resolved_at")).otherwise(F.col("ts")), "won": F.when(ends, F.col("won")), "pnl": F.when(ends, F.col("pnl"))}
    return both.select(*[F.col(c) if c in kept else own[c].alias(c) if c in own else F.when(~ends, F.col(c)).alias(c) for c in both.columns])


def labelled(rows: DataFrame, resolutions: DataFrame, built_at: int = 0) -> DataFrame:
    """Feature rows of BUYs on resolved markets with their label and flags, each key once."""
    return _first_labelled(rows.join(resolutions.select("condition_id", "outcome_yes_won", "resolved_at"), "condition_id"), built_at)


def _first_labelled(rows: DataFrame, built_at: int) -> DataFrame:
    rows = rows.withColumns(
        {
            "label_won": ((F.col("outcome_side") == "YES") == (F.col("outcome_yes_won") == 1)).cast("int"),
            "side": F.col("outcome_side"),
            "implied_prob_at_buy": F.col("price"),
            "market_category": F.col("category"),
            "built_at": F.lit(built_at),
            **category_flags(),
        }
    )
    return first_write_wins(rows.drop("closed_at", "outcome_yes_won", "categories_json", "category", "outcome_side", "bs", "size", "notional_usd"), KEY, ["ts"])


def only_new(examples: DataFrame, built: DataFrame) -> DataFrame:
    """Examples whose key is not in ``built``, for a build that adds to an earlier one."""
    tasks = lanes(built.sparkSession, built.count())
    return examples.repartition(tasks, *KEY).join(built.select(*KEY).repartition(tasks, *KEY), list(KEY), "left_anti")


def dropped_duplicates(examples: DataFrame) -> DataFrame:
    """How many rows ``first_write_wins`` would drop."""
    return examples.agg((F.count("*") - F.count_distinct(*KEY)).alias("dropped"))
