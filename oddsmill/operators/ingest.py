"""Normalisers from wire payloads, load rules and keyed sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from oddsmill.functions.bigint import hex_to_decimal

#: Least notional of a stored trade by platform.
NOTIONAL_FLOOR = {"polymarket": 10.0, "kalshi": 10.0, "manifold": 100.0}


def first_write_wins(df: DataFrame, key: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def insert_or_ignore(new: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``, the first of each key."""
    return first_write_wins(new, key, order).join(target.select(*key), list(key), "left_anti")


def upsert(new: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``target`` with the rows of ``new`` in place of those with the same key; of ``new`` the last in order stays."""
    last = first_write_wins(new, key, [F.desc(c) if isinstance(c, str) else c for c in order])
    return target.join(last.select(*key), list(key), "left_anti").unionByName(last, allowMissingColumns=True)


def keep_first_provenance(new: DataFrame, target: DataFrame) -> DataFrame:
    """Watchlist rows: known addresses keep source and reason and become active again, new ones are added."""
    seen = new.select("address").distinct().withColumn("_seen", F.lit(True))
    kept = target.join(seen, "address", "left").withColumn("active", F.col("active") | F.coalesce("_seen", F.lit(False))).drop("_seen")
    added = insert_or_ignore(new, target, ["address"], ["added_at", "source"]).withColumn("active", F.lit(True))
    return kept.unionByName(added, allowMissingColumns=True)


def deactivate(target: DataFrame, addresses: DataFrame) -> DataFrame:
    """Watchlist rows with the given addresses switched off; their provenance stays."""
    gone = addresses.select("address").distinct().withColumn("_gone", F.lit(True))
    return target.join(gone, "address", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def load_rules(trades: DataFrame) -> DataFrame:
    """Notional floor by platform, that of ``polymarket`` for others; lower-case wallets where addresses are not case-sensitive."""
    floor = F.coalesce(*[F.when(F.col("platform") == k, F.lit(v)) for k, v in NOTIONAL_FLOOR.items()], F.lit(NOTIONAL_FLOOR["polymarket"]))
    wallet = F.when(F.col("platform") == "polymarket", F.lower("wallet_address")).otherwise(F.col("wallet_address"))
    return trades.where(F.col("notional_usd") >= floor).withColumn("wallet_address", wallet)


def stored_trades(trades: DataFrame) -> DataFrame:
    """``load_rules``, then one row for each key: the earliest, as the first write stays."""
    return first_write_wins(load_rules(trades), ["platform", "tx_hash", "asset_id", "wallet_address"], ["ts", "size", "price", "bs"])


def _number(c: str | Column) -> Column:
    return F.col(c).try_cast(DoubleType()) if isinstance(c, str) else c.try_cast(DoubleType())


def activity_trades(raw: DataFrame) -> DataFrame:
    """Wallet trades from activity payloads (JSON text ``raw``); those without hash, size or price are dropped."""
    a = raw.select(F.from_json("raw", "type string, transactionHash string, asset string, side string, proxyWallet string, conditionId string, size string, price string, usdcSize string, timestamp long").alias("a")).select("a.*")
    a = a.where("type = 'TRADE' and coalesce(transactionHash, '') <> ''").withColumns({"size": _number("size"), "price": _number("price"), "usdcSize": _number("usdcSize")})
    return a.where("size is not null and price is not null").select(
        F.col("transactionHash").alias("transaction_hash"), F.col("asset").alias("asset_id"), F.upper("side").alias("side"), F.col("proxyWallet").alias("wallet"), F.col("conditionId").alias("condition_id"),
        "size", "price", F.coalesce("usdcSize", F.col("size") * F.col("price")).alias("usd_value"), F.lit("CONFIRMED").alias("status"), "timestamp",
    )


def market_scoped_trades(raw: DataFrame) -> DataFrame:
    """Wallet trades from rows whose fields are in camel or snake case; rows without an id are dropped."""
    pairs = {"transaction_hash": "transactionHash", "asset_id": "asset", "wallet": "proxyWallet", "condition_id": "conditionId"}
    fields = [*pairs, *pairs.values(), "side", "size", "price", "timestamp"]
    r = raw.select(F.from_json("raw", ", ".join(f"{f} string" for f in fields)).alias("r")).select("r.*")
    ids = {k: F.coalesce(F.col(v), F.col(k)) for k, v in pairs.items()}
    out = r.select(*[c.alias(k) for k, c in ids.items()], F.upper("side").alias("side"), _number("size").alias("size"), _number("price").alias("price"), F.col("timestamp").try_cast("long").alias("timestamp"))
    return out.where(" and ".join(f"coalesce({k}, '') <> ''" for k in pairs)).withColumn("usd_value", F.col("size") * F.col("price"))


def market_feed_trades(raw: DataFrame) -> DataFrame:
    """Corpus trades from a market's feed (raw JSON, condition_id)."""
    r = raw.select("condition_id", F.from_json("raw", "transactionHash string, asset string, proxyWallet string, outcome string, side string, price string, size string, timestamp long").alias("r")).select("condition_id", "r.*")
    r = r.withColumns({"price": _number("price"), "size": _number("size")}).where("price is not null and size is not null and transactionHash is not null and asset is not null and timestamp is not null")
    return r.select(
        F.lit("polymarket").alias("platform"), F.col("transactionHash").alias("tx_hash"), F.col("asset").alias("asset_id"), F.col("proxyWallet").alias("wallet_address"), "condition_id",
        F.when(F.lower("outcome") == "yes", "YES").otherwise("NO").alias("outcome_side"), F.when(F.upper("side") == "BUY", "BUY").otherwise("SELL").alias("bs"),
        "price", "size", (F.col("price") * F.col("size")).alias("notional_usd"), F.col("timestamp").alias("ts"),
    )


def exchange_trades(fills: DataFrame, fallback_ts: int = 0) -> DataFrame:
    """Corpus trades from a regulated exchange's anonymous fills: always a BUY by the taker at the taker's price."""
    price = F.when(F.col("taker_side") == "yes", _number("yes_price_dollars")).otherwise(_number("no_price_dollars"))
    side = F.upper("taker_side")
    ts = F.coalesce(F.unix_timestamp(F.try_to_timestamp("created_time")), F.lit(fallback_ts)).cast("long")
    return fills.select(
        F.lit("kalshi").alias("platform"), F.col("trade_id").alias("tx_hash"), F.concat_ws(":", "ticker", "taker_side").alias("asset_id"), F.lit("").alias("wallet_address"), F.col("ticker").alias("condition_id"),
        side.alias("outcome_side"), F.lit("BUY").alias("bs"), price.alias("price"), _number("count_fp").alias("size"), (price * _number("count_fp")).alias("notional_usd"), ts.alias("ts"),
    )


def bet_trades(bets: DataFrame) -> DataFrame:
    """Corpus trades from play-money bets: no cancelled bet and no limit bet that was never filled; each is a BUY of its amount."""
    real = bets.where(~F.coalesce("is_cancelled", F.lit(False)) & ~(F.col("limit_prob").isNotNull() & ~F.coalesce("is_filled", F.lit(False))))
    return real.select(
        F.lit("manifold").alias("platform"), F.col("id").alias("tx_hash"), F.concat_ws(":", "contract_id", "outcome").alias("asset_id"), F.col("user_id").alias("wallet_address"), F.col("contract_id").alias("condition_id"),
        F.col("outcome").alias("outcome_side"), F.lit("BUY").alias("bs"), F.col("prob_before").alias("price"), F.col("amount").alias("size"), F.col("amount").alias("notional_usd"), F.col("created_time").alias("ts"),
    )


def _digits(data: str) -> Column:
    return F.when(F.col(data).startswith("0x"), F.substring(data, 3, 2**31 - 1)).otherwise(F.col(data))


def _word(data: str, k: int) -> Column:
    return F.substring(data, F.when(F.col(data).startswith("0x"), 2).otherwise(0) + F.lit(64 * k + 1), F.lit(64))


def decode_fills(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed fills and rejected logs from event logs (topics, data, transaction_hash, block_number, log_index)."""
    good = (F.size("topics") == 4) & _digits("data").rlike("^[0-9a-fA-F]{320}$") & F.forall("topics", lambda t: t.rlike("^0x[0-9a-fA-F]{64}$"))
    good = F.coalesce(good, F.lit(False))

    def address(k: int) -> Column:
        return F.concat(F.lit("0x"), F.lower(F.right(F.element_at("topics", k), F.lit(40))))

    names = ("maker_asset_id", "taker_asset_id", "maker_amount", "taker_amount", "fee")
    fills = logs.where(good).select(
        "transaction_hash", "block_number", "log_index", F.element_at("topics", 2).alias("order_hash"), address(3).alias("maker"), address(4).alias("taker"), *[hex_to_decimal(_word("data", k)).alias(n) for k, n in enumerate(names)]
    )
    return fills, logs.where(~good)


def fills_to_trades(fills: DataFrame, asset_index: DataFrame, exchange: str) -> tuple[DataFrame, DataFrame]:
    """The maker's view of fills as trades, and counts of what was skipped by reason."""
    gives_cash, takes_cash = F.col("maker_asset_id") == "0", F.col("taker_asset_id") == "0"
    token = F.when(gives_cash, F.col("taker_asset_id")).otherwise(F.col("maker_asset_id"))
    cash = F.when(gives_cash, F.col("maker_amount")).otherwise(F.col("taker_amount")).cast("decimal(38,0)").cast("double") / 1e6
    tokens = F.when(gives_cash, F.col("taker_amount")).otherwise(F.col("maker_amount")).cast("decimal(38,0)").cast("double") / 1e6
    rows = fills.withColumns({"asset_id": token, "cash": cash, "size": tokens}).join(asset_index.select("asset_id", "condition_id", "outcome_side"), "asset_id", "left")
    reason = (
        F.when(F.lower("maker") == exchange.lower(), "exchange_maker").when(gives_cash == takes_cash, "unsupported").when(F.col("size") == 0, "unsupported").when(F.col("condition_id").isNull(), "unresolvable")
    )
    rows = rows.withColumn("reason", reason)
    out = rows.where("reason is null").select(
        F.lit("polymarket").alias("platform"), F.col("transaction_hash").alias("tx_hash"), "asset_id", F.col("maker").alias("wallet_address"), "condition_id", "outcome_side", F.when(gives_cash, "BUY").otherwise("SELL").alias("bs"),
        (F.col("cash") / F.col("size")).alias("price"), "size", F.col("cash").alias("notional_usd"), "block_number",
    )
    return out, rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


#: Fixed value: the asset id of the money that a fill is paid in, which is no market's asset.
MONEY = "0"


def subgraph_fills(as_maker: DataFrame, as_taker: DataFrame, assets: DataFrame) -> DataFrame:
    """Maker and taker answers together, each fill once, only those of the market's assets. Half of all sides are money, which would meet in one
    task, so a fill looks its other assets up alone."""
    key = ["transaction_hash", "log_index"]
    both = as_maker.unionByName(as_taker).dropDuplicates(key)
    sides = F.filter(F.array_distinct(F.array("maker_asset_id", "taker_asset_id")), lambda a: a != MONEY)
    own = assets.select("asset_id").distinct().withColumnRenamed("asset_id", "_asset")
    return both.withColumn("_asset", F.explode(sides)).join(own, "_asset", "left_semi").drop("_asset").dropDuplicates(key)


def market_payloads(raw: DataFrame) -> DataFrame:
    """Markets from payloads: lists in JSON text, money in text, id and slug of the first parent event hoisted."""
    m = raw.select(F.from_json("raw", "id string, conditionId string, question string, slug string, outcomes string, outcomePrices string, liquidity string, volume string, active boolean, closed boolean, clobTokenIds string, events array<struct<id:string,slug:string>>").alias("m")).select("m.*")
    first = F.try_element_at("events", F.lit(1))
    return m.select(
        F.col("id").alias("market_id"), F.col("conditionId").alias("condition_id"), "question", "slug", F.from_json("outcomes", "array<string>").alias("outcomes"), F.from_json("clobTokenIds", "array<string>").alias("asset_ids"),
        F.transform(F.from_json("outcomePrices", "array<string>"), lambda x: x.try_cast("double")).alias("outcome_prices"), _number("liquidity").alias("liquidity_usd"), _number("volume").alias("volume_usd"), "active", "closed",
        first["id"].alias("event_id"), first["slug"].alias("event_slug"),
    )


def event_payloads(raw: DataFrame) -> DataFrame:
    """Events from payloads: tags are texts or objects with a label."""
    e = raw.select(F.from_json("raw", "id string, slug string, title string, active boolean, closed boolean, liquidity string, volume string, tags array<string>, markets array<string>").alias("e")).select("e.*")
    tags = F.filter(F.transform("tags", lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.label")).otherwise(t)), lambda t: t.isNotNull())
    return e.select("id", "slug", "title", "active", "closed", _number("liquidity").alias("liquidity_usd"), _number("volume").alias("volume_usd"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), "markets")


def market_snapshots(markets: DataFrame, cache: DataFrame, at: int, limit: int) -> DataFrame:
    known = cache.select("market_id", F.col("event_id").alias("_known"))
    return markets.join(known, "market_id", "left").withColumn("event_id", F.coalesce("event_id", "_known")).drop("_known").withColumn("snapshot_at", F.lit(at)).orderBy("market_id").limit(limit)


def event_snapshots(events: DataFrame, cached_tags: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Snapshots with the number of markets, and the tags of events (by slug, else id) not cached yet."""
    keyed = events.withColumn("event_slug", F.coalesce("slug", "id"))
    snapshots = keyed.select("id", "event_slug", "liquidity_usd", "volume_usd", F.size("markets").alias("market_count"), F.lit(at).alias("snapshot_at"))
    tags = insert_or_ignore(keyed.select("event_slug", "tags", F.lit(at).alias("cached_at")), cached_tags, ["event_slug"], ["event_slug"])
    return snapshots, tags


def position_history(positions: DataFrame, at: int) -> DataFrame:
    return positions.where("coalesce(condition_id, '') <> '' and coalesce(outcome, '') <> ''").withColumn("snapshot_at", F.lit(at))


def activity_log(raw: DataFrame) -> DataFrame:
    """One row for (wallet, timestamp, type) with the payload kept as it came."""
    r = raw.withColumns({"event_type": F.get_json_object("raw", "$.type"), "timestamp": F.get_json_object("raw", "$.timestamp").try_cast("long")})
    return first_write_wins(r.where("event_type is not null and timestamp is not null").withColumnRenamed("raw", "payload_json"), ["wallet", "timestamp", "event_type"], ["payload_json"])


def book_ticks(messages: DataFrame, interval: int = 60, depth: int = 5) -> DataFrame:
    """Ticks from order-book messages (asset_id, seq, ts, event_type, side, price, size).

    ``book`` rows carry the levels of a snapshot that replaces the book; ``price_change`` rows set a level, size 0
    deletes it; ``last_trade_price`` rows carry a price. A tick stands at the end of each interval with messages.

    Each row of a level is live until the next row of its level or the next snapshot of its asset; it then stands in the ticks
    from its interval to the one before that, so ticks hold the live levels and no message meets all later ones.
    """
    rank = F.dense_rank().over(Window.partitionBy("asset_id").orderBy("snapshot_at"))
    m = messages.withColumn("snapshot_at", (F.floor(F.col("ts") / interval) + 1) * interval).withColumn("r", rank)
    ends = m.groupBy("asset_id", "r").agg(F.min("snapshot_at").alias("snapshot_at"))
    levels = m.where("event_type in ('book', 'price_change')")
    later = Window.partitionBy("asset_id").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("asset_id", "side", "price").orderBy("seq")
    replaced = F.least(F.lead(F.struct("seq", "r")).over(own), F.min(F.when(F.col("event_type") == "book", F.struct("seq", "r"))).over(later))
    last = m.groupBy("asset_id").agg((F.max("r") + 1).alias("over"))
    live = levels.withColumn("replaced", replaced).join(last, "asset_id").withColumn("until", F.coalesce("replaced.r", "over") - 1).where("size > 0 and until >= r")
    level = live.select("asset_id", "side", "price", "size", F.explode(F.sequence("r", "until")).alias("r")).join(ends, ["asset_id", "r"])
    best = Window.partitionBy("asset_id", "snapshot_at", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    ranked = level.withColumn("k", F.row_number().over(best))

    def top(side: str) -> list[Column]:
        own = F.col("side") == side
        return [F.max(F.when(own & (F.col("k") == 1), F.col("price"))).alias(f"best_{side}"), F.sum(F.when(own & (F.col("k") <= depth), F.col("size"))).alias(f"{side}_depth_top5")]

    book = ranked.groupBy("asset_id", "snapshot_at").agg(*top("bid"), *top("ask"))
    traded = m.where("event_type = 'last_trade_price'").groupBy("asset_id", "snapshot_at").agg(F.max_by("price", "seq").alias("price"))
    so_far = Window.partitionBy("asset_id").orderBy("snapshot_at").rowsBetween(Window.unboundedPreceding, 0)
    last = ends.drop("r").join(traded, ["asset_id", "snapshot_at"], "left").select("asset_id", "snapshot_at", F.last("price", ignorenulls=True).over(so_far).alias("last_trade_price"))
    out = ends.drop("r").join(book, ["asset_id", "snapshot_at"], "left").join(last, ["asset_id", "snapshot_at"], "left")
    return out.withColumns({"mid_price": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid")})


def to_cents(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.round(_number(c) * 100).cast("int") for c in columns})


def exchange_tables(markets: DataFrame, known_markets: DataFrame, trades: DataFrame, known_trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A regulated exchange's tables after an update, prices in cents: a market replaces what its ticker had, a trade that is
    known stays as it was."""
    fresh = to_cents(markets, ["yes_bid", "yes_ask", "no_bid", "no_ask", "last_price"])
    added = insert_or_ignore(to_cents(trades, ["yes_price", "no_price"]), known_trades, ["trade_id"], ["created_at", "ticker"])
    return upsert(fresh, known_markets, ["ticker"], ["seen_at"]), known_trades.unionByName(added, allowMissingColumns=True)


def exchange_books(raw: DataFrame) -> DataFrame:
    """Order-book rows (ticker, ts, yes_bids_json, no_bids_json) from payloads (ticker, ts, raw JSON ``orderbook_fp`` with the price
    and size of each bid as texts); a side that is missing has no bids. Every payload is a row: books are appended."""
    side = lambda name: F.coalesce(F.get_json_object("raw", f"$.orderbook_fp.{name}_dollars"), F.lit("[]"))
    return raw.where("ticker is not null").select("ticker", "ts", side("yes").alias("yes_bids_json"), side("no").alias("no_bids_json"))


def latest_books(books: DataFrame) -> DataFrame:
    """The newest row of each ticker; of rows of one second the last in the order of their bids."""
    return first_write_wins(books, ["ticker"], [F.desc("ts"), F.desc("yes_bids_json"), F.desc("no_bids_json")])


def play_money_rows(raw: DataFrame, known: DataFrame, fields: str) -> DataFrame:
    """Play-money markets, bets or users after an update: of each id the newest payload (raw JSON, seen_at), which is kept
    beside the parsed ``fields``; payloads without an id are dropped."""
    parsed = raw.select(F.from_json("raw", f"id string, {fields}").alias("r"), F.col("raw").alias("payload_json"), "seen_at").select("r.*", "payload_json", "seen_at")
    return upsert(parsed.where("id is not null"), known, ["id"], ["seen_at", "payload_json"])


def asset_index(trades: DataFrame) -> DataFrame:
    """One row for each asset, from its earliest trade; outcome 0 is YES."""
    first = trades.groupBy("platform", "asset_id").agg(F.min_by(F.struct("condition_id", "outcome_side"), F.struct("ts", "tx_hash", "condition_id", "outcome_side")).alias("x"))
    return first.select("platform", "asset_id", "x.condition_id", "x.outcome_side", F.when(F.col("x.outcome_side") == "YES", 0).otherwise(1).alias("outcome_index"))


def newer_than_seen(new: DataFrame, target: DataFrame, by: str = "condition_id", ts: str = "ts") -> DataFrame:
    """Rows after the high-water mark of their group in ``target``."""
    marks = target.groupBy(by).agg(F.max(ts).alias("_mark"))
    return new.join(marks, by, "left").where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def until_known(new: DataFrame, target: DataFrame, key: Sequence[str], by: str, ts: str = "ts", stop: int = 20) -> DataFrame:
    """New rows of a newest-first poll that ends, in each group, at ``stop`` known rows in a row."""
    seen = target.select(*key).distinct().withColumn("_known", F.lit(1))
    newest = Window.partitionBy(by).orderBy(F.desc(ts), *key)
    rows = new.join(seen, list(key), "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_known").over(newest.rowsBetween(-(stop - 1), 0)))
    ended = F.max(F.when(F.col("_run") >= stop, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_ended", ended).where("_ended = 0 and _known = 0").drop("_known", "_run", "_ended")


def watchlist_mirror(tracked: DataFrame, alerts: DataFrame, manual: DataFrame) -> DataFrame:
    """Tracked wallets, wallets that whale alerts name and manual ones, each with its first source."""
    named = alerts.where("detector = 'whales'").select(F.get_json_object("body", "$.wallet").alias("address"))
    every = None
    for k, (source, df) in enumerate((("tracked", tracked.select("address")), ("whale_alert", named), ("manual", manual.select("address")))):
        one = df.select("address", F.lit(source).alias("source"), F.lit(k).alias("_rank"))
        every = one if every is None else every.unionByName(one)
    return first_write_wins(every.where("address is not null"), ["address"], ["_rank"]).drop("_rank")
