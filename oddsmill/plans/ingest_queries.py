"""Registered queries of ingest: payloads rebuilt from the tables go through the normalisers, sinks and polls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oddsmill.operators import ingest
from oddsmill.plans import views
from oddsmill.plans.registry import query
from oddsmill.sources import tables, versioned


def _n():
    return F.col("size").cast("long")



def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey").cast("string"))


@query("""select tx_hash as transaction_hash, asset_id, wallet_address as wallet, condition_id, bs as side, size, round(price + 3e-12, 8) as price, ts as "timestamp", round(size * price + 3e-12, 8) as usd_value from trades where cast(size as bigint) % 7 <> 0""")
def market_scoped_to_trades(spark, sf_dir):
    """Fields in camel case for odd sizes and in snake case for even ones; each seventh has no wallet."""
    names = {"tx_hash": ("transactionHash", "transaction_hash"), "asset_id": ("asset", "asset_id"), "wallet_address": ("proxyWallet", "wallet"), "condition_id": ("conditionId", "condition_id")}
    wallet = F.when(_n() % 7 != 0, F.col("wallet_address"))
    fields = [F.when(_n() % 2 == 1 - j, wallet if c == "wallet_address" else F.col(c)).alias(both[j]) for c, both in names.items() for j in (0, 1)]
    payload = F.struct(*fields, F.lower("bs").alias("side"), F.col("size").cast("string").alias("size"), F.col("price").cast("string").alias("price"), F.col("ts").cast("string").alias("timestamp"))
    return ingest.market_scoped_trades(views.trades(spark, sf_dir).select(F.to_json(payload).alias("raw")))


@query("""select platform, tx_hash, asset_id, wallet_address, condition_id, outcome_side, bs, round(price + 3e-12, 8) as price, size, round(notional_usd + 3e-12, 8) as notional_usd, ts from trades where cast(size as bigint) % 11 <> 0""")
def market_feed_to_trades(spark, sf_dir):
    """Each eleventh row has a price that is no number."""
    payload = F.struct(
        F.col("tx_hash").alias("transactionHash"), F.col("asset_id").alias("asset"), F.col("wallet_address").alias("proxyWallet"), F.initcap("outcome_side").alias("outcome"), F.lower("bs").alias("side"),
        F.when(_n() % 11 != 0, F.col("price").cast("string")).otherwise("n/a").alias("price"), F.col("size").cast("string").alias("size"), F.col("ts").alias("timestamp"),
    )
    return ingest.market_feed_trades(views.trades(spark, sf_dir).select("condition_id", F.to_json(payload).alias("raw")))


@query("""select 'manifold' as platform, tx_hash, condition_id || ':' || outcome_side as asset_id, wallet_address, condition_id, outcome_side, 'BUY' as bs, round(price + 3e-12, 8) as price, case when bs = 'SELL' then -size else size end as size,
  case when bs = 'SELL' then -size else size end as notional_usd, ts from trades where cast(size as bigint) % 13 <> 0 and (cast(size as bigint) % 3 <> 0 or cast(size as bigint) % 2 = 0)""")
def bets_to_trades(spark, sf_dir):
    """Each thirteenth bet is cancelled, each third a limit bet, of which odd sizes are unfilled or of unknown state."""
    bets = views.trades(spark, sf_dir).select(
        F.col("tx_hash").alias("id"), F.col("condition_id").alias("contract_id"), F.col("wallet_address").alias("user_id"), F.col("outcome_side").alias("outcome"), F.when(F.col("bs") == "SELL", -F.col("size")).otherwise(F.col("size")).alias("amount"), F.col("price").alias("prob_before"),
        F.col("ts").alias("created_time"), F.when(_n() % 2 == 0, True).when(_n() % 5 != 0, False).alias("is_filled"), F.when(_n() % 13 == 0, True).alias("is_cancelled"), F.when(_n() % 3 == 0, F.col("price")).alias("limit_prob"),
    )
    return ingest.bet_trades(bets)


@query("""select tx_hash || asset_id || wallet_address as transaction_hash, cast(size as bigint) as log_index, case when bs = 'BUY' then '0' else asset_id end as maker_asset_id, case when bs = 'BUY' then asset_id else '0' end as taker_asset_id
  from trades where (cast(size as bigint) % 2 = 0 or cast(size as bigint) % 3 = 0) and cast(substr(condition_id, 2) as bigint) % 4 = 0""")
def subgraph_fills(spark, sf_dir):
    """The answers overlap in each sixth fill."""
    t = views.trades(spark, sf_dir)
    buy = F.col("bs") == "BUY"
    fills = t.select(F.concat("tx_hash", "asset_id", "wallet_address").alias("transaction_hash"), _n().alias("log_index"), F.when(buy, "0").otherwise(F.col("asset_id")).alias("maker_asset_id"), F.when(buy, F.col("asset_id")).otherwise("0").alias("taker_asset_id"))
    assets = t.where(F.substring("condition_id", 2, 20).cast("long") % 4 == 0).select("asset_id")
    return ingest.subgraph_fills(fills.where("log_index % 2 = 0"), fills.where("log_index % 3 = 0"), assets)


@query("""select venue as platform, tx_hash, asset_id, wallet, ts, round(notional_usd + 3e-12, 8) as notional_usd from (select *, row_number() over (partition by venue, tx_hash, asset_id, wallet order by ts, size, price, bs) as k from (
    select *, case when venue = 'polymarket' then lower(who) else who end as wallet from (
      select * replace (ts + later as ts), case cast(size as bigint) % 5 when 0 then 'manifold' when 1 then 'elsewhere' else 'polymarket' end as venue, case when later = 0 then upper(wallet_address) else wallet_address end as who from trades cross join (values (5), (0)) v(later))
    where notional_usd >= case venue when 'manifold' then 100 else 10 end)) where k = 1""")
def stored_trades(spark, sf_dir):
    """Every trade comes twice, with its wallet in small letters five seconds later."""
    t = views.trades(spark, sf_dir).withColumn("platform", F.when(_n() % 5 == 0, "manifold").when(_n() % 5 == 1, "elsewhere").otherwise("polymarket"))
    both = t.withColumn("ts", F.col("ts") + 5).unionByName(t.withColumn("wallet_address", F.upper("wallet_address")))
    return ingest.stored_trades(both).select("platform", "tx_hash", "asset_id", F.col("wallet_address").alias("wallet"), "ts", "notional_usd")


@query("""select cast(p_partkey as varchar) as market_id, 'm' || p_partkey as condition_id, p_name as question, 'Yes|No' as outcomes, p_partkey || ':YES|' || p_partkey || ':NO' as asset_ids, cast(case when p_partkey % 9 = 0 then null else 0.25 end as double) as yes_price,
  round(p_retailprice + 3e-12, 8) as liquidity_usd, cast(p_size as double) as volume_usd, p_partkey % 3 <> 0 as active, p_partkey % 3 = 0 as closed, case when p_partkey % 4 <> 0 then 'e' || p_size end as event_id, case when p_partkey % 4 <> 0 then p_brand || '-' || p_size end as event_slug from part""")
def market_payloads(spark, sf_dir):
    """Each ninth price is no number, each fourth market has no event."""
    p = _part(spark, sf_dir)
    event = F.array(F.struct(F.concat(F.lit("e"), "p_size").alias("id"), F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("slug")))
    raw = F.struct(
        F.col("k").alias("id"), F.concat(F.lit("m"), "k").alias("conditionId"), F.col("p_name").alias("question"), F.lit('["Yes","No"]').alias("outcomes"), F.concat(F.lit('["'), F.when(F.col("p_partkey") % 9 == 0, "?").otherwise("0.25"), F.lit('","0.75"]')).alias("outcomePrices"),
        F.col("p_retailprice").cast("string").alias("liquidity"), F.col("p_size").alias("volume"), (F.col("p_partkey") % 3 != 0).alias("active"), (F.col("p_partkey") % 3 == 0).alias("closed"), F.concat(F.lit('["'), "k", F.lit(':YES","'), "k", F.lit(':NO"]')).alias("clobTokenIds"), F.when(F.col("p_partkey") % 4 != 0, event).alias("events"),
    )
    m = ingest.market_payloads(p.select(F.to_json(raw).alias("raw")))
    return m.select("market_id", "condition_id", "question", F.array_join("outcomes", "|").alias("outcomes"), F.array_join("asset_ids", "|").alias("asset_ids"), F.col("outcome_prices")[0].alias("yes_price"), "liquidity_usd", "volume_usd", "active", "closed", "event_id", "event_slug")


_EVENTS = "select p_brand || '-' || p_size as slug, cast(min(p_partkey) as varchar) as id, count(*) as n, sum(p_retailprice) as volume, min(p_partkey) as least from part group by p_brand, p_size"


def _events(spark, sf_dir):
    """Payloads of events: a tag as text, and one as an object with a label, which each third event lacks."""
    e = _part(spark, sf_dir).groupBy(F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("slug")).agg(F.min("p_partkey").alias("least"), F.count("*").alias("n"), F.sum("p_retailprice").alias("volume"))
    tags = F.concat(F.lit('["NBA",'), F.when(F.col("least") % 3 == 0, '{"id":1}').otherwise('{"label":"AI"}'), F.lit("]"))
    markets = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"id":1}'), F.col("n").cast("int")), ","), F.lit("]"))
    slug = F.when(F.col("least") % 5 != 0, F.concat(F.lit('"slug":"'), "slug", F.lit('",'))).otherwise("")
    return e.select(F.concat(F.lit('{"id":"'), F.col("least").cast("string"), F.lit('",'), slug, F.lit('"title":"t","active":true,"closed":false,"liquidity":"1.5","volume":'), F.col("volume").cast("string"), F.lit(',"tags":'), tags, F.lit(',"markets":'), markets, F.lit("}")).alias("raw"))


@query("select id, case when least % 5 <> 0 then slug end as slug, case when least % 3 = 0 then 'NBA' else 'NBA,AI' end as tags, cast(n as int) as n_markets, cast(1.5 as double) as liquidity_usd, round(volume + 3e-12, 8) as volume_usd from payloads", payloads=_EVENTS)
def event_payloads(spark, sf_dir):
    return ingest.event_payloads(_events(spark, sf_dir)).select("id", "slug", F.array_join("tags", ",").alias("tags"), F.size("markets").alias("n_markets"), "liquidity_usd", "volume_usd")


@query("select id, case when least % 5 <> 0 then slug else id end as event_slug, cast(n as int) as market_count, round(volume + 3e-12, 8) as volume_usd, 77 as snapshot_at from payloads", payloads=_EVENTS)
def event_snapshots(spark, sf_dir):
    e = ingest.event_payloads(_events(spark, sf_dir))
    return ingest.event_snapshots(e, spark.sql("select '' as event_slug where false"), 77)[0].select("id", "event_slug", "market_count", "volume_usd", "snapshot_at")


@query("select event_slug, case when least % 3 = 0 then 'NBA' else 'NBA,AI' end as tags from (select *, case when least % 5 <> 0 then slug else id end as event_slug from payloads) where event_slug not in (select p_brand || '-' || p_size from part where p_size % 2 = 0)", payloads=_EVENTS)
def new_event_tags(spark, sf_dir):
    """Tags of events that the cache doesn't have; it has those of even sizes by their slug."""
    cached = _part(spark, sf_dir).where("p_size % 2 = 0").select(F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("event_slug"))
    tags = ingest.event_snapshots(ingest.event_payloads(_events(spark, sf_dir)), cached, 77)[1]
    return tags.select("event_slug", F.array_join("tags", ",").alias("tags"))


@query("select cast(p_partkey as varchar) as market_id, coalesce(case when p_partkey % 3 = 0 then 'e' || p_partkey end, case when p_partkey % 2 = 0 then 'c' || p_partkey end) as event_id, 77 as snapshot_at from part order by cast(p_partkey as varchar) limit 60")
def market_snapshots(spark, sf_dir):
    p = _part(spark, sf_dir)
    fresh = p.select(F.col("k").alias("market_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("e"), "k")).alias("event_id"))
    cache = p.where("p_partkey % 2 = 0").select(F.col("k").alias("market_id"), F.concat(F.lit("c"), "k").alias("event_id"))
    return ingest.market_snapshots(fresh, cache, 77, 60)


@query("select wallet_address, condition_id, outcome_side as outcome, round(size + 3e-12, 8) as size, 77 as snapshot_at from closed_positions where cast(size as bigint) % 5 <> 0 and cast(size as bigint) % 7 <> 0")
def position_history(spark, sf_dir):
    """Each fifth position has no market, each seventh a blank outcome."""
    p = views.closed_positions(spark, sf_dir).select("wallet_address", F.when(_n() % 5 != 0, F.col("condition_id")).alias("condition_id"), F.when(_n() % 7 != 0, F.col("outcome_side")).otherwise("").alias("outcome"), "size")
    return ingest.position_history(p, 77)


@query("""select wallet_address as wallet, ts as "timestamp", kind as event_type, min(raw) as payload_json from (
  select *, case bs when 'BUY' then 'TRADE' else 'REDEEM' end as kind, '{"type":"' || case bs when 'BUY' then 'TRADE' else 'REDEEM' end || '","timestamp":' || ts || ',"tx":"' || tx_hash || asset_id || '"}' as raw from trades where cast(size as bigint) % 9 <> 0) group by all""")
def activity_log(spark, sf_dir):
    """Each ninth payload has no timestamp."""
    stamp = F.when(_n() % 9 != 0, F.concat(F.lit(',"timestamp":'), F.col("ts").cast("string"))).otherwise("")
    raw = F.concat(F.lit('{"type":"'), F.when(F.col("bs") == "BUY", "TRADE").otherwise("REDEEM"), F.lit('"'), stamp, F.lit(',"tx":"'), "tx_hash", "asset_id", F.lit('"}'))
    return ingest.activity_log(views.trades(spark, sf_dir).select(F.col("wallet_address").alias("wallet"), raw.alias("raw")))


_TICKERS = "select 'K' || p_partkey as ticker, p_partkey, p_size from part"


@query("""select ticker, cast(case when p_partkey % 2 = 0 then p_size else 1 end as int) as yes_bid, cast(case when p_partkey % 2 = 0 then 7 else 1 end as int) as last_price, case when p_partkey % 2 = 0 then 2 else 1 end as seen_at from tickers where p_partkey % 2 = 0 or p_partkey % 3 = 0""", tickers=_TICKERS)
def exchange_market_rows(spark, sf_dir):
    """Dollars become cents; a market that is sent again replaces its row."""
    p = _part(spark, sf_dir).withColumn("ticker", F.concat(F.lit("K"), "k"))
    cents = lambda c: F.format_number(c / 100, 2)
    names = ("yes_bid", "yes_ask", "no_bid", "no_ask")
    fresh = p.where("p_partkey % 2 = 0").select("ticker", *[cents(F.col("p_size")).alias(c) for c in names], F.lit("0.07").alias("last_price"), F.lit(2).alias("seen_at"))
    known = p.where("p_partkey % 3 = 0").select("ticker", *[F.lit(1).alias(c) for c in (*names, "last_price")], F.lit(1).alias("seen_at"))
    none = spark.sql("select '' as trade_id, '' as ticker, 0 as yes_price, 0 as no_price, 0 as created_at where false")
    return ingest.exchange_tables(fresh, known, none, none)[0].select("ticker", "yes_bid", "last_price", "seen_at")


@query("""select tx_hash || asset_id || wallet_address as trade_id, cast(case when cast(size as bigint) % 2 = 0 then 1 else round(price * 100) end as int) as yes_price from trades""")
def exchange_trade_rows(spark, sf_dir):
    """Trades that are known stay as they were."""
    t = views.trades(spark, sf_dir).select(F.concat("tx_hash", "asset_id", "wallet_address").alias("trade_id"), F.col("condition_id").alias("ticker"), F.col("price").cast("string").alias("yes_price"), (1 - F.col("price")).cast("string").alias("no_price"), F.col("ts").alias("created_at"), _n().alias("n"))
    known = t.where("n % 2 = 0").select("trade_id", "ticker", F.lit(1).alias("yes_price"), F.lit(1).alias("no_price"), "created_at")
    none = spark.sql("select '' as ticker, '' as yes_bid, '' as yes_ask, '' as no_bid, '' as no_ask, '' as last_price, 0 as seen_at where false")
    return ingest.exchange_tables(none, none.withColumns({c: F.lit(0) for c in ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price")}), t.drop("n"), known)[1].select("trade_id", "yes_price")


@query("""select cast(p_partkey as varchar) as id, case when p_partkey % 2 = 0 then p_name else 'old' end as question, case when p_partkey % 2 = 0 then 3 else 1 end as seen_at from part where p_partkey % 2 = 0 or p_partkey % 5 = 0""")
def play_money_rows(spark, sf_dir):
    """The newest payload of an id stays; some have none."""
    p = _part(spark, sf_dir)
    raw = lambda at: F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("k")).alias("id"), F.when(F.lit(at) == 3, F.col("p_name")).otherwise("older").alias("question")))
    sent = p.select(raw(3).alias("raw"), F.lit(3).alias("seen_at")).unionByName(p.select(raw(2).alias("raw"), F.lit(2).alias("seen_at")))
    known = p.where("p_partkey % 5 = 0").select(F.col("k").alias("id"), F.lit("old").alias("question"), F.lit("{}").alias("payload_json"), F.lit(1).alias("seen_at"))
    return ingest.play_money_rows(sent, known, "question string").select("id", "question", "seen_at")


@query("select wallet_address, min(ts) as ts from trades where cast(size as bigint) % 2 = 0 and wallet_address not in (select wallet_address from trades where cast(size as bigint) = 1) group by wallet_address")
def insert_or_ignore(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    return ingest.insert_or_ignore(t.where(_n() % 2 == 0).select("wallet_address", "ts"), t.where(_n() == 1), ["wallet_address"], ["ts"])


@query("""select asset_id, arg_max(price, (ts, tx_hash, wallet_address)) as price from (select asset_id, round(price + 3e-12, 8) as price, ts, tx_hash, wallet_address from trades where cast(size as bigint) % 2 = 0) group by asset_id
  union all select asset_id, 0.0 from (select distinct asset_id from trades) where asset_id not in (select asset_id from trades where cast(size as bigint) % 2 = 0)""")
def upsert_latest(spark, sf_dir):
    t = views.trades(spark, sf_dir).select("asset_id", "price", "ts", "tx_hash", "wallet_address", _n().alias("n"))
    target = t.select("asset_id").distinct().withColumn("price", F.lit(0.0))
    return ingest.upsert(t.where("n % 2 = 0").drop("n"), target, ["asset_id"], ["ts", "tx_hash", "wallet_address"]).select("asset_id", "price")


@query("""select 'w' || c_custkey as address, case when c_custkey % 2 = 0 then 'tracked' else 'whale' end as source, not (c_custkey % 5 = 0) and (c_custkey % 2 = 1 or c_custkey % 3 = 0 or c_custkey % 4 <> 0) as active from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""")
def watchlist(spark, sf_dir):
    """Known addresses keep their source and become active when seen again; each fifth is switched off at the end."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("address"))
    known = c.where("c_custkey % 2 = 0").select("address", F.lit("tracked").alias("source"), (F.col("c_custkey") % 4 != 0).alias("active"))
    both = ingest.keep_first_provenance(c.where("c_custkey % 3 = 0").select("address", F.lit("whale").alias("source"), F.lit(1).alias("added_at")), known)
    return ingest.deactivate(both, c.where("c_custkey % 5 = 0")).select("address", "source", "active")


@query("select tx_hash, asset_id, wallet_address, ts from trades t where ts > coalesce((select max(ts) from trades o where o.condition_id = t.condition_id and cast(o.size as bigint) % 10 = 0), 0)")
def newer_than_seen(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    return ingest.newer_than_seen(t, t.where(_n() % 10 == 0)).select("tx_hash", "asset_id", "wallet_address", "ts")


@query("""select tx_hash, asset_id, wallet_address from (select *, max(case when run >= 3 then 1 else 0 end) over (partition by condition_id order by k) as ended from (
    select *, sum(known) over (partition by condition_id order by k rows between 2 preceding and current row) as run from (
      select *, case when cast(size as bigint) % 3 <> 0 then 1 else 0 end as known, row_number() over (partition by condition_id order by ts desc, tx_hash, asset_id, wallet_address) as k from trades))) where ended = 0 and known = 0""")
def poll_until_known(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    return ingest.until_known(t, t.where(_n() % 3 != 0), ["tx_hash", "asset_id", "wallet_address"], "condition_id", stop=3).select("tx_hash", "asset_id", "wallet_address")


@query("""select 'w' || c_custkey as address, case when c_custkey % 2 = 0 then 'tracked' when c_custkey % 3 = 0 then 'whale_alert' else 'manual' end as source from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0 or c_custkey % 5 = 0""")
def watchlist_mirror(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("address"))
    alerts = c.where("c_custkey % 3 = 0").select(F.lit("whales").alias("detector"), F.to_json(F.struct(F.col("address").alias("wallet"))).alias("body"))
    return ingest.watchlist_mirror(c.where("c_custkey % 2 = 0"), alerts, c.where("c_custkey % 5 = 0"))


@query("select tx_hash, asset_id, wallet_address, ts, cast(size as bigint) as n from trades where cast(size as bigint) % 2 = 0")
def platform_scan(spark, sf_dir):
    """Two venues are written as partitions and one of them again, then one is read back, with the columns asked for and in order."""
    t = views.trades(spark, sf_dir).select("tx_hash", "asset_id", "wallet_address", "ts", _n().alias("n"), F.when(_n() % 2 == 0, "even").otherwise("odd").alias("platform"))
    path = f"{tables.scratch_dir(spark)}/platforms-{uuid.uuid4().hex}"
    tables.replace_platform(t, path)
    tables.replace_platform(t.where("platform = 'odd'").withColumn("n", F.lit(0).cast("long")), path)
    return tables.chronological(tables.scan(spark, path, t.schema, "even", ["tx_hash", "asset_id", "wallet_address", "ts", "n"]))


@query("select tx_hash, asset_id, wallet_address, ts, cast(size as bigint) as n from trades order by ts, tx_hash, asset_id, wallet_address limit 1000 offset 2000")
def trade_page(spark, sf_dir):
    """The third page of a thousand trades in order of time, each page from the last key of the one before."""
    t = views.trades(spark, sf_dir).select("tx_hash", "asset_id", "wallet_address", "ts", _n().alias("n"))
    path = f"{tables.scratch_dir(spark)}/pages-{uuid.uuid4().hex}"
    versioned.write_paged(t, path, 16)
    after = None
    for _ in range(2):
        last = versioned.page(spark, path, after, 1000).orderBy(*[F.desc(c) for c in versioned.TRADE_ORDER]).select(*versioned.TRADE_ORDER).head()
        after = tuple(last)
    return versioned.page(spark, path, after, 1000)


@query("select case when cast(size as bigint) % 2 = 0 then 'even' else 'odd' end as platform, tx_hash, asset_id, wallet_address, ts, case when cast(size as bigint) % 2 = 0 then cast(size as bigint) else 0 end as n from trades")
def swapped_scan(spark, sf_dir):
    """Two venues are written and one of them is swapped for another build; readers follow the manifest."""
    t = views.trades(spark, sf_dir).select("tx_hash", "asset_id", "wallet_address", "ts", _n().alias("n"), F.when(_n() % 2 == 0, "even").otherwise("odd").alias("platform"))
    path = f"{tables.scratch_dir(spark)}/swapped-{uuid.uuid4().hex}"
    versioned.swap(t, path)
    versioned.swap(t.where("platform = 'odd'").withColumn("n", F.lit(0).cast("long")), path)
    return versioned.read(spark, path)


@query("""select reason, count(*) as n from (select case when cast(size as bigint) % 7 = 0 then 'exchange_maker' when cast(size as bigint) % 5 = 0 or cast(size as bigint) % 11 = 0 then 'unsupported' when cast(size as bigint) % 3 = 0 then 'unresolvable' end as reason from trades)
  where reason is not null group by reason""")
def skipped_fills(spark, sf_dir):
    """Fills of the exchange itself, between two tokens, of no tokens and of tokens that no market has, counted by reason."""
    t = views.trades(spark, sf_dir)
    fills = t.select(
        F.col("tx_hash").alias("transaction_hash"), F.when(_n() % 7 == 0, "0xEXCHANGE").otherwise(F.col("wallet_address")).alias("maker"), F.when(_n() % 5 == 0, F.col("asset_id")).otherwise("0").alias("maker_asset_id"),
        F.when(_n() % 3 == 0, F.concat(F.lit("x"), "asset_id")).otherwise(F.col("asset_id")).alias("taker_asset_id"), F.lit("1000000").alias("maker_amount"), F.when(_n() % 11 == 0, "0").otherwise("2000000").alias("taker_amount"), F.col("ts").alias("block_number"),
    )
    return ingest.fills_to_trades(fills, ingest.asset_index(t), "0xexchange")[1]


@query("""select tx_hash as transaction_hash, cast(size as bigint) as log_index, '0x' || lpad(lower(to_hex(ts)), 40, '0') as maker, (k * 18446744073709551616::uhugeint + n)::varchar as maker_asset_id, (n * 18446744073709551616::uhugeint + k)::varchar as taker_asset_id, k::varchar as maker_amount, '0' as fee
  from (select *, cast(substr(condition_id, 2) as bigint)::uhugeint as k, cast(size as bigint)::uhugeint as n from trades) where cast(size as bigint) % 5 <> 0""")
def log_fills(spark, sf_dir):
    """Event logs with 128-bit ids; each fifth has too short a text."""
    t = views.trades(spark, sf_dir).withColumns({"k": F.substring("condition_id", 2, 20).cast("long"), "n": _n()})
    word = lambda hi, lo: F.concat(F.lpad(F.hex(hi), 48, "0"), F.lpad(F.hex(lo), 16, "0"))
    zero = F.lit(0).cast("long")
    data = F.concat(F.lit("0x"), word(F.col("k"), F.col("n")), word(F.col("n"), F.col("k")), word(zero, F.col("k")), word(zero, F.col("n")), F.when(F.col("n") % 5 == 0, F.lit("00")).otherwise(word(zero, zero)))
    topic = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("ts")), 64, "0"))
    logs = t.select(F.array(topic, topic, topic, topic).alias("topics"), F.lower(data).alias("data"), F.col("tx_hash").alias("transaction_hash"), F.lit(1).alias("block_number"), F.col("n").alias("log_index"))
    return ingest.decode_fills(logs)[0].select("transaction_hash", "log_index", "maker", "maker_asset_id", "taker_asset_id", "maker_amount", "fee")


@query("""select 'K' || p_partkey as ticker, case when p_partkey % 3 = 0 then 2 else 1 end as ts, '[["0.' || p_size || '","10.00"]]' as yes_bids_json, case when p_partkey % 4 = 0 then '[]' else '[["0.07","' || p_size || '.00"]]' end as no_bids_json from part""")
def exchange_book_rows(spark, sf_dir):
    """Order books of a second venue are appended; the newest of each ticker is read."""
    p = _part(spark, sf_dir)
    yes, no = F.concat(F.lit('"yes_dollars":[["0.'), F.col("p_size").cast("string"), F.lit('","10.00"]]')), F.concat(F.lit('"no_dollars":[["0.07","'), F.col("p_size").cast("string"), F.lit('.00"]]'))
    inner = F.when(F.col("p_partkey") % 4 == 0, yes).otherwise(F.concat(yes, F.lit(","), no))
    raw = F.concat(F.lit('{"orderbook_fp":{'), inner, F.lit("}}"))
    new = p.select(F.concat(F.lit("K"), "k").alias("ticker"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("ts"), raw.alias("raw"))
    old = p.select(F.concat(F.lit("K"), "k").alias("ticker"), F.lit(0).alias("ts"), F.lit("{}").alias("raw"))
    return ingest.latest_books(ingest.exchange_books(new.unionByName(old)))
