"""Registered queries against their SQL, and operators on small golden inputs."""

import datetime
import hashlib
import json
import math
import random

import pytest

from oddsmill.operators import corpus, detectors, features, ingest, ledger, model, report
from oddsmill.functions.categories import categorize_tags, primary_category
from oddsmill.plans.catalogue import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def same(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 8) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(same(x[i]) for i in at) for x in want.fetchall()), key=repr) and got


MARKETS = [("rain", "culture", '["culture","thesis"]', 900_000), ("vote", "elections", "[]", 800_000), ("coin", "crypto", "[]", 0)]
TRADES = [
    ("t1", "rain:Y", "ann", "rain", "YES", "BUY", 0.25, 40.0, 10.0, 100_000), ("t2", "rain:N", "bob", "rain", "NO", "BUY", 0.70, 20.0, 14.0, 100_600), ("t3", "vote:N", "ann", "vote", "NO", "BUY", 0.60, 50.0, 30.0, 200_000),
    ("t4", "rain:Y", "ann", "rain", "YES", "SELL", 0.50, 10.0, 5.0, 300_000), ("t5", "vote:Y", "bob", "vote", "YES", "BUY", 0.45, 100.0, 45.0, 400_000), ("t6", "vote:N", "ann", "vote", "NO", "BUY", 0.55, 60.0, 33.0, 700_000),
    ("t7", "coin:Y", "ann", "coin", "YES", "BUY", 0.10, 10.0, 1.0, 710_000),
]
TRADE_SCHEMA = "platform string, tx_hash string, asset_id string, wallet_address string, condition_id string, outcome_side string, bs string, price double, size double, notional_usd double, ts long"


def small_corpus(spark):
    """Seven trades of two wallets; ``rain`` resolves between ann's trades, ``coin`` never does."""
    t = spark.createDataFrame([("polymarket", *x) for x in TRADES], TRADE_SCHEMA)
    m = spark.createDataFrame([("polymarket", *x) for x in MARKETS], "platform string, condition_id string, category string, categories_json string, closed_at long")
    r = spark.createDataFrame([("polymarket", "rain", 1, 650_000), ("polymarket", "vote", 0, 800_000)], "platform string, condition_id string, outcome_yes_won int, resolved_at long")
    return t, m, r


def test_features_of_a_small_corpus(spark):
    rows = {x.tx_hash: x for x in features.build_features(*small_corpus(spark)).collect()}
    assert sorted(rows) == ["t1", "t2", "t3", "t5", "t6"]  # buys of resolved markets
    t1, t2, t6 = rows["t1"], rows["t2"], rows["t6"]
    assert (t6.prior_trades_count, t6.prior_buys_count, t6.prior_resolved_buys, t6.prior_wins, t6.prior_losses, t6.prior_realized_pnl_usd) == (3, 2, 1, 1, 0, 30.0)
    assert (t6.win_rate, t6.top_category, t6.category_diversity, t6.seconds_since_last_trade, t6.prior_trades_30d) == (1.0, "culture", 2, 400_000, 3)
    assert [t6.avg_implied_prob_paid, t6.realized_edge_pp, t6.avg_bet_size_usd, t6.bet_size_rel_to_avg, t6.edge_confidence_weighted] == pytest.approx([0.425, 0.575, 20.0, 1.65, 0.575 / 20])
    assert (t6.market_volume_so_far_usd, t6.market_unique_traders_so_far, t6.last_trade_price, t6.market_age_seconds, t6.time_to_resolution_seconds) == (75.0, 2, 0.45, 500_000, 100_000)
    assert t6.price_volatility_recent == pytest.approx(0.075) and t6.wallet_age_days == pytest.approx(600_000 / 86_400) and (t6.label_won, t6.cat_elections, t6.cat_culture) == (1, 1, 0)
    assert (t2.win_rate, t2.top_category, t2.market_volume_so_far_usd, t2.last_trade_price, t2.market_age_seconds, t2.label_won) == (None, None, 10.0, 0.25, 600, 0)
    assert (t1.market_age_seconds, t1.last_trade_price, t1.cat_culture, t1.cat_thesis, t1.cat_elections, t1.is_high_quality_wallet) == (100_000, None, 1, 1, 0, 0)
    assert all(x.price_volatility_recent is None for k, x in rows.items() if k != "t6") and rows["t3"].prior_resolved_buys == 0


def test_spans_of_hot_keys_change_no_feature(spark):
    """All keys as hot ones, over histories of many spans with gaps, ties and resolutions at the time of trades."""
    r = random.Random(8)
    day = 86_400
    rows = [("polymarket", f"t{k:03d}", f"{m}:{s}", w, m, s, r.choice(["BUY", "BUY", "SELL"]), r.randrange(1, 20) / 20, 10.0, float(r.randrange(1, 60)), r.randrange(0, 400, 5) * day + r.choice([0, 0, 7])) for k, (m, s, w) in enumerate((f"m{r.randrange(6)}", r.choice(["YES", "NO"]), f"w{r.randrange(5)}") for _ in range(400))]
    t = spark.createDataFrame(rows, TRADE_SCHEMA)
    m = spark.createDataFrame([("polymarket", f"m{k}", ("crypto", "tech", None)[k % 3], "[]", 500 * day) for k in range(6)], "platform string, condition_id string, category string, categories_json string, closed_at long")
    res = spark.createDataFrame([("polymarket", f"m{k}", k % 2, 300 * day + 50 * day * k % 170) for k in range(5)], "platform string, condition_id string, outcome_yes_won int, resolved_at long")
    whole, spans = ({x.tx_hash: x.asDict() for x in features.build_features(t, m, res, most=n).collect()} for n in (10**9, 0))
    assert whole.keys() == spans.keys() and len(whole) > 100
    for k, x in whole.items():
        assert {c: v if isinstance(v, (str, int, type(None))) else pytest.approx(v, rel=1e-9, abs=1e-12) for c, v in x.items()} == spans[k]


def test_anonymous_wallets_have_no_history(spark):
    t, m, r = small_corpus(spark)
    rows = features.build_features(t.withColumn("wallet_address", F.lit("")), m, r).collect()
    assert len(rows) == 5 and all(x.prior_trades_count == 0 and x.win_rate is None for x in rows)


def test_sinks(spark):
    schema = "k long, v string, at long"
    old, new = spark.createDataFrame([(1, "a", 0)], schema), spark.createDataFrame([(1, "b", 1), (2, "c", 1), (2, "d", 2)], schema)
    assert sorted(map(tuple, ingest.insert_or_ignore(new, old, ["k"], ["at"]).collect())) == [(2, "c", 1)]
    assert sorted(map(tuple, ingest.upsert(new, old, ["k"], ["at"]).collect())) == [(1, "b", 1), (2, "d", 2)]


def test_log_decoder(spark):
    word = lambda x: f"{x:064x}"
    big = 2**255 + 12345
    good = (["0x" + word(7), "0x" + word(8), "0x" + "0" * 24 + "AB" * 20, "0x" + "0" * 24 + "cd" * 20], "0x" + word(0) + word(big) + word(5_000_000) + word(10_000_000) + word(0), "h", 1, 1)
    df = spark.createDataFrame([good, (good[0][:3], good[1], "i", 1, 2), (good[0], "0x12", "j", 1, 3), (None, None, "k", 1, 4)], "topics array<string>, data string, transaction_hash string, block_number long, log_index long")
    fills, bad = ingest.decode_fills(df)
    x = fills.collect()
    assert len(x) == 1 and x[0].taker_asset_id == str(big) and x[0].maker == "0x" + "ab" * 20 and bad.count() == 3
    index = spark.createDataFrame([(str(big), "m", "YES")], "asset_id string, condition_id string, outcome_side string")
    trades, skipped = ingest.fills_to_trades(fills, index, "0xex")
    t = trades.first()
    assert (t.bs, t.price, t.size, t.notional_usd) == ("BUY", 0.5, 10.0, 5.0) and skipped.count() == 0


def test_book_ticks(spark):
    rows = [("a", 1, 0, "book", "bid", 0.40, 10.0), ("a", 1, 0, "book", "ask", 0.50, 5.0), ("a", 2, 10, "price_change", "bid", 0.45, 3.0), ("a", 3, 70, "price_change", "bid", 0.45, 0.0), ("a", 4, 130, "book", "ask", 0.60, 1.0), ("a", 5, 131, "last_trade_price", None, 0.55, None)]
    got = {x.snapshot_at: x for x in ingest.book_ticks(spark.createDataFrame(rows, "asset_id string, seq long, ts long, event_type string, side string, price double, size double")).collect()}
    assert (got[60].best_bid, got[60].best_ask, got[60].bid_depth_top5) == (0.45, 0.50, 13.0) and got[120].best_bid == 0.40
    assert (got[180].best_bid, got[180].best_ask, got[180].last_trade_price, got[180].mid_price) == (None, 0.60, 0.55, None)


def test_book_ticks_equal_a_replay(spark):
    r = random.Random(7)
    rows, seq, ts = [], 0, 0
    for _ in range(120):
        seq, ts, a = seq + 1, ts + r.randrange(25), r.choice("ab")
        kind = r.choice(["book", "price_change", "price_change", "price_change", "last_trade_price"])
        level = lambda: (r.choice(["bid", "ask"]), r.randrange(1, 9) / 10, float(r.randrange(3)))
        if kind == "last_trade_price":
            rows.append((a, seq, ts, kind, None, r.random(), None))
        else:
            rows += [(a, seq, ts, kind, *x) for x in {x[:2]: x for x in (level() for _ in range(4 if kind == "book" else 1))}.values()]
    want, books, last = {}, {"a": {}, "b": {}}, {"a": None, "b": None}
    for k, (a, q, ts, kind, side, price, size) in enumerate(rows):
        if kind == "last_trade_price":
            last[a] = price
        else:
            if kind == "book" and (k == 0 or rows[k - 1][1] != q):
                books[a] = {}
            books[a][side, price] = size
        live = {s: sorted((p for (s2, p), n in books[a].items() if s2 == s and n > 0), reverse=s == "bid") for s in ("bid", "ask")}
        depth = [sum(books[a][s, p] for p in live[s][:2]) if live[s] else None for s in ("bid", "ask")]
        want[a, (ts // 60 + 1) * 60] = (live["bid"][0] if live["bid"] else None, live["ask"][0] if live["ask"] else None, *depth, last[a])
    df = spark.createDataFrame(rows, "asset_id string, seq long, ts long, event_type string, side string, price double, size double")
    assert {(x.asset_id, x.snapshot_at): (x.best_bid, x.best_ask, x.bid_depth_top5, x.ask_depth_top5, x.last_trade_price) for x in ingest.book_ticks(df, depth=2).collect()} == want


def test_payloads(spark):
    market = json.dumps({"id": "1", "conditionId": "0xc", "question": "q", "outcomes": '["Yes","No"]', "outcomePrices": '["0.4","x"]', "liquidity": "12.5", "volume": 7, "clobTokenIds": '["1","2"]', "events": [{"id": "9", "slug": "e"}]})
    m = ingest.market_payloads(spark.createDataFrame([(market,), ("{",), (None,)], "raw string")).collect()
    assert (m[0].event_slug, m[0].outcome_prices, m[0].liquidity_usd, m[0].asset_ids) == ("e", [0.4, None], 12.5, ["1", "2"]) and len(m) == 3
    e = ingest.event_payloads(spark.createDataFrame([(json.dumps({"id": "9", "tags": ["NBA", {"label": "AI"}], "markets": [{"id": 1}]}),)], "raw string")).first()
    assert e.tags == ["NBA", "AI"]


def test_categories(spark):
    df = spark.createDataFrame([(["Esports", "SPORTS"],), (["Big Tech", "bitcoin"],), (["Bitcoin", "Crypto Prices"],), (["Elections", "fomc"],), (["Elections", "Geopolitics"],), (["NBA"],), ([],), (None,)], "tags array<string>")
    got = [tuple(x) for x in df.select(categorize_tags(F.col("tags")), primary_category(F.col("tags"))).collect()]
    assert got == [(["sports", "esports"], "sports"), (["crypto", "tech"], "crypto"), (["thesis"], "thesis"), (["macro", "elections"], "macro"), (["elections", "geopolitics"], "elections"), (["thesis"], "thesis"), (["thesis"], "thesis"), (["thesis"], "thesis")]


def test_axes_of_labels(spark):
    day = lambda y, m, d: (datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days
    want = {
        "2031-02-07 or so": (day(2031, 2, 7), None, None), "2031-02-30": (None, None, None), " Feb. 9th, 2031": (day(2031, 2, 9), None, None), "sept 4": (day(2030, 9, 4), None, None), "by March 5, 2031": (None, None, None), "Maybe 5, 2031": (None, None, None),
        "March 5 2031": (day(2030, 3, 5), None, None), "≥ 12": (None, 12.0, None), "At  least $1,250": (None, 1250.0, None), "over 2.5m units": (None, 2.5e6, None), "<= 3T": (None, None, 3e12), "Less than 2 seconds": (None, None, 2.0), "reach 70K": (None, None, None),
        "$1T-$1.25T": (None, None, None), "above 1.2.3": (None, None, None), "70K": (None, None, None), "": (None, None, None), None: (None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in want], "label string").withColumns(detectors.axes(F.col("label"), F.lit(2030)))
    assert {x.label: (x.date_axis, x.higher_axis, x.lower_axis) for x in df.collect()} == want
    assert df.where("label like 'sept%'").withColumns(detectors.axes(F.col("label"))).first().date_axis is None
    buckets = spark.createDataFrame([("2031-01-01",), ("Jun 3, 2031",), ("$5M to $6M",), ("At least $5",), ("≤ 3",), ("Someone",), ("June",), (None,)], "label string")
    assert [x[0] for x in buckets.select(detectors.is_bucket(F.col("label"))).collect()] == [True] * 5 + [False] * 3


def test_eligible_events(spark):
    rows = [("named", "A"), ("named", "B"), ("dates", "2031-01-01"), ("dates", "2031-02-01"), ("mixed", "2031-01-01"), ("mixed", "A"), ("one", "A"), ("game", "A"), ("game", "B")]
    m = spark.createDataFrame([(e, x, True, 5.0) for e, x in rows], "event_slug string, label string, order_book boolean, liquidity_usd double")
    tags = spark.createDataFrame([("game", ["Sports"]), ("named", ["AI"])], "event_slug string, tags array<string>")
    events = spark.createDataFrame([(e, 9.0) for e in ("named", "dates", "mixed", "one", "game")], "event_slug string, liquidity_usd double")
    assert {x.event_slug for x in detectors.mispricing_eligible(m, events, 0.0, tags).collect()} == {"named", "mixed"}
    # The event's own liquidity counts, unknown fails, and one market under its floor takes the event out.
    known = spark.createDataFrame([("named", 4.0), ("mixed", None), ("mixed", 20.0)], "event_slug string, liquidity_usd double")
    assert {x.event_slug for x in detectors.mispricing_eligible(m, known, 4.5, tags).collect()} == {"mixed"}
    thin = m.withColumn("liquidity_usd", F.when(F.col("event_slug") == "named", F.when(F.col("label") == "A", F.lit(None)).otherwise(9.0)).otherwise(F.col("liquidity_usd")))
    assert {x.event_slug for x in detectors.mispricing_eligible(thin, events, 0.0, tags, 5.0).collect()} == {"mixed"}
    placed = thin.withColumn("condition_id", F.col("label"))
    assert sorted((x.event_slug, x.label) for x in detectors.monotone_eligible(placed, known, 4.0, 12, 5.0).collect()) == [("mixed", "2031-01-01"), ("mixed", "A"), ("named", "B")]


def test_new_clusters_and_members(spark):
    scores = spark.createDataFrame([("a", "c1", 5), ("b", "c2", 7), ("c", "c3", 4), ("d", "c2", 7)], "component string, cluster_id string, score int")
    new = detectors.new_clusters(scores, spark.createDataFrame([("c1",)], "cluster_id string"))
    assert [(x.cluster_id, x.component) for x in new.collect()] == [("c2", "b")]
    members = spark.createDataFrame([("b", "w1"), ("b", "w2"), ("a", "w9")], "component string, wallet_address string")
    stored = spark.createDataFrame([("c2", "w1", 3)], "cluster_id string, wallet_address string, added_at long")
    assert sorted(map(tuple, detectors.updated_members(stored, new, members, 8).collect())) == [("c2", "w1", 3), ("c2", "w2", 8)]


def test_skill_and_growth(spark):
    p = spark.createDataFrame([("a", 0.5, 10.0, 1, 5.0, 10.0), ("a", 0.2, 10.0, 0, -2.0, 0.0), ("a", 0.4, 10.0, 0, 0.0, 0.0), ("a", 1.0, 10.0, 1, 9.0, 9.0), ("a", 0.4, 10.0, 0, None, 3.0)], "wallet_address string, avg_price double, size double, won int, realized_pnl double, current_value double")
    x = detectors.wallet_skill(p).first()
    assert (x.positions, x.wins, x.excess_pnl_usd, x.total_stake_usd) == (3, 1, 3.0, 11.0)
    assert x.mean_edge == pytest.approx((0.5 - 0.2 - 0.4) / 3) and x.weighted_edge == pytest.approx((2.5 - 0.4 - 1.6) / 11)
    h = spark.createDataFrame([(w, "m", "YES", k, s, 0.5) for w in "abc" for k, s in ((1, 0.0), (2, 20_000.0), (3, 120_000.0))], "wallet_address string, condition_id string, outcome_side string, snapshot_at long, size double, avg_price double")
    e = spark.createDataFrame([("a", 0.1), ("b", -0.3)], "wallet_address string, mean_edge double")
    got = {(x.wallet_address, x.snapshot_at): x.severity for x in detectors.position_growth(h, e).collect()}
    assert got == {("a", 2): "med", ("a", 3): "high", ("b", 2): "low", ("b", 3): "low", ("c", 2): "low", ("c", 3): "low"}


def test_velocity_alerts_of_both_outcomes_are_one(spark):
    moves = spark.createDataFrame([("y", 120, 0.10, False, True), ("n", 130, -0.3, False, True), ("y", 190, 0.1001, False, True), ("z", 130, 0.4, True, True), ("q", 130, 0.4, False, False)], "asset_id string, snapshot_at long, change double, consolidated boolean, liquid boolean")
    assets = spark.createDataFrame([("y", "m"), ("n", "m")], "asset_id string, condition_id string")
    got = {x.alert_key: (x.asset_id, x.severity) for x in detectors.velocity_alerts(moves, assets).collect()}
    assert got == {"velocity:m:2": ("y", "med"), "velocity:m:3": ("y", "high"), "velocity:z:2": ("z", "low")}


def burst_start(times, at, step, factor, back, baseline):
    """The walk back, window by window."""
    known = [t for t in times if at - baseline <= t <= at]
    if not known:
        return at - back
    least, quiet, end = len(known) / (baseline / 60) * factor * (step / 60), 0, at
    while end > at - back:
        start = max(end - step, at - back)
        quiet = quiet + 1 if sum(start <= t < end for t in known) < least else 0
        if quiet == 2:
            return end
        end = start
    return at - back


def test_burst_windows_equal_the_walk(spark):
    r = random.Random(3)
    times = {m: sorted(r.choice([r.randrange(90_000, 100_000), r.randrange(95_000, 97_000), 100_000, 99_700]) for _ in range(n)) for m, n in (("a", 0), ("b", 3), ("c", 40), ("d", 300))}
    times["e"] = [99_500, 99_450, 99_400]
    trades = spark.createDataFrame([(m, t) for m, ts in times.items() for t in ts], "condition_id string, ts long")
    alerts = spark.createDataFrame([(f"{m}{at}", m, at) for m in times for at in (96_500, 98_001, 100_000)], "alert_key string, condition_id string, at long")
    for step, back in ((300, 7200), (400, 1000)):
        got = {x.alert_key: x.since for x in detectors.burst_windows(alerts, trades, step=step, back=back, baseline_s=9000).collect()}
        assert got == {f"{m}{at}": burst_start(ts, at, step, 3.0, back, 9000) for m, ts in times.items() for at in (96_500, 98_001, 100_000)}


def test_burst_hits_take_first_trades(spark):
    rows = [("m", "YES", "BUY", w, 60 + k, s) for k, (w, s) in enumerate([("a", 10.0), ("b", 11.0), ("c", 12.0), ("d", 10.0), ("a", 900.0), ("e", 0.0), ("e", 10.0)])]
    t = spark.createDataFrame([(*x, f"t{k}", "x") for k, x in enumerate(rows)], "condition_id string, outcome_side string, bs string, wallet_address string, ts long, size double, tx_hash string, asset_id string")
    hit = detectors.burst_hits(t).first()
    assert (hit.n_wallets, hit.median_size, hit.wallets) == (4, 10.5, ["a", "b", "c", "d"])


def test_burst_hits_at_the_limit_of_variation(spark):
    """Sizes 0.9k, 0.9k, 2.1k, 2.1k vary by 0.4 of their mean, in whatever order they are added."""
    rows = [(f"m{k}", "YES", "BUY", w, 60, 0.3 * k * s, f"t{w}", "x") for k in range(1, 80) for w, s in zip("abcd", [(3, 3, 7, 7), (3, 7, 3, 7), (7, 3, 3, 7), (7, 7, 3, 3)][k % 4], strict=True)]
    t = spark.createDataFrame(rows, "condition_id string, outcome_side string, bs string, wallet_address string, ts long, size double, tx_hash string, asset_id string")
    assert detectors.burst_hits(t.repartition(3)).count() == 79


def test_a_cluster_without_shared_markets_has_no_figures_of_them(spark):
    members = spark.createDataFrame([(w, "c") for w in "abc"], "wallet_address string, component string")
    t = spark.createDataFrame([("a", "m1", "BUY", 1.0, 5, "m1:Y", "t")], "wallet_address string, condition_id string, bs string, size double, ts long, asset_id string, tx_hash string")
    seen = spark.createDataFrame([("a", 5)], "wallet_address string, first_activity_at long")
    c = detectors.cluster_scores(members, t, seen, t.select("condition_id")).first()
    assert (c.member_count, c.dated, c.score, c.shared_markets, c.burst_wallets, c.size_cv, c.buy_ratio, c.severity) == (3, 1, 0, None, None, None, None, None)


def test_cluster_scores(spark):
    """Three members share three obscure markets; sizes are alike in one of them, and one has a burst."""
    members = spark.createDataFrame([(w, "c1") for w in ("A", "b", "c")] + [("d", "c2")], "wallet_address string, component string")
    seen = spark.createDataFrame([("A", 0), ("b", 86_400), ("c", 10)], "wallet_address string, first_activity_at long")
    rows = [(w, m, "BUY" if k else "SELL", s * (1 + k), 5000 * k) for k, w in enumerate(("A", "b", "c")) for m, s in (("m1", 1.0), ("m2", 1.0))]
    rows += [(w, "m3", "BUY", 10.0 + k, 60_000 + k) for k, w in enumerate(("A", "b", "c"))] + [("A", "big", "SELL", 9.0, 1), ("b", "big", "SELL", 900.0, 1), ("c", "big", "SELL", 1.0, 1), ("d", "m1", "SELL", 1.0, 1)]
    t = spark.createDataFrame([(*x, f"{x[1]}:Y", f"t{k}") for k, x in enumerate(rows)], "wallet_address string, condition_id string, bs string, size double, ts long, asset_id string, tx_hash string")
    obscure = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "condition_id string")
    got = {x.component: x for x in detectors.cluster_scores(members, t, seen, obscure).collect()}
    c1, c2 = got["c1"], got["c2"]
    assert (c1.score, c1.severity, c1.shared_markets, c1.burst_wallets, c1.behavior_tag, c1.member_count) == (7, "high", 3, 3, "farmer", 3) and c1.buy_ratio == pytest.approx(7 / 9)
    assert c1.cluster_id == "cluster-" + hashlib.sha256(b"a|b|c").hexdigest()[:16] and (c2.score, c2.severity, c2.behavior_tag, c2.dated) == (0, None, None, 0)


def test_cotrade_edges_equal_all_pairs(spark):
    r = random.Random(4)
    held = {f"w{k}": {f"m{r.randrange(3) if r.random() < 0.5 else r.randrange(12)}" for _ in range(r.randrange(1, 8))} for k in range(30)}
    t = spark.createDataFrame([(w, m, k, "x", "y") for w, ms in held.items() for k, m in enumerate(sorted(ms))], "wallet_address string, condition_id string, ts long, tx_hash string, asset_id string")
    markets = spark.createDataFrame([(f"m{k}",) for k in range(11)], "condition_id string")
    want = {(a, b): len((held[a] & held[b]) - {"m11"}) for a in held for b in held if a < b and len((held[a] & held[b]) - {"m11"}) >= 3}
    assert {(x.a, x.b): x.shared for x in detectors.cotrade_edges(t, markets).collect()} == want and want


def test_rolling_windows_equal_pairs(spark):
    r = random.Random(5)
    rows = [(f"w{r.randrange(6)}", f"m{r.randrange(2)}", r.randrange(400), float(r.randrange(9)), f"t{k}", "x") for k in range(120)]
    t = spark.createDataFrame(rows, "wallet_address string, condition_id string, ts long, notional_usd double, tx_hash string, asset_id string")
    roster = spark.createDataFrame([(f"w{k}",) for k in range(5)], "wallet_address string")
    own = [x for x in rows if x[0] != "w5"]
    near = {x[4]: [y for y in own if y[1] == x[1] and x[2] - 50 <= y[2] <= x[2]] for x in own}
    got = {x.tx_hash: (x.n_wallets, x.total_usd) for x in detectors.convergence(t, roster, 50, newest=1000).collect()}
    assert got == {k: (len({y[0] for y in ys}), sum(y[3] for y in ys)) for k, ys in near.items() if len({y[0] for y in ys}) >= 2}
    members = roster.withColumn("component", F.lit("c"))
    assert {x.tx_hash: x.n_active for x in detectors.cluster_active(t, members, 50).collect()} == {k: v[0] for k, v in got.items()}


def test_components_and_groups(spark):
    from oddsmill.sources.tables import scratch_table

    chain = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(40)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("d", "c"), *chain], "a string, b string")
    got = detectors.components(edges, scratch_table)
    rows = {tuple(x) for x in got.collect()}
    assert {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")} <= rows and {c for w, c in rows if w[0] == "k"} == {"k000"} and len(rows) == 47
    assert [x.wallet_address for x in detectors.cluster_groups(got.where("component = 'a'"), 3, 3).orderBy("wallet_address").collect()] == ["a", "b", "c"]


def test_venue_rules(spark):
    bets = spark.createDataFrame([("1", "c", "u", "YES", -5.0, 0.3, 9, None, None, None), ("2", "c", "u", "answer", 7.0, 0.3, 9, True, False, 0.4), ("3", "c", "u", "NO", 7.0, 0.3, 9, False, False, 0.4), ("4", "c", "u", "NO", 7.0, 0.3, 9, True, True, None)], "id string, contract_id string, user_id string, outcome string, amount double, prob_before double, created_time long, is_filled boolean, is_cancelled boolean, limit_prob double")
    assert sorted(tuple(x)[1:9] for x in ingest.bet_trades(bets).collect()) == [("1", "c:YES", "u", "c", "YES", "BUY", 0.3, -5.0), ("2", "c:answer", "u", "c", "answer", "BUY", 0.3, 7.0)]
    m = spark.createDataFrame([("binary", "yes", 10_000.0, s) for s in ("determined", "amended", "finalized", "settled", "closed")], "market_type string, result string, volume double, status string")
    assert [x.status for x in corpus.exchange_qualifier(m).collect()] == ["determined", "amended", "finalized"]
    t = spark.createDataFrame([("polymarket", "h", "a", "0xAB", 9.99, 1, 1.0, 0.5, "BUY"), ("polymarket", "h", "a", "0xAB", 10.0, 3, 1.0, 0.5, "BUY"), ("polymarket", "h", "a", "0xab", 11.0, 2, 1.0, 0.5, "BUY"), ("elsewhere", "h", "a", "Q", 9.0, 1, 1.0, 0.5, "BUY"), ("manifold", "h", "a", "Q", 99.0, 1, 1.0, 0.5, "BUY")], "platform string, tx_hash string, asset_id string, wallet_address string, notional_usd double, ts long, size double, price double, bs string")
    assert [(x.wallet_address, x.ts) for x in ingest.stored_trades(t).collect()] == [("0xab", 2)]


def test_polls_end_at_known_rows(spark):
    new = spark.createDataFrame([("a", k, f"h{k}") for k in range(10)], "condition_id string, ts long, tx_hash string")
    known = spark.createDataFrame([("h7",), ("h5",), ("h4",), ("h1",)], "tx_hash string")
    assert sorted(x.ts for x in ingest.until_known(new, known, ["tx_hash"], "condition_id", stop=2).collect()) == [6, 8, 9]
    assert sorted(x.ts for x in ingest.newer_than_seen(new, new.where("ts = 4")).collect()) == [5, 6, 7, 8, 9]


def test_watchlist(spark):
    rows = spark.createDataFrame([("a", "manual", False), ("b", "tracked", True)], "address string, source string, active boolean")
    fresh = spark.createDataFrame([("a", "whale", 1), ("c", "whale", 1)], "address string, source string, added_at long")
    both = ingest.keep_first_provenance(fresh, rows)
    assert sorted((x.address, x.source, x.active) for x in both.collect()) == [("a", "manual", True), ("b", "tracked", True), ("c", "whale", True)]
    assert {x.address: x.active for x in ingest.deactivate(both, fresh).collect()} == {"a": False, "b": True, "c": False}


def test_as_of_equals_a_scan(spark):
    r = random.Random(6)
    known = [(f"k{r.randrange(3)}", r.randrange(300), k) for k in range(40)]
    known = [*{x[:2]: x for x in known}.values()]
    points = [(f"k{r.randrange(4)}", r.randrange(320), f"p{k}") for k in range(60)]
    got = ledger.as_of(spark.createDataFrame(points, "key string, at long, name string"), spark.createDataFrame(known, "key string, at long, value int"), "key", "value", day=50)
    want = {n: max(((a, v) for k2, a, v in known if k2 == k and a <= at), default=(0, None))[1] for k, at, n in points}
    assert {x.name: x.value for x in got.collect()} == want


def test_reports_count_taken_bets(spark):
    df = spark.createDataFrame([("m", 0.1, 0.2, 1), ("m", 0.3, 0.2, 1), ("n", 1.0, 1.1, 0), ("n", 0.55, 0.6, 1)], "condition_id string, implied_prob_at_buy double, pred double, label_won int")
    assert {x.decile: (x.n, round(x.mean_edge, 6)) for x in model.edge_by_decile(df).collect()} == {1: (1, 0.9), 9: (1, -1.0), 5: (1, 0.45)}
    volumes = spark.createDataFrame([("m", 249_999.0), ("n", 25e6)], "condition_id string, total_volume_usd double")
    assert {x.bucket: x.n for x in model.edge_by_volume(df, volumes).collect()} == {"<250K": 1, "25M+": 2}


def test_ledger_and_diff(spark):
    cache = spark.createDataFrame([("m", False, ["Yes", "No"], ["1", "2"], [1.0, 0.0]), ("n", True, ["Yes", "No"], ["3", "4"], [0.4, 0.6])], "condition_id string, active boolean, outcomes array<string>, asset_ids array<string>, outcome_prices array<double>")
    book = spark.createDataFrame([("t1", "entry", None, "k1", "velocity", None, "m", "1", 50.0, 0.5, 25.0, 1), ("t2", "entry", None, "k2", "velocity", None, "n", "3", 50.0, 0.5, 25.0, 2)], "trade_id string, trade_kind string, parent_trade_id string, alert_key string, source string, rule_variant string, condition_id string, asset_id string, shares double, price double, cost_usd double, ts long")
    full = book.unionByName(ledger.book_exits(book, cache, 9))
    assert [(x.trade_id, x.nav) for x in ledger.nav_curve(full).collect()] == [("t1", 1025.0)]
    assert [x.trade_id for x in ledger.open_positions(full).collect()] == ["t2"] and ledger.summary(full).first().nav == 1025.0
    assert {x.column: x.mismatches for x in report.dataset_diff(book, book.where("trade_id = 't1'"), ["trade_id"]).collect()}["_only_left"] == 1
    assert corpus.resolve_by_price(cache).count() == 1


def streamed(spark, tmp_path, rows, schema, order, make, batches=3):
    """What a stream of files makes of ``rows``, dealt out in order."""
    df = spark.createDataFrame(rows, schema)
    rows = sorted(rows, key=lambda x: x[df.columns.index(order)])
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return df, spark.read.parquet(str(tmp_path / "out"))


def test_streamed_velocity_equals_the_batch(spark, tmp_path):
    from oddsmill.streaming.detect import stream_velocity

    r = random.Random(9)
    rows = [(a, 10 * k + r.randrange(9), r.choice([None, 0.5, 0.52, 0.6, 0.7]), r.choice([1.0, 9.0]), 400.0, r.choice([300.0, 5.0])) for k in range(60) for a in ("x", "y")]
    schema = "asset_id string, snapshot_at long, mid_price double, spread double, bid_depth_top5 double, ask_depth_top5 double"
    batch, out = streamed(spark, tmp_path, rows, schema, "snapshot_at", lambda s: stream_velocity(s, 60, 5))
    want = detectors.velocity(batch, 60, 5).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_streamed_whales_and_clusters_equal_the_batch(spark, tmp_path):
    from oddsmill.streaming.detect import stream_cluster_active, stream_whales

    r = random.Random(10)
    rows = [(f"t{k}", f"w{r.randrange(6)}", f"m{r.randrange(2)}", k * 40, float(r.randrange(5000)), "x") for k in range(60)]
    schema = "tx_hash string, wallet_address string, condition_id string, ts long, notional_usd double, asset_id string"
    members = spark.createDataFrame([(f"w{k}", f"c{k % 2}") for k in range(5)], "wallet_address string, component string")
    batch, out = streamed(spark, tmp_path / "c", rows, schema, "ts", lambda s: stream_cluster_active(s, members, 200))
    want = detectors.cluster_active(batch, members, 200).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    cache = spark.createDataFrame([("m0", 20_000.0), ("m1", 90_000.0)], "condition_id string, liquidity_usd double")
    seen = spark.createDataFrame([(f"w{k}", 0, 9) for k in range(4)], "wallet_address string, first_activity_at long, total_trades long")
    batch, out = streamed(spark, tmp_path / "w", rows, schema, "ts", lambda s: stream_whales(s, cache, seen))
    want = detectors.whale_alerts(batch, cache, seen).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_training_stops_early_and_scores_again(spark, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    r = random.Random(11)
    rows = []
    for k in range(300):
        good = r.random()
        rows.append((("train", "validation", "test")[k % 3], r.choice(["YES", "NO"]), r.choice(["crypto", None]), "x", good if k % 7 else None, float("nan") if k % 11 == 0 else 1.0, int(good > 0.5), 0.5, f"m{k}"))
    df = spark.createDataFrame(rows, "split string, side string, top_category string, market_category string, win_rate double, other double, label_won int, implied_prob_at_buy double, condition_id string")
    t = model.train_and_test(df, {"maxDepth": [1, 2], "maxIter": [3]}, n_min=5)
    got = {x.split: x for x in t.metrics.collect()}
    assert set(got) == {"train", "validation", "test"} and got["test"].edge > 0.3 and 1 <= t.trees <= 3 and got["test"].rows == 100
    assert model.importances(t.model, t.columns, spark).first().feature == "win_rate" and "side=NO" in t.columns and "label_won" not in t.columns
    t.save(str(tmp_path / "gate"))
    again = GBTClassificationModel.load(str(tmp_path / "gate" / "model"))
    key = lambda d: sorted((x.condition_id, round(x.pred, 9)) for x in d.collect())
    assert key(t.score(df)) == key(model.score(again, model.prepared(df, t.levels, t.columns)))
    assert json.loads(spark.read.text(str(tmp_path / "gate" / "meta")).first().value)["trees"] == t.trees
    # The edge of the first trees equals that of models cut to them.
    ready = model.prepared(df, t.levels, t.columns).where("split = 'validation'")
    edges = model.edge_by_trees(t.model, ready, 5)
    assert edges[-1] == pytest.approx(model.realized_edge(model.score(t.model, ready), 5).first().edge)


def test_search_by_halving_fits_less_and_exports_what_it_fitted(spark):
    r = random.Random(12)
    rows = []
    for k in range(900):
        good = r.random()
        rows.append((("train", "train", "validation")[k % 3], r.choice(["YES", "NO"]), r.choice(["crypto", None]), "x", good if k % 7 else None, float("nan") if k % 11 == 0 else r.random(), int(good > 0.5), 0.5, f"m{k}"))
    df = spark.createDataFrame(rows, "split string, side string, top_category string, market_category string, win_rate double, other double, label_won int, implied_prob_at_buy double, condition_id string")
    grid = {"maxDepth": [1, 2, 3], "stepSize": [0.1], "maxIter": [2, 4]}
    t = model.train_and_test(df, grid, n_min=5)
    assert t.search.fitted < t.search.grid == 18 and t.search.edge > 0.35
    ready = model.prepared(df, t.levels, t.columns)
    whole = [max(model.edge_by_trees(model._boosted(ready.where("split = 'train'"), {"maxDepth": d, "stepSize": 0.1, "maxIter": 4}, 7), ready.where("split = 'validation'"), 5)) for d in (1, 3)]
    assert t.search.edge >= min(whole) - 1e-9
    both = t.score(model.scored_by(model.exported(t), df).withColumnRenamed("pred", "plain"))
    assert both.where("abs(plain - pred) > 1e-9").count() == 0 and both.count() == 900


def test_sides_by_the_assets_of_a_market(spark):
    cache = spark.createDataFrame([("m", ["1", "2"], [" Yes", "no"]), ("n", ["3", "4", "5"], ["Up", "YES"])], "condition_id string, asset_ids array<string>, outcomes array<string>")
    trades = spark.createDataFrame([("m", "1", "?"), ("m", "2", "?"), ("m", "9", "?"), ("n", "3", "?"), ("n", "4", "?"), ("n", "5", "?"), ("x", "1", "?")], "condition_id string, asset_id string, outcome_side string")
    assert sorted(map(tuple, model.with_outcome_side(trades, cache).collect())) == [("m", "1", "YES"), ("m", "2", "NO"), ("n", "4", "YES")]


def test_diff_joins_only_ranges_that_differ(spark):
    left = spark.range(20_000).select("id", (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 7 > 0, "t").alias("y"))
    right = left.withColumn("x", F.when(F.col("id") == 77, F.col("x") + 1).when(F.col("id") == 78, F.col("x") * (1 + 1e-13)).otherwise(F.col("x"))).where("id <> 5")
    a, b = report.differing_ranges(left, right, ["id"])
    assert 3 <= a.count() < 40 and {5, 77, 78} <= {x.id for x in a.collect()} and {77, 78} <= {x.id for x in b.collect()}
    assert {x.column: x.mismatches for x in report.dataset_diff(left, right, ["id"]).collect()} == {"x": 1, "y": 0, "_only_left": 1, "_only_right": 0}
    assert report.differing_ranges(left, left, ["id"])[0].isEmpty()
    assert {x.mismatches for x in report.dataset_diff(left, left, ["id"]).collect()} == {0}
