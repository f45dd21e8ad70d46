"""Operators made for hot keys and large values, against plain ones."""

import random
import statistics
from functools import reduce

import pytest
from pyspark.sql import functions as F

from oddsmill.functions.bigint import hex_to_decimal
from oddsmill.operators.graph import star_components
from oddsmill.operators.intervals import dyadic_blocks, interval_join, with_next
from oddsmill.operators.quantiles import grouped_medians
from oddsmill.sources.tables import scratch_table


def test_256_bit_numbers(spark):
    r = random.Random(1)
    numbers = [0, 1, 9, 10**9 - 1, 10**9, 2**28, 2**64 - 1, 2**128, 10**77, 2**256 - 1] + [r.getrandbits(r.randrange(1, 257)) for _ in range(300)]
    rows = spark.createDataFrame([(k, f"{n:064x}") for k, n in enumerate(numbers)] + [(-1, None), (-2, "f" * 63), (-3, "g" * 64)], "k int, word string")
    got = {x.k: x.d for x in rows.select("k", hex_to_decimal(F.col("word")).alias("d")).collect()}
    assert [got[k] for k in range(len(numbers))] == [str(n) for n in numbers] and got[-1] is got[-2] is got[-3] is None
    assert "Python" not in rows.select(hex_to_decimal(F.col("word")))._jdf.queryExecution().executedPlan().toString()


def brute_components(edges):
    of = {x: x for e in edges for x in e}

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {x: find(x) for x in of}


def test_star_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(200, 200)]
    edges += [(1000, k) for k in range(400, 460)] + [(399, k) for k in range(500, 560)] + [(600 + k, 601 + k) for k in range(50)]
    got = star_components(spark.createDataFrame(edges, "a long, b long"), scratch_table, lane_edges=8)
    assert {x.node: x.component for x in got.collect()} == brute_components(edges) and got.count() == len(brute_components(edges))


def test_a_large_star_beside_a_long_chain_takes_few_rounds(spark):
    star = spark.range(100_000).select(F.lit(5_000_000).cast("long").alias("a"), (F.col("id") + 1_000_000).alias("b"))
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rounds = []

    def write(df, name):
        rounds.append(name)
        return scratch_table(df, name)

    got = star_components(star.unionByName(chain), write, lane_edges=5000).groupBy("component").count().collect()
    assert {x.component: x["count"] for x in got} == {0: 3001, 1_000_000: 100_001}
    assert rounds.count("small-star") <= 16


def test_dyadic_blocks_cover_each_number_once(spark):
    r = random.Random(3)
    rows = [(lo, lo + r.randrange(0, 2 ** r.randrange(1, 12))) for lo in [r.randrange(-5000, 5000) for _ in range(200)]] + [(7, 7), (0, 0), (-1, -1), (-8, 7), (5, 4)]
    for x in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", dyadic_blocks(F.col("lo"), F.col("hi")).alias("b")).collect():
        covered = sorted(n for b in x.b for n in range(b.block << b.level, (b.block + 1) << b.level))
        assert covered == list(range(x.lo, x.hi + 1)) and len(x.b) <= 26


@pytest.mark.parametrize("unit", [1, 100])
def test_interval_join_equals_the_plain_join(spark, unit):
    r = random.Random(unit)
    points = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, r.randrange(-2000, 9000)]) if k % 9 == 0 else r.randrange(-2000, 9000), k) for k in range(400)]
    spans = [(r.choice(["a", "b", "d"]), lo, lo + r.choice([-1, 0, 1, 50, 3000]), k) for k, lo in enumerate(r.randrange(-2000, 8000) for _ in range(60))] + [("a", None, 5, 99)]
    p, s = spark.createDataFrame(points, "key string, at long, p long"), spark.createDataFrame(spans, "key string, lo long, hi long, s long")
    got = interval_join(p, s, ["key"], "at", "lo", "hi", unit)
    want = sorted((x[2], y[3]) for x in points for y in spans if x[0] == y[0] and x[1] is not None and y[1] is not None and y[1] <= x[1] <= y[2])
    assert sorted((x.p, x.s) for x in got.collect()) == want != []
    assert interval_join(p, s.limit(0), ["key"], "at", "lo", "hi", unit).count() == 0


def test_next_rows_across_buckets(spark):
    r = random.Random(4)
    rows = sorted({r.randrange(-500, 5000) for _ in range(120)})
    got = with_next(spark.createDataFrame([(t, t * 2) for t in rows], "ts long, block long"), "ts", ["ts", "block"], 100)
    assert sorted(map(tuple, got.collect())) == [(t, 2 * t, n, n and 2 * n) for t, n in zip(rows, [*rows[1:], None], strict=True)]


@pytest.mark.parametrize("upper", [False, True])
def test_medians_of_hot_groups_equal_sorting(spark, upper):
    r = random.Random(5)
    groups = {"skewed": [r.lognormvariate(0, 8) for _ in range(900)], "few": [r.choice([1.0, 2.0, 1e300]) for _ in range(601)], "one": [7.0] * 500, "small": [3.0, 1.0], None: [r.gauss(0, 1) for _ in range(1000)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(1200)]}
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("nulls", 1, None), ("small", 1, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {x.g: (x.n, x.median) for x in grouped_medians(df, ["g", "h"], "v", scratch_table, upper, most=100, bins=64).collect()}
    want = statistics.median_high if upper else statistics.median
    assert got == {g: (len(vs), want(vs)) for g, vs in groups.items()}
    plain = grouped_medians(df, ["g", "h"], "v", scratch_table, upper)
    assert {x.g: (x.n, x.median) for x in plain.collect()} == got


def test_trades_cross_the_network_once(spark):
    from oddsmill.plans import views

    plan = views._trades(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # the two sides of the join


@pytest.mark.parametrize("most", [2000, 4, 0])
def test_pairs_of_wallets_equal_counting_all(spark, most):
    """Whatever number of wallets makes a market hot."""
    from oddsmill.operators.detectors import cotrade_edges

    r = random.Random(6)
    held = sorted({(f"w{r.randrange(40)}", f"m{int(r.random() ** 2 * 30)}") for _ in range(420)})
    trades = spark.createDataFrame([(w, m, k, f"t{k}", "a") for k, (w, m) in enumerate(held)], "wallet_address string, condition_id string, ts long, tx_hash string, asset_id string")
    markets = spark.createDataFrame([(f"m{k}",) for k in range(29)], "condition_id string")
    own = {}
    for w, m in held:
        own.setdefault(w, set()).update({m} - {"m29"})
    want = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and len(own[a] & own[b]) >= 3}
    got = cotrade_edges(trades, markets, most=most, pairs_a_task=50).collect()
    assert {(x.a, x.b): x.shared for x in got} == want != {} and len(got) == len(want)


def _busy(spark):
    """Wallets a, b and c share three markets and then trade 600 times each in a market of their own."""
    rows = [(w, f"m{k}", k, f"{w}{k}", "y") for w in "abc" for k in range(3)] + [(w, f"own-{w}", 100 + k, f"{w}-{k:03}", "y") for w in "abc" for k in range(600)]
    return spark.createDataFrame(rows, "wallet_address string, condition_id string, ts long, tx_hash string, asset_id string")


def test_pairs_of_wallets_count_old_trades_too(spark):
    from oddsmill.operators.detectors import cotrade_edges

    trades = _busy(spark)
    markets = trades.select("condition_id").distinct()
    for most in (2000, 1):
        assert sorted(map(tuple, cotrade_edges(trades, markets, most=most).collect())) == [("a", "b", 3), ("a", "c", 3), ("b", "c", 3)]


def test_components_join_wallets_by_old_trades_too(spark):
    from oddsmill.operators.detectors import components, cotrade_edges

    trades = _busy(spark)
    found = components(cotrade_edges(trades, trades.select("condition_id").distinct()), scratch_table)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_a_large_cluster_is_scored_by_all_members_and_all_their_trades(spark):
    """Of 150 members the last three alone share markets, by trades older than 600 others of each; the last but one has no creation time near the rest."""
    import hashlib

    from oddsmill.operators import detectors

    names = [f"w{k:03}" for k in range(150)]
    members = detectors.cluster_groups(spark.createDataFrame([(w, "w000") for w in names] + [("x", "x"), ("y", "x")], "wallet_address string, component string"))
    rows = [(w, f"m{k}", "BUY", 5.0 + k, 10 * k, f"m{k}:Y", f"{w}-{k}") for w in names[-3:] for k in range(3)] + [(w, f"own-{w}", "SELL", 1.0, 10**6 + k, "o", f"{w}+{k}") for w in names[-3:] for k in range(600)]
    trades = spark.createDataFrame(rows, "wallet_address string, condition_id string, bs string, size double, ts long, asset_id string, tx_hash string")
    seen = spark.createDataFrame([(w, 10**9 if k == 148 else k) for k, w in enumerate(names)], "wallet_address string, first_activity_at long")
    got = detectors.cluster_scores(members, trades, seen, trades.select("condition_id").distinct()).collect()
    assert [(x.component, x.member_count, x.last_created, x.shared_markets, x.burst_wallets, x.behavior_tag, x.score) for x in got] == [("w000", 150, 10**9, 3, 3, "trader", 5)]
    assert got[0].cluster_id == "cluster-" + hashlib.sha256("|".join(names).encode()).hexdigest()[:16]


def test_every_wallet_of_every_burst_is_a_candidate(spark, tmp_path):
    """A bucket of 80 wallets lists all of them, and a market may have any number of such buckets."""
    from datetime import datetime

    import __spark_entry__

    year = lambda k: datetime(1972 + k % 4, 6, 1 + k % 27)
    lines = [(k, 1 if k < 80 else 2, 1, 1, 10.0 if k < 80 else 10.0 + 400 * (k // 4 % 2), 0.0, "N", "O", year(0 if k < 80 else k)) for k in range(160)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k) for k in range(160)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = __spark_entry__.queries()["candidate_wallets"](spark, str(tmp_path)).collect()
    assert sorted(x.address for x in got) == sorted(f"w{k}" for k in range(80))


def test_an_expanded_cluster_meets_each_trade_once(spark):
    from oddsmill.operators import detectors

    trades = spark.createDataFrame([(w, "m", "BUY", 0.5, 10.0, t, f"{w}{t}", "a") for t in (0, 10**6, 3 * 10**7) for w in "abcd"], "wallet_address string, condition_id string, bs string, price double, size double, ts long, tx_hash string, asset_id string")
    seen = []
    kept, detectors.scratch_table = detectors.scratch_table, lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1]
    try:
        got = detectors.expand_cluster(trades, spark.createDataFrame([("a",), ("b",), ("c",)], "wallet_address string")).collect()
    finally:
        detectors.scratch_table = kept
    assert [(x.wallet_address, x.n_trades) for x in got] == [("d", 3)] and not any("Generate" in p for p in seen)


def test_features_cross_the_network_by_market_and_by_wallet(spark):
    from oddsmill.operators.features import build_features

    kinds = {"platform": "string", "tx_hash": "string", "asset_id": "string", "wallet_address": "string", "condition_id": "string", "outcome_side": "string", "bs": "string", "price": "double", "size": "double", "notional_usd": "double", "ts": "long"}
    t = spark.createDataFrame([("polymarket", "t", "a", "w", "m", "YES", "BUY", 0.5, 1.0, 0.5, 5)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    m = spark.createDataFrame([("polymarket", "m", "tech", "[]", 9)], "platform string, condition_id string, category string, categories_json string, closed_at long").hint("merge")
    ends = spark.createDataFrame([("polymarket", "m", 1, 9)], "platform string, condition_id string, outcome_yes_won int, resolved_at long").hint("merge")
    plan = build_features(t, m, ends)._jdf.queryExecution().executedPlan().toString().split("\n")
    wide = [x for x in plan if "Exchange hashpartitioning" in x]
    assert sum("(wallet_address" in x for x in wide) == 1 and all("tx_hash" not in x.split("),")[0] or "wallet_address" in x for x in wide) and len(wide) <= 9


def test_money_looks_up_no_asset(spark):
    """Half of all sides are money: none of them reaches the shuffle by asset."""
    from oddsmill.operators.ingest import subgraph_fills

    fills = spark.createDataFrame([("t1", 0, "0", "a"), ("t2", 0, "b", "0"), ("t3", 0, "a", "b"), ("t4", 0, "0", "c")], "transaction_hash string, log_index int, maker_asset_id string, taker_asset_id string")
    out = subgraph_fills(fills, fills.limit(0), spark.createDataFrame([("a",), ("b",)], "asset_id string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(x.transaction_hash for x in out.collect()) == ["t1", "t2", "t3"] and plan.count("Join") == 1


def test_pages_come_from_files_of_bounded_rows(spark, tmp_path):
    from oddsmill.sources import versioned

    rows = spark.range(1000).select(F.col("id").alias("ts"), *[F.lit("x").alias(c) for c in ("tx_hash", "asset_id", "wallet_address")])
    versioned.write_paged(rows, str(tmp_path / "p"), 2, most=100)
    assert spark.read.parquet(str(tmp_path / "p" / "ranges")).count() >= 8
    assert [x.ts for x in versioned.page(spark, str(tmp_path / "p"), (149, "x", "x", "x"), 100).collect()] == list(range(150, 250))


def test_floors_are_met_by_rounded_figures(spark, monkeypatch):
    """A profit of ten in parts that add up to a little less is ten."""
    from oddsmill.plans import queries, views

    parts = [0.5, 0.9, 0.7, 0.3, 0.4, 0.9, 0.5, 0.8, 0.8, 0.7, 0.6, 2.9]
    assert reduce(float.__add__, parts) < 10 and round(sum(parts), 8) == 10
    p = spark.createDataFrame([("w1", f"m{k}", "YES", 1, 1.0, 0.5, x, 1.0) for k, x in enumerate(parts)], "wallet_address string, condition_id string, outcome_side string, won int, size double, avg_price double, realized_pnl double, current_value double").coalesce(1)
    monkeypatch.setattr(views, "closed_positions", lambda *_: p)
    assert [x.wallet_address for x in queries.smart_roster(spark, "").collect()] == ["w1"]


@pytest.mark.parametrize("most", [10**6, 0])
def test_prices_as_of_take_the_largest_of_a_moment(spark, most):
    """A key that isn't hot crosses the network once."""
    from oddsmill.operators.ledger import as_of

    points = spark.createDataFrame([("a", 10, "p"), ("a", 9, "o"), ("a", 4 * 86_400, "q"), ("b", 5, "r"), (None, 5, "n")], "key string, at long, name string")
    known = spark.createDataFrame([("a", 10, 1.0), ("a", 10, 3.0), ("a", 10, 2.0), ("a", 86_400, 2.0), ("a", 86_400, 5.0), (None, 1, 7.0)], "key string, at long, v double")
    got = as_of(points, known, "key", "v", most=most)
    if most:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {x.name: x.v for x in got.collect()} == {"o": None, "p": 3.0, "q": 5.0, "r": None, "n": None}


def test_tables_of_all_markets_are_not_broadcast(spark):
    from oddsmill.operators import model
    from oddsmill.plans import views

    sf = "/root/testdata/sf0.001"
    rows = spark.createDataFrame([("m1", "1:YES")], "condition_id string, asset_id string")
    splits = model.temporal_split(views.resolutions(spark, sf))
    for joined in (rows.join(views.market_cache(spark, sf), "condition_id"), rows.join(views.resolutions(spark, sf), "condition_id"), rows.join(views.markets(spark, sf), "condition_id"), model.with_split(rows, splits)):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= plan.count("day#")


def test_resolutions_of_buys_are_made_behind_the_shuffle_by_wallet(spark):
    from oddsmill.plans import queries

    plan = queries._examples(spark, "/root/testdata/sf0.001").select("win_rate")._jdf.queryExecution().executedPlan().toString()
    by_wallet = next(x for x in plan.split("\n") if "Exchange hashpartitioning(wallet_address" in x)
    assert 0 < plan.index("Generate explode") < plan.index(by_wallet)  # plans are printed from their end


SMALLEST = "/root/testdata/sf0.001"


def test_tasks_of_trades_and_features_grow_with_the_rows_and_change_none(spark, monkeypatch):
    from oddsmill.operators import features
    from oddsmill.plans import views
    from oddsmill.sources import tables

    trades, markets, ends = views.trades(spark, SMALLEST), views.markets(spark, SMALLEST), views.resolutions(spark, SMALLEST)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    pick = ["tx_hash", "asset_id", "wallet_address", "prior_trades_count", "win_rate", "market_volume_so_far_usd"]
    plain = rows(trades), rows(features.build_features(trades, markets, ends).select(*pick))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 400)
    many = views._trades(spark, SMALLEST), features.build_features(trades, markets, ends).select(*pick)
    assert [df.rdd.getNumPartitions() for df in many] == [15, 16]  # 6,000 rows; an anonymous wallet's would be in the last
    assert tuple(map(rows, many)) == plain


def test_snapshots_meet_markets_and_resolutions_in_one_shuffle_of_the_trades(spark, monkeypatch):
    from oddsmill.plans import views
    from oddsmill.sources import tables
    from oddsmill.streaming.state import settle_pending, wallet_snapshot

    trades, markets, ends = views.trades(spark, SMALLEST), views.markets(spark, SMALLEST), views.resolutions(spark, SMALLEST)
    got = lambda: sorted((x.wallet_address, x.resolved_buys, x.wins, round(x.realized_pnl, 6)) for x in settle_pending(wallet_snapshot(trades, markets, ends, 930_000_000), ends, 960_000_000).collect())
    plain = got()
    monkeypatch.setattr(tables, "ROWS_A_TASK", 300)
    snapshot = wallet_snapshot(trades, markets, ends, 930_000_000).select("wallet_address", "pending")
    assert snapshot.rdd.getNumPartitions() > 10 and got() == plain != []


def test_convergence_by_category_is_one_pass_and_equals_a_pass_for_each_window(spark):
    from oddsmill.functions.categories import TAXONOMY, primary_category
    from oddsmill.operators import detectors

    r = random.Random(8)
    tags = {"a": ["Sports"], "b": ["ESPORTS"], "c": ["Bitcoin"], "d": ["AI"], "e": []}
    trades = spark.createDataFrame([(m, f"t{k:03}", m + ":Y", f"w{r.randrange(6)}", r.randrange(400_000), float(r.randrange(1, 9))) for k, m in enumerate(r.choice("abcde") for _ in range(400))], "condition_id string, tx_hash string, asset_id string, wallet_address string, ts long, notional_usd double")
    market_tags = spark.createDataFrame(list(tags.items()), "condition_id string, tags array<string>")
    skill = [(f"w{w}", c.name, 30, 0.2, 5.0) for w in range(6) for c in TAXONOMY if r.random() < 0.7]
    roster = spark.createDataFrame(skill, "wallet_address string, category string, positions long, mean_edge double, excess_pnl_usd double")
    got = detectors.convergence_by_category(trades, market_tags, roster, newest=12)
    placed, want = trades.join(market_tags.select("condition_id", primary_category(F.col("tags")).alias("category")), "condition_id"), []
    for span in {c.window_s for c in TAXONOMY}:
        names = [c.name for c in TAXONOMY if c.window_s == span]
        want += detectors.convergence(placed.where(F.col("category").isin(names)), roster.where(F.col("category").isin(names)).select("wallet_address", "category"), span, 2, newest=12).collect()
    key = lambda rows: sorted((x.tx_hash, x.wallet_address, x.category, x.n_wallets, x.total_usd, x.severity) for x in rows)
    assert key(got.collect()) == key(want) != []
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_convergence_by_category_adds_the_volume_of_old_trades_too(spark):
    from oddsmill.operators import detectors

    rows = [("m", "t-a", "m:Y", "a", 100, 7.0), ("m", "t-b", "m:Y", "b", 200, 5.0)] + [("own", f"t{k:03}", "own:Y", "a", 10**6 + 10**6 * k, 1.0) for k in range(300)]
    trades = spark.createDataFrame(rows, "condition_id string, tx_hash string, asset_id string, wallet_address string, ts long, notional_usd double")
    tags = spark.createDataFrame([("m", ["Sports"]), ("own", ["Sports"])], "condition_id string, tags array<string>")
    roster = spark.createDataFrame([(w, "sports", 30, 0.2, 5.0) for w in "ab"], "wallet_address string, category string, positions long, mean_edge double, excess_pnl_usd double")
    assert [(x.tx_hash, x.n_wallets, x.total_usd) for x in detectors.convergence_by_category(trades, tags, roster).collect()] == [("t-b", 2, 12.0)]


def test_training_rows_cross_the_network_by_market_and_by_wallet_once(spark):
    from oddsmill.operators import features, model
    from oddsmill.plans import views

    trades, markets, ends = (v(spark, SMALLEST) for v in (views.trades, views.markets, views.resolutions))
    examples = features.build_features(trades, markets, ends)
    got = model.split_in_place(examples, ends)
    want = model.with_split(examples, model.temporal_split(ends))
    count = lambda df: {tuple(x) for x in df.select("tx_hash", "asset_id", "wallet_address", "condition_id", "split").collect()}
    assert count(got) == count(want) and {x[-1] for x in count(got)} == {"train", "validation", "test"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [wallet_address") == 1 and "Union" not in plan  # the anonymous, of whom there are none, ask for no second build
    assert "condition_id" not in next(x for x in plan.splitlines() if "Join" in x)  # splits are told by one row
    some = trades.withColumn("wallet_address", F.when(F.col("ts") % 3 == 0, "").otherwise(F.col("wallet_address")))
    assert "Union" in features.build_features(some, markets, ends)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_computed_once_for_their_auc(spark):
    from oddsmill.operators import model

    rows = [(k % 7 / 7, int(k % 3 == 0)) for k in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def told(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    got = model.auc(spark.createDataFrame(rows, "pred double, label_won int").mapInPandas(told, "pred double, label_won int")).head().auc
    pairs = [(a, b) for a, x in rows for b, y in rows if x and not y]
    assert abs(got - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-12 and seen.value == 60
