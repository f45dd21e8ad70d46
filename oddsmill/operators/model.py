"""Preparation, training and evaluation of the copy-trade classifier on realised edge."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.operators.features import CATEGORIES
from oddsmill.sources.tables import scratch_table

NONE = "__none__"
#: Buckets of a market's lifetime volume and where each ends; what is over all is ``25M+``.
VOLUME_BUCKETS = (("<250K", 250e3), ("250K-1M", 1e6), ("1M-5M", 5e6), ("5M-25M", 25e6))
CATEGORICAL = ("side", "top_category", "market_category")
#: Columns that name or leak: identity, outcome, and what only time tells.
NOT_FEATURES = frozenset("platform tx_hash asset_id wallet_address condition_id built_at label_won resolved_at time_to_resolution_seconds ts split price implied_prob".split())


def temporal_split(resolutions: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """condition_id, split: markets by (resolved_at, id), the first 70 %, the next 15 % and the rest.

    Ranks come from counts of days and a window inside each day, so no window spans all markets.
    """
    return _placed(resolutions, train, validation).select("condition_id", "split")


def _placed(resolutions: DataFrame, train: float, validation: float) -> DataFrame:
    m = resolutions.select("condition_id", "resolved_at", F.floor(F.col("resolved_at") / 86_400).alias("day"))
    days = m.groupBy("day").agg(F.count("*").alias("c"))
    every = Window.orderBy("day")  # a row for each day
    days = days.withColumns({"before": F.sum("c").over(every) - F.col("c"), "n": F.sum("c").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rank = F.row_number().over(Window.partitionBy("day").orderBy("resolved_at", "condition_id")) + F.col("before")
    cut1, cut2 = F.round(F.col("n") * train), F.round(F.col("n") * train) + F.round(F.col("n") * validation)
    return m.join(F.broadcast(days), "day").withColumn("k", rank).select("condition_id", "resolved_at", F.when(F.col("k") <= cut1, "train").when(F.col("k") <= cut2, "validation").otherwise("test").alias("split"))


def with_split(examples: DataFrame, splits: DataFrame) -> DataFrame:
    return examples.join(splits.hint("merge"), "condition_id")  # a row for each market


def split_in_place(examples: DataFrame, resolutions: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``with_split`` of ``temporal_split`` for examples that have resolved_at: splits are told by the last (resolved_at, id) of each, one row, so that
    examples aren't shuffled by market again."""
    at = F.struct("resolved_at", "condition_id")
    ends = _placed(resolutions, train, validation).agg(*[F.max(F.when(F.col("split") == s, at)).alias(f"_{s}") for s in ("train", "validation")])
    split = F.when(at <= F.col("_train"), "train").when(at <= F.col("_validation"), "validation").otherwise("test")
    return examples.crossJoin(F.broadcast(ends)).withColumn("split", split).drop("_train", "_validation")


def split_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split").agg(F.count("*").alias("rows"), F.avg("label_won").alias("label_rate"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if c not in NOT_FEATURES and c not in CATEGORICAL and kind != "string"]


def fit_levels(train: DataFrame, columns: Iterable[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Sorted levels of each column in the training rows, a null as ``__none__``; a few values each."""
    columns = list(columns)
    found = train.agg(*[F.collect_set(F.coalesce(c, F.lit(NONE))).alias(c) for c in columns]).head()
    return {c: sorted(found[c]) for c in columns}


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column for each level; what training never saw is 0 in all."""
    flags = {f"{c}={v}": (F.coalesce(c, F.lit(NONE)) == v).cast("int") for c, values in levels.items() for v in values}
    return df.withColumns(flags).drop(*levels)


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """``features`` vector of the columns, with NaN for what is missing."""
    from pyspark.ml.feature import VectorAssembler

    dense = df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(dense)


def scored(examples: DataFrame) -> DataFrame:
    """Examples with a fixed score in place of a model's, for reports that SQL can check."""
    return examples.withColumn("pred", F.round(F.least(F.lit(0.99), 0.2 + 0.6 * F.col("implied_prob_at_buy") + 0.3 * F.coalesce("win_rate", F.lit(0.0))) + 3e-12, 4))


def _edge(n_min: int) -> list[Column]:
    taken = F.col("pred") > F.col("implied_prob_at_buy")
    n = F.count(F.when(taken, 1))
    return [n.alias("n_taken"), F.when(n >= n_min, F.avg(F.when(taken, F.col("label_won") - F.col("implied_prob_at_buy")))).otherwise(-1.0).alias("edge")]


def _mean_edge() -> list[Column]:
    return [F.count("*").alias("n"), F.avg(F.col("label_won") - F.col("implied_prob_at_buy")).alias("mean_edge")]


def _taken(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred") > F.col("implied_prob_at_buy"))


def realized_edge(df: DataFrame, n_min: int = 20) -> DataFrame:
    """Mean of label less price where the prediction is over the price; -1 for fewer than ``n_min``."""
    return df.agg(*_edge(n_min))


def edge_by_decile(df: DataFrame) -> DataFrame:
    """Taken bets and their mean edge by tenths of the price, 1 in the last; tenths without a taken bet have no row."""
    p = F.col("implied_prob_at_buy")
    decile = sum(((p >= k / 10).cast("int") for k in range(1, 10)), F.lit(0))
    return _taken(df).groupBy(decile.alias("decile")).agg(*_mean_edge())


def edge_by_volume(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Taken bets and their mean edge by the lifetime volume of their market; buckets without a taken bet have no row."""
    v = F.col("total_volume_usd")
    bucket = F.coalesce(*[F.when(v < limit, name) for name, limit in VOLUME_BUCKETS], F.when(v.isNotNull(), "25M+"))
    return _taken(df).join(markets.select("condition_id", "total_volume_usd"), "condition_id").groupBy(bucket.alias("bucket")).agg(*_mean_edge())


def classification(df: DataFrame, accepted: Iterable[str]) -> DataFrame:
    """Accuracy at 0.5, log-loss, and the edge of accepted categories."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("pred")))
    own = F.col("top_category").isin(*accepted) & (F.col("pred") > F.col("implied_prob_at_buy"))
    return df.agg(
        F.avg(((F.col("pred") >= 0.5).cast("int") == F.col("label_won")).cast("double")).alias("accuracy"),
        F.avg(-F.when(F.col("label_won") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
        F.avg(F.when(own, F.col("label_won") - F.col("implied_prob_at_buy"))).alias("filtered_edge"),
    )


def auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney's statistic with averaged ties: counts by distinct score, dealt into ranges of scores. Counts are read twice and written once, as
    their rows may be dear."""
    by = df.groupBy("pred").agg(F.sum("label_won").cast("double").alias("pos"), F.sum(1 - F.col("label_won")).cast("double").alias("neg"), F.floor(F.first("pred") * 1000).alias("part"))
    by = scratch_table(by, "scores")
    parts = by.groupBy("part").agg(F.sum("neg").alias("n"))
    below = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("below"))  # a thousand rows at most
    inside = F.sum("neg").over(Window.partitionBy("part").orderBy("pred")) - F.col("neg")
    wins = by.join(F.broadcast(below), "part").withColumn("wins", F.col("pos") * (F.col("below") + inside + F.col("neg") / 2))
    return wins.agg((F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def edge_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("top_category", F.lit(NONE)).alias("category")).agg(F.count("*").alias("n"), *_edge(1))


def edge_by_flag(df: DataFrame) -> DataFrame:
    """By multi-label category: a row counts in each that its market has."""
    own = F.array_compact(F.array(*[F.when(F.col(f"cat_{c}") == 1, c) for c in CATEGORIES]))
    return df.withColumn("category", F.explode(own)).groupBy("category").agg(F.count("*").alias("n"), *_edge(1))


@dataclass
class Trained:
    """A fitted classifier with what is needed to score new rows, and its figures by split."""

    model: object
    columns: list[str]
    levels: dict[str, list[str]]
    params: dict
    trees: int
    metrics: DataFrame
    search: Search | None = None

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pred``, the model's probability that the bet wins; the encoded columns stay, the encoded text columns don't."""
        return score(self.model, prepared(rows, self.levels, self.columns))

    def save(self, path: str) -> None:
        """The model below ``path``/model, and columns, levels and parameters as one JSON text below ``path``/meta."""
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"columns": self.columns, "levels": self.levels, "params": self.params, "trees": self.trees}
        self.metrics.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def prepared(rows: DataFrame, levels: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Rows with ``features``: one-hot levels and numbers; missing ones are -1e9, below every value, as Spark's trees have no branch
    for them."""
    flags = one_hot(rows, levels)
    return assemble(flags.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(-1e9)) for c in columns}), columns)


def _boosted(train: DataFrame, params: dict, seed: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="label_won", featuresCol="features", seed=seed, **params).fit(train)


def edge_by_trees(model, df: DataFrame, n_min: int) -> list[float]:
    """Realised edge of the model's first 1, 2, ... trees on ``df``, in one pass: each row gives the running sums of its votes, and
    a sum for each number of trees combines before the shuffle."""
    votes = F.array(*[F.lit(w) * _vote(t) for t, w in zip(model.trees, model.treeWeights, strict=True)])
    margins = F.aggregate(votes, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    rows = df.select("label_won", "implied_prob_at_buy", F.posexplode(margins).alias("k", "margin"))
    won = F.when(1 / (1 + F.exp(-2 * F.col("margin"))) > F.col("implied_prob_at_buy"), F.col("label_won") - F.col("implied_prob_at_buy"))
    found = {r["k"]: r["edge"] for r in rows.groupBy("k").agg(F.when(F.count(won) >= n_min, F.avg(won)).otherwise(-1.0).alias("edge")).collect()}  # a row for each tree
    return [found.get(k, -1.0) for k in range(len(model.trees))]


def _vote(tree) -> Column:
    """A regression tree as nested conditions on the vector of features."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(x[split.featureIndex()] <= float(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))


def exported(trained: Trained) -> dict:
    """The model as plain values: names of its features, levels of the encoded columns, weights of the trees, and each tree as nested
    (feature, threshold, below or at it, above it) down to leaves."""

    def walk(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return [trained.columns[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())]

    return {"levels": trained.levels, "weights": [float(w) for w in trained.model.treeWeights], "trees": [walk(t._call_java("rootNode")) for t in trained.model.trees]}


def exported_margin(model: dict) -> Column:
    """The sum of the trees' votes over plain columns: a level is a comparison, a missing number is below every threshold."""

    def value(name: str) -> Column:
        column, _, level = name.partition("=")
        if level and column in model["levels"]:
            return (F.coalesce(column, F.lit(NONE)) == level).cast("double")
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(-1e9))

    def walk(node) -> Column:
        return F.lit(node) if isinstance(node, float) else F.when(value(node[0]) <= node[1], walk(node[2])).otherwise(walk(node[3]))

    return sum((F.lit(w) * walk(t) for w, t in zip(model["weights"], model["trees"], strict=True)), F.lit(0.0))


def exported_sql(model: dict) -> str:
    """``exported_margin`` as an SQL expression."""

    def value(name: str) -> str:
        column, _, level = name.partition("=")
        if level and column in model["levels"]:
            return f"(case when coalesce({column}, '{NONE}') = '{level}' then 1 else 0 end)"
        return f"coalesce({name}, -1e9)"

    def walk(node) -> str:
        return repr(node) if isinstance(node, float) else f"case when {value(node[0])} <= {node[1]!r} then {walk(node[2])} else {walk(node[3])} end"

    return "(" + " + ".join(f"cast({w!r} as double) * ({walk(t)})" for w, t in zip(model["weights"], model["trees"], strict=True)) + ")"


def scored_by(model: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with ``pred`` of an exported model, without its library: the probability that the bet wins."""
    return rows.withColumn("pred", 1 / (1 + F.exp(-2 * exported_margin(model))))


def with_outcome_side(trades: DataFrame, cache: DataFrame) -> DataFrame:
    """Trades with the side (YES, NO) of their asset by the arrays of their market (condition_id, asset_ids, outcomes), which may differ in
    length; trades of markets that aren't cached, of other assets and of outcomes that are neither have no side and go."""
    names = cache.select("condition_id", F.transform("asset_ids", lambda a, i: F.struct(a.alias("asset"), F.upper(F.trim(F.try_element_at("outcomes", i + 1))).alias("side"))).alias("_sides"))
    own = F.try_element_at(F.filter("_sides", lambda x: x["asset"] == F.col("asset_id")), F.lit(1))["side"]
    return trades.drop("outcome_side").join(names, "condition_id").withColumn("outcome_side", own).where("outcome_side in ('YES', 'NO')").drop("_sides")


@dataclass
class Search:
    """What a search chose, and how much it and its whole grid fit: trees times the share of the training markets that they see."""

    params: dict
    trees: int
    edge: float
    fitted: float
    grid: float


def successive_halving(train: DataFrame, validation: DataFrame, grid: dict[str, list], n_min: int = 20, seed: int = 7, keep: int = 3, parallel: int = 4) -> Search:
    """The parameters and number of trees that earn most edge on ``validation``, by fits on growing shares of the training markets.

    All candidates of the grid are fitted on the smallest share, the best ``1/keep`` of them on ``keep`` times as many markets, and so on to
    all markets; shares are nested, by a hash of the market (condition_id). Fits of one round run side by side in scheduler pools.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    context = train.sparkSession.sparkContext
    candidates = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    whole, rounds, left = float(sum(p.get("maxIter", 20) for p in candidates)), 0, len(candidates)
    while left > 1:
        rounds, left = rounds + 1, -(-left // keep)
    slot = F.pmod(F.xxhash64("condition_id"), F.lit(keep**rounds))
    fitted, best = 0.0, []
    for k in range(rounds + 1):
        share = keep ** (k - rounds)
        part = train.where(slot < keep**k).persist() if k < rounds else train  # the last round has all of it, which is held already

        def fit(job, part=part):
            number, params = job
            context.setLocalProperty("spark.scheduler.pool", f"search-{number}")
            edges = edge_by_trees(_boosted(part, params, seed), validation, n_min)
            top = max(range(len(edges)), key=lambda i: (edges[i], -i))
            return edges[top], -number, params, top + 1

        with ThreadPoolExecutor(parallel) as pool:
            best = sorted(pool.map(inheritable_thread_target(train.sparkSession)(fit), enumerate(candidates)), key=lambda x: (x[0], x[1]), reverse=True)
        fitted += share * sum(p.get("maxIter", 20) for p in candidates)
        if k < rounds:
            part.unpersist()
        candidates = [x[2] for x in best[: -(-len(best) // keep)]]
    edge, _, params, trees = best[0]
    return Search(params, trees, edge, fitted, whole)


def train_and_test(rows: DataFrame, grid: dict[str, list], n_min: int = 20, seed: int = 7) -> Trained:
    """Chooses, among the grid by successive halving, the parameters and the number of boosting rounds (early stop) that earn most
    edge on validation rows; fits those on training rows again and tests them once. ``rows`` has split (train, validation, test)."""
    levels = fit_levels(rows.where("split = 'train'"))
    columns = [*feature_columns(rows), *[f"{c}={v}" for c, values in levels.items() for v in values]]
    ready = prepared(rows, levels, columns).select("condition_id", "split", "label_won", "implied_prob_at_buy", "features")
    part = {k: ready.where(F.col("split") == k).persist() for k in ("train", "validation")}
    found = successive_halving(part["train"], part["validation"], grid, n_min, seed)
    params, trees = found.params, found.trees
    fitted = _boosted(part["train"], {**params, "maxIter": trees}, seed)
    for df in part.values():
        df.unpersist()
    return Trained(fitted, columns, levels, params, trees, metrics(score(fitted, ready), n_min), found)


def metrics(scored_: DataFrame, n_min: int) -> DataFrame:
    """Edge, accuracy and log loss of scored rows by split."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("pred")))
    return scored_.groupBy("split").agg(
        F.count("*").alias("rows"), *_edge(n_min), F.avg(((F.col("pred") >= 0.5).cast("int") == F.col("label_won")).cast("double")).alias("accuracy"), F.avg(-F.when(F.col("label_won") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss")
    )


def score(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("pred", vector_to_array("probability")[1])


def importances(model, columns: list[str], spark) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
