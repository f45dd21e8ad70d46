"""Detectors over streams: moves and bursts of members with bounded state, whales by joins with static tables, new alerts once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.operators import detectors

_MOVES = "asset_id string, snapshot_at long, mid_price double, start_price double, n_ticks int, change double, consolidated boolean, liquid boolean"
_TICKS = "at array<long>, mid array<double>, spread array<double>"


def stream_velocity(ticks: DataFrame, window_s: int = 60, history: int = 32, threshold: float = 0.05, max_spread_ratio: float = 5.0) -> DataFrame:
    """Moves of a stream of ticks, as ``detectors.velocity`` finds them in a table.

    The state of an asset is its last ``history`` ticks with a mid. Ticks of a micro-batch are taken in the order of time; one that is
    older than the state's last is late and left out. Rows without an asset or time belong to no state.
    """

    def each(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, mid, spread = ([*x] for x in state.get) if state.exists else ([], [], [])
        new = pd.concat(list(frames)).dropna(subset=["mid_price", "snapshot_at"]).sort_values("snapshot_at", kind="stable")
        out = []
        for t in new.itertuples(index=False):
            if at and t.snapshot_at < at[-1]:
                continue
            at, mid, spread = [*at, int(t.snapshot_at)][-history:], [*mid, float(t.mid_price)][-history:], [*spread, None if pd.isna(t.spread) else float(t.spread)][-history:]
            first = next(k for k, x in enumerate(at) if x > t.snapshot_at - window_s)
            if len(at) - first >= 2 and mid[first] > 0 and abs(mid[-1] - mid[first]) / mid[first] >= threshold:
                a, b = spread[first], spread[-1]
                out.append((key[0], at[-1], mid[-1], mid[first], len(at) - first, (mid[-1] - mid[first]) / mid[first], bool(a and b and a > 0 and b > 0 and a / b > max_spread_ratio), bool(t.liquid)))
        state.update((at, mid, spread))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _MOVES.split(", ")])

    own = ticks.where("asset_id is not null").select("asset_id", "snapshot_at", "mid_price", "spread", detectors.liquidity_gate().alias("liquid"))
    return own.groupBy("asset_id").applyInPandasWithState(each, _MOVES, _TICKS, "append", "NoTimeout")


_ACTIVE = "component string, condition_id string, tx_hash string, wallet_address string, ts long, n_active long, severity string"


def stream_cluster_active(trades: DataFrame, members: DataFrame, window_s: int = 300) -> DataFrame:
    """Trades of cluster members soon after another member's in the same market, as ``detectors.cluster_active`` finds them.

    ``members`` (wallet_address, component) is a table. The state of a cluster and market is what its members traded within
    ``window_s`` of the last trade.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("member_count"))
    own = trades.join(members.join(sizes, "component"), "wallet_address").select(F.col("component").cast("string").alias("component"), "condition_id", "tx_hash", "wallet_address", "ts", "member_count")

    def each(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, who = ([*x] for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("ts", kind="stable")
        at, who = [*at, *new["ts"].tolist()], [*who, *new["wallet_address"].tolist()]
        out = []
        for t in new.itertuples(index=False):  # trades of the same second see each other
            n = len({w for x, w in zip(at, who, strict=True) if t.ts - window_s <= x <= t.ts})
            if n >= 2:
                out.append((key[0], key[1], t.tx_hash, t.wallet_address, int(t.ts), n, "high" if 2 * n >= t.member_count else "med"))
        keep = [k for k, x in enumerate(at) if x >= max(at) - window_s]
        state.update(([int(at[k]) for k in keep], [who[k] for k in keep]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ACTIVE.split(", ")])

    return own.groupBy("component", "condition_id").applyInPandasWithState(each, _ACTIVE, "at array<long>, who array<string>", "append", "NoTimeout")


def stream_whales(trades: DataFrame, cache: DataFrame, first_seen: DataFrame, **how) -> DataFrame:
    """Whale trades of a stream, by joins with the tables of markets and of wallets' first activity."""
    return detectors.whale_alerts(trades, cache, first_seen, **how)


def stream_gate(features: DataFrame, score, accepted: list[str], min_pred: float = 0.5, min_edge: float = 0.05) -> DataFrame:
    """Gate alerts of a stream of feature rows; ``score`` adds ``pred``, such as a fitted model's."""
    return detectors.gate_alerts(score(features), accepted, min_pred, min_edge)
