"""Order books kept by a stream of messages, and their ticks.

The state of an asset is its live levels (a map from side and price to size, from which a level of size 0 is removed), its last trade
price and the last message; messages of an interval wait until the watermark has passed its end, whose timer applies them in the order of
their number and gives the tick. State is bounded by the levels that are live and the messages of intervals that are open.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.streaming.fold import ROCKSDB, InOrder, _ddl


class BookFold(InOrder):
    columns = {"asset_id": "string", "seq": "long", "ts": "long", "event_type": "string", "side": "string", "price": "double", "size": "double"}
    result = {
        "event_time": "timestamp", "asset_id": "string", "ts": "long", "last_trade_price": "double", "best_bid": "double", "bid_depth_top5": "double", "best_ask": "double", "ask_depth_top5": "double", "stale": "int",
    }

    def __init__(self, interval: int, depth: int):
        self.interval, self.depth = interval, depth

    def open(self, handle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.last = handle.getValueState("last", "seq long, kind string, price double, stale int")

    def second(self, row) -> int:
        return (row["ts"] // self.interval + 1) * self.interval

    def sort_key(self, row):
        return (row["seq"],)

    def load(self) -> None:
        self.book = {(side, price): size for (side, price), (size,) in self.levels.iterator()}
        self.stored = dict(self.book)
        self.seq, self.kind, self.price, self.stale = self.last.get() if self.last.exists() else (None, None, None, 1)

    def save(self) -> None:
        for key in self.stored.keys() - self.book.keys():
            self.levels.removeKey(key)
        for key, size in self.book.items():
            if self.stored.get(key) != size:
                self.levels.updateValue(key, (size,))
        self.last.update((self.seq, self.kind, self.price, self.stale))

    def fold(self, row) -> list[dict]:
        if row["event_type"] == "book":
            if self.seq != row["seq"] or self.kind != "book":  # its first row: the book is new, and in step again
                self.book, self.stale = {}, 0
        elif self.seq is not None and row["seq"] > self.seq + 1:
            self.stale = 1  # messages are missing until the next snapshot
        if row["event_type"] == "last_trade_price":
            self.price = row["price"]
        elif row["event_type"] in ("book", "price_change"):
            if row["size"] and row["size"] > 0:
                self.book[row["side"], row["price"]] = row["size"]
            else:
                self.book.pop((row["side"], row["price"]), None)
        self.seq, self.kind = row["seq"], row["event_type"]
        return []

    def ended(self, key, at: int) -> list[dict]:
        tick = {"asset_id": key[0], "ts": at, "last_trade_price": self.price, "stale": self.stale}
        for side, first in (("bid", heapq.nlargest), ("ask", heapq.nsmallest)):
            best = first(self.depth, ((p, size) for (s, p), size in self.book.items() if s == side))
            tick |= {f"best_{side}": best[0][0] if best else None, f"{side}_depth_top5": sum(size for _, size in best) if best else None}
        return [tick]


def stream_book_ticks(messages: DataFrame, interval: int = 60, depth: int = 5, delay: str = "0 seconds") -> DataFrame:
    """Ticks of a stream of order-book messages, as ``ingest.book_ticks`` finds them in a table, at the end of each interval with messages.

    ``stale`` is 1 from a gap in the numbers of an asset's messages (or from its start) to its next snapshot. Messages that come after the
    watermark (``delay`` behind the newest message) has passed their time are dropped; rows without an asset, number or time belong to no book.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = messages.where("asset_id is not null and seq is not null and ts is not null").withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    shaped = own.select("event_time", *[F.col(c).cast(kind).alias(c) for c, kind in BookFold.columns.items()])
    ticks = shaped.groupBy("asset_id").transformWithState(BookFold(interval, depth), _ddl(BookFold.result), "Append", "EventTime", eventTimeColumnName="event_time")
    out = ticks.withColumnsRenamed({"ts": "snapshot_at"}).withColumn("stale", F.col("stale") == 1)
    return out.withColumns({"mid_price": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid")}).drop("event_time")
