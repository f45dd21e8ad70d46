"""A polled feed as a streaming source.

``spark.dataSource.register(MarketFeed)`` and ``spark.readStream.format("market_feed").option("client", "module:factory")``: the factory is
called with the options and returns a client with ``markets()`` and ``newest(market, offset, limit)``, rows of a market as dicts with
``id`` and ``ts``, newest first, as web feeds give them.

A stream's offset is a high-water mark for each market, the newest time and the ids of that second. A batch has a partition for each market whose
mark has moved; its task pages back from the newest row until ``stop`` rows in a row are behind the old mark, and gives what
lies between the two marks. So a batch that is read again, after a failure or a restart, has the same rows, and the next one goes on behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "market string, id string, ts long, raw string"


class MarketPart(InputPartition):
    def __init__(self, market: str, since: dict | None, until: dict):
        self.market, self.since, self.until = market, since, until


def _behind(row: dict, mark: dict | None) -> bool:
    """Whether a row is at ``mark`` or behind it."""
    return mark is not None and (row["ts"] < mark["ts"] or row["ts"] == mark["ts"] and str(row["id"]) in mark["ids"])


class MarketFeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self.page, self.stop = int(self.options.get("page", 100)), int(self.options.get("stop", 20))

    def client(self):
        module, factory = self.options["client"].split(":")
        return getattr(import_module(module), factory)(self.options)

    def pages(self, market: str) -> Iterator[dict]:
        """Rows of a market, newest first, each once though rows that come meanwhile shift the pages."""
        client, at, last = self.client(), 0, set()
        while rows := client.newest(market, at, self.page):
            yield from (r for r in rows if str(r["id"]) not in last)
            last, at = {str(r["id"]) for r in rows}, at + len(rows)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        marks = {}
        for market in self.client().markets():  # the newest second of each
            ids, ts = [], None
            for row in self.pages(market):
                if ts is not None and row["ts"] < ts:
                    break
                ts = row["ts"]
                ids.append(str(row["id"]))
            if ids:
                marks[market] = {"ts": ts, "ids": sorted(ids)}
        return marks

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [MarketPart(m, start.get(m), mark) for m, mark in end.items() if start.get(m) != mark]

    def read(self, partition: MarketPart) -> Iterator[tuple]:
        known = 0
        for row in self.pages(partition.market):
            if _behind(row, partition.since):
                known += 1
                if known >= self.stop:
                    return
            else:
                known = 0
                if _behind(row, partition.until):
                    yield partition.market, str(row["id"]), row["ts"], json.dumps(row)


class MarketFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MarketFeedReader:
        return MarketFeedReader(self.options)
