"""Atomic swaps, pages and polled feeds."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from oddsmill.sources import versioned
from oddsmill.sources.poll import MarketFeed

ROWS = "platform string, id long, note string"


def told(df):
    return sorted(map(tuple, df.select("platform", "id", "note").collect()))


def test_readers_see_the_table_before_or_after_a_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(p, k, "old") for p in ("a", "b") for k in range(50)]
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    assert versioned.swap(spark.createDataFrame(old, ROWS), path) == 1
    before = versioned.read(spark, path)  # a reader that has begun
    staged = versioned.stage(spark.createDataFrame([("a", k, "new") for k in range(9)], ROWS), path)
    assert told(versioned.read(spark, path)) == sorted(old)  # between write and switch
    assert versioned.switch(spark, path, staged) == 2
    new = sorted([("a", k, "new") for k in range(9)] + [x for x in old if x[0] == "b"])
    assert told(versioned.read(spark, path)) == new and told(before) == sorted(old) == told(versioned.read(spark, path, 1))
    scan = versioned.read(spark, path).where("platform = 'b'")
    assert {f.split("platform=")[1][0] for f in scan.inputFiles()} >= {"b"} and "platform=a" not in scan._jdf.queryExecution().optimizedPlan().toString() and scan.count() == 50


def test_a_writer_that_comes_second_keeps_what_the_first_wrote(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versioned.swap(spark.createDataFrame([("a", 1, "x")], ROWS), path)
    one, two = (versioned.stage(spark.createDataFrame([(p, 2, "y")], ROWS), path) for p in "bc")
    real, calls = versioned.versions, []

    def stale(s, p):  # the second writer looks before the first one switches
        found = real(s, p)
        if not calls:
            calls.append(versioned.manifest(s, p, found[-1]))
            versioned.switch(s, p, one)
        return found

    monkeypatch.setattr(versioned, "versions", stale)
    assert versioned.switch(spark, path, two) == 3
    monkeypatch.undo()
    assert told(versioned.read(spark, path)) == [("a", 1, "x"), ("b", 2, "y"), ("c", 2, "y")]
    versioned.swap(spark.createDataFrame([("a", 3, "z")], ROWS), path)
    assert len(versioned.expire(spark, path, keep=1)) == 1 and told(versioned.read(spark, path))[0] == ("a", 3, "z") and versioned.versions(spark, path) == [4]


def test_pages_read_only_the_files_they_need(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(500), f"t{r.randrange(40)}", f"a{r.randrange(3)}", f"w{k}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "ts long, tx_hash string, asset_id string, wallet_address string, n long")
    versioned.write_paged(df.repartition(3), str(tmp_path / "p"), 12)
    want, after, got = sorted(rows), None, []
    while True:
        page = versioned.page(spark, str(tmp_path / "p"), after, 400)
        part = [tuple(x) for x in page.collect()]
        if not part:
            break
        assert len(page.inputFiles()) <= 4
        got, after = got + part, part[-1][:4]
    assert got == want


def feed(path, market, rows):
    with (path / f"{market}.jsonl").open("a") as f:
        f.writelines(json.dumps({"id": i, "ts": ts, "price": 0.5}) + "\n" for i, ts in rows)


def test_a_polled_feed_resumes_after_failures_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(MarketFeed)
    folder = tmp_path / "feed"
    folder.mkdir()
    want = set()

    def grow(market, first, n, ts):
        rows = [(first + k, ts + k // 3) for k in range(n)]
        feed(folder, market, rows)
        want.update((market, str(i)) for i, _ in rows)

    def start(**sink):
        stream = spark.readStream.format("market_feed").options(client="tests.feed_client:Folder", folder=str(folder), page="7", stop="5").load()
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        return (writer.foreachBatch(sink["each"]) if sink else writer.format("parquet").option("path", str(tmp_path / "out"))).start()

    def got():
        rows = [(x.market, x.id) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    grow("m1", 0, 40, 100)
    grow("m2", 0, 3, 100)
    start().awaitTermination()
    assert got() == want
    grow("m1", 40, 25, 113)  # the second of the mark has more rows
    grow("m3", 0, 11, 5)

    def broken(batch, number):
        batch.count()
        raise RuntimeError("the executor is gone")

    with pytest.raises(StreamingQueryException):
        start(each=broken).awaitTermination()
    grow("m2", 3, 30, 101)  # after the batch that failed was planned
    start().awaitTermination()
    start().awaitTermination()
    assert got() == want
