"""Sessions that name no checkpoint folder: scratch tables go below the warehouse and are gone when the driver ends."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
for name in sys.argv[2:]:
    print("ROWS", name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
import glob
print("SCRATCH", len(glob.glob(sys.argv[1] + "/oddsmill-*/*")) > 0, flush=True)
spark.stop()
"""


def run_without_checkpoint_folder(warehouse, *names):
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    env["SPARK_CONF_DIR"] = str(warehouse)  # no defaults there
    out = subprocess.run([sys.executable, "-c", PROGRAM, str(warehouse), *names], cwd=warehouse, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return [x.split()[1:] for x in out.stdout.splitlines() if x.startswith(("ROWS", "SCRATCH"))]


def test_queries_run_without_a_checkpoint_folder(tmp_path):
    *rows, scratch = run_without_checkpoint_folder(tmp_path, "ledger_summary", "wallet_components")
    assert [x[0] for x in rows] == ["ledger_summary", "wallet_components"] and all(int(x[1]) > 0 for x in rows)
    assert scratch == ["True"] and not list(tmp_path.glob("oddsmill-*"))


def test_shared_builds_follow_the_data(spark, tmp_path):
    from oddsmill.sources.tables import built_once

    path = str(tmp_path / "t.parquet")
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert [built_once(spark, "numbers", [path], build).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert built_once(spark, "numbers", [path], build).count() == 8 and len(calls) == 2


def test_a_warehouse_on_the_own_disk_is_no_shared_folder():
    import pytest

    from oddsmill.sources.tables import scratch_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "file:/home/x/warehouse"}.get(key, default))

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch_dir(Session)
