"""The package reaches Python workers when the driver was started in another folder without PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
sys.path.remove({str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master(sys.argv[2]).config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("ROWS", entry.queries()["exponential_smoothing"](spark, "/root/testdata/sf0.001").count())
"""
# A cluster of its own processes is started on request only: not every machine lets one run.
MASTERS = ["local[2]", *(["local-cluster[1,2,2000]"] if os.environ.get("PANELSPARK_CLUSTER") else [])]


@pytest.mark.parametrize("master", MASTERS)
def test_workers_import_the_package(tmp_path, master):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["SPARK_SCALA_VERSION"] = "2.13"
    (tmp_path / "shared").mkdir()
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), master], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.rpartition("ROWS")[2]) > 0
