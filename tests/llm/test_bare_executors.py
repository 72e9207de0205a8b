"""Vector operators run where executors don't have this package: the driver alone gets its folder, from elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
sys.path.insert(0, sys.argv[1])  # after the workers' path was settled
from hanmaru.llm import codebooks, negatives, packing, topk
missing = spark.range(2).mapInPandas(lambda frames: (f.assign(id=[__import__("importlib.util").util.find_spec("hanmaru") is None] * len(f)) for f in frames), "id boolean")
assert all(r.id for r in missing.collect())
for module in (topk, codebooks, negatives, packing):
    assert module.query(spark, sys.argv[2]).count() > 0, module
print("fine")
"""


def test_queries_run_without_the_package_on_workers(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(REPO), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400, check=False)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]
