import os
import subprocess
import sys

import numpy as np
import pytest

from tallyspark.llm import topk

#: Tells the peak of the Python workers, which wait below the JVM for more work.
PEAK = """
import os
import re

import numpy as np
from pyspark.sql import SparkSession

from tallyspark.llm import topk

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
v = np.random.default_rng(3).integers(-99, 99, (8000, 4))
df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
n = topk.top_k(df, df.where("id % 2 = 0"), 5).count()
told = {}
for pid in filter(str.isdigit, os.listdir("/proc")):
    try:
        told[int(pid)] = dict(re.findall(r"(Name|PPid|VmHWM):\\s+(\\w+)", open(f"/proc/{pid}/status").read()))
    except OSError:
        pass
below = {os.getpid()}
for _ in range(9):
    below |= {pid for pid, x in told.items() if int(x["PPid"]) in below}
peaks = [int(told[pid]["VmHWM"]) // 1024 for pid in below - {os.getpid()} if "VmHWM" in told[pid] and "java" not in told[pid]["Name"]]
print("found", n, "peak", max(peaks))
"""


def test_a_workers_memory_does_not_grow_with_the_queries():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": top, "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", PEAK], env=env, capture_output=True, text=True, timeout=300)
    found = out.stdout.split()
    assert found[:2] == ["found", "20000"], out.stderr[-2000:]
    assert int(found[3]) < 500  # MB; 8,000 by 4,000 scores of 64 bits alone are 256


@pytest.mark.parametrize("scale", [1, 2**12, 2**26])
def test_scores_of_each_kind_of_number_in_small_parts(spark, scale, monkeypatch):
    for name, value in {"BLOCK": 32, "SCORES": 100, "QUERY_BYTES": 200}.items():
        monkeypatch.setattr(topk, name, value)
    v = np.random.default_rng(scale).integers(-9, 9, (150, 5)) * scale
    v[20:60] = v[0]
    assert topk.kind(v, v) == {1: np.float32, 2**12: np.float64, 2**26: np.int64}[scale]
    rows = [(i % 140, x.tolist()) for i, x in enumerate(v)]  # ids 0 to 9 twice
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("id % 7 = 0"), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q in range(0, 140, 7):
        asked = min(x for i, x in rows if i == q)
        want = sorted(((i, int(np.dot(x, asked))) for i, x in rows if i != q), key=lambda c: (-c[1], c[0]))[:6]
        assert got[q] == want
