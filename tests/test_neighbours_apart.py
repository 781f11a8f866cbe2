import random
import threading

from pyspark.sql import functions as F

from tallyspark.operators import sampling
from tallyspark.plans import catalog


def test_each_of_many_places_has_all_its_neighbours_in_every_run(spark):
    """Cuts of slices are approximate and differ from run to run on a cluster: they must not be reckoned again by each part of the plan."""
    n, k = 60_000, 5
    points = spark.range(0, n, 1, 8).select(F.lit("a").alias("key"), F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.array((F.col("id") * 7919 % n).cast("double") * 1.37).alias("x"))
    near = sampling.nearest(points, ["key"], k)
    assert "percentile_approx" not in near._jdf.queryExecution().optimizedPlan().toString()
    clock = threading.Timer(200, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        rows = near.select(F.col("x")[0].alias("v"), F.transform("near", lambda o: o["x"][0]).alias("near")).collect()
    finally:
        clock.cancel()
    assert sorted(round(r["v"] / 1.37) for r in rows) == list(range(n))
    for r in rows:
        at = round(r["v"] / 1.37)
        got = sorted(abs(round(v / 1.37) - at) for v in r["near"] if v != r["v"])[:k]
        assert got == sorted(abs(i - at) for i in range(max(0, at - k), min(n, at + k + 1)) if i != at)[:k]


def test_features_take_few_stages(spark):
    """A small table repeated is short work for each stage, so that their number decides; 36 before."""
    sc = spark.sparkContext
    sc.setJobGroup("smote_features", "stages")
    try:
        catalog.QUERIES["smote_features"](spark, "/root/testdata/sf0.01").collect()
    finally:
        sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    ran = [s for j in tracker.getJobIdsForGroup("smote_features") for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    print("stages", len(ran))
    assert len(ran) <= 26


def test_neighbours_among_more_features_than_are_written_out(spark):
    rng, k, dims = random.Random(2), 4, sampling.FEW + 4
    rows = [(key, f"{key}{i:03d}", [float(rng.randrange(3)) for _ in range(dims - 1)] + [rng.gauss(0, 20)]) for key in "ab" for i in range(120)]
    got = sampling.nearest(spark.createDataFrame(rows, "key string, id string, x array<double>"), ["key"], k, block=8).collect()
    near = {(r["key"], r["id"]): [o["id"] for o in r["near"]] for r in got}
    for key, own, x in rows:
        d = sorted((sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)), i) for other, i, y in rows if other == key and i != own)
        assert near[key, own] == [i for _, i in d[:k]]
