import random
import threading

import pytest

from tallyspark.operators import sampling

POINT = "key string, id string, x array<double>"


@pytest.mark.parametrize("values", ["copies", "grid", "apart", "alike", "infinite"])
def test_neighbours_are_those_of_brute_force(spark, values):
    rng = random.Random(values)
    draw = {
        "copies": lambda i: [float(i % 7), 0.5], "grid": lambda i: [float(rng.randrange(9)), float(rng.randrange(5)), 0.0],
        "apart": lambda i: [rng.gauss(0, 1), rng.gauss(0, 9)], "alike": lambda i: [0.0], "infinite": lambda i: [rng.choice([1.0, 2.0, float("inf")]), rng.gauss(0, 1)],
    }[values]
    rows = [(key, f"{key}{rng.randrange(10**6)}_{i}", draw(i)) for key, n in (("a", 150), ("b", 40), ("c", 3), ("d", 1)) for i in range(n)]
    k = 4
    got = sampling.nearest(spark.createDataFrame(rows, POINT), ["key"], k, block=8).collect()
    assert len(got) == len({(key, *x) for key, _, x in rows})
    near = {(r["key"], *r["x"]): [n["id"] for n in r["near"]] for r in got}
    for key, own, x in rows:
        d = {i: sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)) for other, i, y in rows if other == key and i != own}
        want = sorted(d, key=lambda i: (d[i] != d[i], d[i], i))[:k]  # NaN comes last
        assert [i for i in near[key, *x] if i != own][:k] == want


def test_many_positives_at_few_places_take_no_square_of_them(spark):
    n = 24_000
    df = spark.range(n).selectExpr("concat('C01_', id) as masked_consumer_id", "1.0D as FPF_TARGET", "cast(id % 30 as double) as f")
    clock = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        made = sampling.augment_clients(df, ["f"], 2.0, 5, 1).where("masked_consumer_id like '%#%'")
        assert made.selectExpr("count(*)", "min(f)", "max(f)", "count_if(f != floor(f))").collect()[0] == (n, 0.0, 29.0, 0)
    finally:
        clock.cancel()
