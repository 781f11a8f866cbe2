import math

import pytest

from tallyspark.operators import sampling
from tallyspark.plans import catalog

SF = "/root/testdata/sf0.01"


def test_every_client_is_augmented_and_the_sums_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("customer", "lineitem", "orders"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["smote_features"](spark, SF).collect())
    want = sorted(con.execute(catalog.SQL["smote_features"]).fetchall())
    assert [r[:4] for r in got] == [r[:4] for r in want] and {r[0] for r in got if r[2]} == {"C01", "C02", "C03"}
    assert all(math.isclose(a, b, rel_tol=1e-9) for x, y in zip(got, want, strict=True) for a, b in zip(x[4:], y[4:], strict=True))


def test_clients_keep_to_themselves(spark):
    rows = [(f"C0{c}_{i}", 1.0, 100.0 * c + i) for c in (1, 2) for i in range(4)] + [("C03_0", 1.0, 9.0), ("C03_1", 0.0, None)]
    df = spark.createDataFrame(rows, "masked_consumer_id string, FPF_TARGET double, f double")
    made = [r for r in sampling.augment_clients(df, ["f"], 2.0, 5, 1).collect() if "#" in r["masked_consumer_id"]]
    assert len(made) == 8 and all(0 <= r["f"] - 100 * int(r["masked_consumer_id"][2]) <= 3 for r in made)
    assert sampling.augment_clients(df.where("1 = 0"), ["f"], 2.0, 5, 1).count() == 0
