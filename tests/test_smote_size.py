import threading

import pyarrow as pa
import pyarrow.parquet as pq

from tallyspark.plans import catalog

SF, TIMES = "/root/testdata/sf0.1", 16


def test_features_of_repeated_customers_end(spark, tmp_path):
    one = pq.read_table(f"{SF}/customer.parquet")
    at = one.schema.get_field_index("c_custkey")
    keys = [one["c_custkey"].to_numpy() + 15_000 * i for i in range(TIMES)]
    parts = [one.set_column(at, one.schema.field(at), pa.array(k, one.schema.field(at).type)) for k in keys]
    pq.write_table(pa.concat_tables(parts), tmp_path / "customer.parquet")
    for name in ("orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    clock = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        got = {(r["client"], r["label"], r["synthetic"]): r["n"] for r in catalog.QUERIES["smote_features"](spark, str(tmp_path)).collect()}
    finally:
        clock.cancel()
    positives = [0, 0, 0]
    for k in (int(x) for part in keys for x in part):
        positives[k % 3] += k % 17 != 0 and k * 7919 % 10 < 3
    for c, n in enumerate(positives):
        assert got[f"C0{c + 1}", 1.0, False] == got[f"C0{c + 1}", 1.0, True] == n
