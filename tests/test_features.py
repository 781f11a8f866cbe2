import datetime as dt
import math

import pytest

from tallyspark.operators import features as fx
from tallyspark.operators.feature_sets import FEATURE_SETS, resolve_feature_names
from tallyspark.sources import ledger

D = dt.datetime(2024, 6, 30)
CONS = "masked_consumer_id string, evaluation_date timestamp_ntz, total_balance double, FPF_TARGET double"
TX = "masked_consumer_id string, masked_transaction_id string, posted_date timestamp_ntz, amount double, category int"
CATS = (3, 12, 23, 26, 10, 16)


def ledger_rows():
    cons = [("C01_a", D, 200.0, 0.0), ("C01_b", D, -50.0, 1.0), ("C02_c", D, 0.0, None)]
    tx = []
    for who in ("C01_a", "C01_b"):
        for i, days in enumerate((0, 1, 6, 7, 8, 29, 30, 31, 60, 90, 91, 120, 150, 180)):
            amount = (100.0 + 10 * i) * (-1 if i % 3 == 0 else 1)
            tx.append((who, f"{who}{i}", D - dt.timedelta(days=days), amount, CATS[i % 6]))
    return cons, tx


def frame(spark, cons, tx, names, **more):
    out = fx.build_feature_frame(spark.createDataFrame(cons, CONS), spark.createDataFrame(tx, TX), [], names, **more)
    return {r["masked_consumer_id"]: r for r in out.collect()}


def test_windows_include_their_last_day(spark):
    cons, tx = ledger_rows()
    got = frame(spark, cons, tx, ["txn_count_7d", "txn_count_30d", "txn_count_90d", "inflow_sum_7d", "inflow_sum_30d", "outflow_to_balance_ratio"])
    a, c = got["C01_a"], got["C02_c"]
    assert (a["txn_count_7d"], a["txn_count_30d"], a["txn_count_90d"]) == (4, 7, 10)
    assert (a["inflow_sum_7d"], a["inflow_sum_30d"]) == (230.0, 520.0)
    assert c["txn_count_7d"] is None and c["outflow_to_balance_ratio"] == 0.0


def test_later_and_unknown_rows_change_nothing(spark):
    cons, tx = ledger_rows()
    names = [*fx.features(), *fx.SPECTRA, *fx.BALANCES]
    more = [*tx, ("C01_a", "late", D + dt.timedelta(hours=1), 1e12, 3), ("C09_x", "who", D, 5.0, 3)]
    assert len(names) == 87
    assert frame(spark, cons, tx, names) == frame(spark, cons, more, names)


def test_pivot_zero_missing_and_absent(spark):
    cons, tx = ledger_rows()
    some = [t for t in tx if not (t[0] == "C01_b" and t[4] == 26)]
    got = frame(spark, cons, some, ["all_cat_26_amount"])
    assert got["C01_a"][3] > 0 and got["C01_b"][3] == 0 and got["C02_c"][3] is None
    with pytest.raises(ValueError, match="all_cat_26_amount"):
        frame(spark, cons, [t for t in tx if t[4] != 26], ["all_cat_26_amount"])


def test_only_observed_months_count(spark):
    cons = [("C01_a", D, 1.0, 0.0)]
    tx = [("C01_a", str(m), dt.datetime(2024, m, 15), 10.0, 3) for m in (1, 3)]
    row = frame(spark, cons, tx, ["fft_inflow_dom_power_ratio", "ts_inflow_slope", "ts_inflow_d2_mean"])["C01_a"]
    assert row[3] is None and row[4] == 0.0 and row[5] is None


def test_balance_is_anchored_to_the_evaluation_date(spark):
    e = dt.datetime(2024, 1, 3)
    cons = spark.createDataFrame([("C01_a", e, -10.0, 0.0)], CONS)
    tx = fx.prepare(cons, spark.createDataFrame([("C01_a", "1", dt.datetime(2024, 1, 1), 100.0, 3), ("C01_a", "2", e, -50.0, 3)], TX))
    days = fx.daily_balance(cons, tx).orderBy("date").collect()
    assert [r["balance"] for r in days] == [40.0, 40.0, -10.0]
    r = fx.balance_features(cons, tx).collect()[0]
    assert r["balance_neg_days"] == 1 and r["balance_min"] == -10 and math.isclose(r["balance_neg_days_ratio"], 1 / 3) and math.isclose(r["balance_mean"], 70 / 3)


def test_names_resolve_in_order():
    assert len(resolve_feature_names(["ledger_60"])) == 60 and FEATURE_SETS["ledger_60"][:56] == FEATURE_SETS["ledger_56"]
    assert resolve_feature_names(["balance_4", "balance_4"], ["balance_min", "x"])[-1] == "x"
    with pytest.raises(ValueError, match="no feature set"):
        resolve_feature_names(["none"])


def test_one_shuffle_of_transactions_and_no_python(spark):
    cons, tx = ledger_rows()
    df = fx.build_feature_frame(spark.createDataFrame(cons, CONS), spark.createDataFrame(tx, TX), ["ledger_56"], strict=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Window") >= 1


def test_broken_contracts_are_named(spark):
    cons, tx = ledger_rows()
    c, t = spark.createDataFrame(cons, CONS), spark.createDataFrame(tx, TX)
    ledger.validate(c, t)
    for bad, words in ((c.union(c), "several rows"), (c.drop("total_balance"), "lacks"), (c.where("1 = 0"), "no rows"), (c.selectExpr("'x' masked_consumer_id", "evaluation_date", "total_balance", "FPF_TARGET").limit(1), "three characters"), (c.selectExpr("masked_consumer_id", "evaluation_date", "total_balance", "2.0 FPF_TARGET"), "other than 0, 1"), (c.selectExpr("masked_consumer_id", "evaluation_date", "double('inf') total_balance", "FPF_TARGET"), "infinite")):
        with pytest.raises(ValueError, match=words):
            ledger.validate(bad, t)
