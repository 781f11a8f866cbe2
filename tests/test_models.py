import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.config import problems, validate_config
from tallyspark.functions.scalar import order_hash
from tallyspark.operators import evaluation, moe, ordering, sampling

ROWS = "masked_consumer_id string, FPF_TARGET double, f double"


def clients(spark, n=100, every=5):
    return spark.createDataFrame([(f"C0{c}_{i:04d}", float(i % every == 0), float(i % every == 0) + i / 1000) for c in (1, 2, 3) for i in range(n)], ROWS)


def test_split_sizes_and_labels(spark):
    out = sampling.split_622(clients(spark), 42)
    got = {r["split"]: (r["n"], r["y"]) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.avg("FPF_TARGET").alias("y")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"train": 180, "validation": 60, "test": 60}
    assert all(math.isclose(v[1], 0.2) for v in got.values())
    assert out.exceptAll(sampling.split_622(clients(spark), 42)).count() == 0
    with pytest.raises(ValueError, match="nothing to split"):
        sampling.split_622(clients(spark).where("1 = 0"), 42)


def test_resampling_and_weights(spark):
    df = spark.createDataFrame([(f"C01_{i}", float(i < 2), float(i)) for i in range(12)], ROWS)
    down = sampling.downsample_negatives(df, 0.2, 1)
    assert down.where("FPF_TARGET = 1").count() == 2 and down.where("FPF_TARGET = 0").count() == 2
    two = spark.createDataFrame([("C01_a", 1.0, 10.0), ("C01_b", 1.0, 20.0), ("C01_c", 0.0, None)], ROWS)
    up = sampling.augment_positives(two, ["f"], 2.0, 5, 1).collect()
    made = [r["f"] for r in up if "#" in r["masked_consumer_id"]]
    assert len(made) == 2 and all(10 <= x <= 20 for x in made) and [r["f"] for r in up if r["masked_consumer_id"] == "C01_c"] == [0.0]
    w = sampling.sample_weights({"sample_weight": True, "downsample_negative_keep_ratio": 0.2, "smote_positive_multiplier": 2.0})
    assert [r[0] for r in two.orderBy("masked_consumer_id").select(w).collect()] == [0.5, 0.5, 5.0]
    with pytest.raises(ValueError):
        sampling.downsample_negatives(df, 0, 1)


def test_routing(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 0.2, 0.9), (0.1, 0.2, 0.7, 0.4, 0.5)], "c3 double, c1 double, c2 double, e1 double, e3 double")
    risk = moe.blend({"C03": F.col("c3"), "C01": F.col("c1"), "C02": F.col("c2")}, {"C01": F.col("e1"), "C03": F.col("e3")})
    got = [r[0] for r in df.select(risk).collect()]
    assert math.isclose(got[0], (0.5 * 0.9 + 0.3 * 0.2) / 0.8) and math.isclose(got[1], (0.1 * 0.5 + 0.2 * 0.4) / 0.3)
    with pytest.raises(Exception, match="no weight on any expert"):
        df.select(moe.blend({"C01": F.lit(0.0)}, {"C01": F.lit(0.5)})).collect()


def test_auc(spark):
    rows = [("C01", 0.0, 0.1), ("C01", 1.0, 0.9), ("C02", 0.0, 0.9), ("C02", 0.0, 0.8), ("C02", 1.0, 0.2), ("C02", 1.0, 0.1), ("C03", 1.0, 0.5)]
    df = spark.createDataFrame([(f"{c}_{i}", y, s) for i, (c, y, s) in enumerate(rows)], "masked_consumer_id string, FPF_TARGET double, score double")
    got = evaluation.evaluate(df, "standard_holdout")
    assert got["per_client_auc"] == {"C01": 1.0, "C02": 0.0} and got["test_group_auc"] == 0.5
    with pytest.raises(ValueError, match="undefined"):
        evaluation.evaluate(df.where("FPF_TARGET = 1"), "auc_only")
    with pytest.raises(ValueError, match="no evaluator"):
        evaluation.evaluate(df, "none")


def test_auc_of_any_scores_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(3)
    rows = [(f"C01_{i}", float(rng.random() < 0.4), float(rng.choice([rng.gauss(0, 2), rng.randint(-2, 3), 0.5, 1e300]))) for i in range(300)]
    df = spark.createDataFrame(rows, "masked_consumer_id string, FPF_TARGET double, score double")
    wins = [(a > b) + (a == b) / 2 for _, y, a in rows if y for _, z, b in rows if not z]
    assert math.isclose(evaluation.evaluate(df, "auc_only")["test_auc"], sum(wins) / len(wins))


def test_places_are_those_of_one_sort(spark):
    ids = [f"C0{i % 3}_{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "masked_consumer_id string")
    got = {r[0]: r[1] for r in ordering.number(df.withColumn("k", F.substring("masked_consumer_id", 1, 3)), ["k"], order_hash(1, "masked_consumer_id"), "masked_consumer_id", "n").select("masked_consumer_id", "n").collect()}
    for k in ("C00", "C01", "C02"):
        some = sorted((i for i in ids if i.startswith(k)), key=lambda i: hashlib.md5(f"{i}|1".encode()).hexdigest())
        assert [got[i] for i in some] == list(range(1, len(some) + 1))


def test_permuting_moves_values_only(spark):
    df = spark.createDataFrame([(f"C01_{i:03d}", float(i % 2), float(i), 1.0) for i in range(100)], "masked_consumer_id string, FPF_TARGET double, f double, k double")
    out = evaluation.permuted(df, "f", 1, range(2)).collect()
    for t in (0, 1):
        rows = sorted((r for r in out if r["_repeat"] == t), key=lambda r: r["masked_consumer_id"])
        assert sorted(r["f"] for r in rows) == [float(i) for i in range(100)] and [r["FPF_TARGET"] for r in rows] == [float(i % 2) for i in range(100)]
        assert sum(r["f"] == i for i, r in enumerate(rows)) < 10
    plan = evaluation.permuted(df, "f", 1, range(2))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "SinglePartition" not in evaluation.auc_by(df.withColumn("score", F.col("f")).withColumn("g", F.col("k")), ["g"])._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_several_blocks(spark):
    rng = random.Random(5)
    points = [(k, f"{k}{i}", i, [rng.randint(0, 9) * 1.0, rng.random()]) for k in "ab" for i in range(25)]
    df = spark.createDataFrame(points, "key string, id string, i long, x array<double>")
    got = {(r["key"], r["id"]): [n["id"] for n in r["near"]] for r in sampling.nearest(df, ["key"], 3, block=7).collect()}
    for k, i, _, x in points:
        others = sorted((sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)), j) for c, j, _, y in points if c == k and j != i)
        assert got[k, i] == [j for _, j in others[:3]]
    assert "NestedLoop" not in sampling.nearest(df, ["key"], 3)._jdf.queryExecution().executedPlan().toString()


def test_scores_must_be_probabilities(spark):
    df = spark.createDataFrame([(0.5,), (1.0 + 1e-12,)], "p double")
    assert [r[0] for r in df.select(moe.probability(F.col("p"))).collect()] == [0.5, 1.0]
    for bad in (None, float("nan"), -0.1, 1.1):
        with pytest.raises(Exception, match="not a probability"):
            spark.createDataFrame([(bad,)], "p double").select(moe.probability(F.col("p"))).collect()


def test_the_router_sees_rows_as_they_are_and_others_stay_unsampled(spark, monkeypatch):
    seen = {}
    inner = sampling.resample_group

    def watch(df, features, name, training, seed):
        out = inner(df, features, name, training, seed)
        seen[name] = (df.count(), out.count())
        return out

    monkeypatch.setattr(moe, "resample_group", watch)
    hp = {"n_estimators": 2, "num_leaves": 3}
    training = {"min_expert_rows": 5, "downsample_negative_clients": ["C01"], "downsample_negative_keep_ratio": 0.5, "smote_positive_clients": ["C01"], "sample_weight": True}
    config = {"name": "soft_routing_moe", "hyperparameters": {"router": hp, "experts": {"C01": hp, "C02": hp}}, "training": training}
    model = moe.fit_model(moe.build_model(config, 1, 2), clients(spark, 30), ["f"])
    assert seen == {"C01": (30, 24), "C02": (30, 30)} and model.router_classes == ["C01", "C02", "C03"]
    weights = clients(spark, 5).select(sampling.sample_weights(training)).distinct().collect()
    assert sorted(r[0] for r in weights) == [1.0, 2.0]


def test_importance_of_a_signal_and_a_constant(spark):
    class Model:
        feature_cols = ["f", "k"]

        def transform(self, df):
            return df.withColumn("score", F.col("f"))

    df = spark.createDataFrame([(f"C01_{i:02d}", float(i % 2), float(i % 2), 1.0) for i in range(40)], "masked_consumer_id string, FPF_TARGET double, f double, k double")
    got = evaluation.permutation_importance(Model(), df, ["f", "k"], n_repeats=3, seed=1)
    assert got["f"]["mean_auc_drop"] > 0.2 and got["k"] == {"mean_auc_drop": 0.0, "std_auc_drop": 0.0}


def test_mixture_round_trip(spark, tmp_path):
    hp = {"n_estimators": 2, "num_leaves": 3}
    config = {"name": "soft_routing_moe", "hyperparameters": {"router": hp, "experts": {"C01": hp, "C03": hp, "C09": hp}}, "training": {"min_expert_rows": 5}}
    train = clients(spark, 30)
    model = moe.fit_model(moe.build_model(config, 1, 1), train, ["f"])
    assert list(model.experts) == ["C01", "C03"]
    moe.save_model(model, str(tmp_path))
    a, b = model.transform(train).collect(), moe.load_model(str(tmp_path)).transform(train).collect()
    assert all(abs(x["score"] - y["score"]) < 1e-15 and 0 <= x["score"] <= 1 for x, y in zip(a, b, strict=True))
    with pytest.raises(ValueError, match="labels other than 0 and 1"):
        moe.fit_model(model, train.withColumn("FPF_TARGET", F.lit(2.0)), ["f"])


def test_config():
    good = {"seed": 1, "experiment": {"name": "x"}, "data": {"consumer_file": "a", "transactions_dir": "b"}, "features": {"feature_sets": ["ledger_44"]}, "model": {"name": "m", "hyperparameters": {"router": {}, "experts": {"C01": {}}}}, "evaluation": {"name": "auc_only"}}
    validate_config(good)
    for bad in ({"seed": -1}, {"experiment": {"name": "a/b"}}, {"features": {"feature_sets": []}}, {"model": good["model"] | {"training": {"downsample_negative_keep_ratio": 0}}}, {"evaluation": {"name": "x", "permutation_n_repeats": 0}}):
        with pytest.raises(ValueError):
            validate_config(good | bad)
    assert len(problems(good | {"seed": -1, "experiment": {"name": ".."}, "evaluation": {}})) == 3
    assert problems([]) and not problems(good | {"model": good["model"] | {"training": {"smote_positive_clients": ["C01"]}}})
    assert problems(good | {"model": good["model"] | {"training": {"smote_positive_clients": ["C07"]}}})


def test_a_client_with_too_few_rows_is_not_split(spark):
    few = clients(spark, 4, 4).where("masked_consumer_id like 'C01%'")
    with pytest.raises(ValueError, match="C01"):
        sampling.split_622(few, 1)
    twice = clients(spark).unionByName(clients(spark, 1))
    with pytest.raises(ValueError, match="ids repeat"):
        sampling.split_622(twice, 1)
