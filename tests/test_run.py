import json
import logging
import os
import sys

import pytest

from tallyspark.config import load_config
from tallyspark.demo import write_demo_inputs
from tallyspark.experiment import new_folder, run_experiment
from tallyspark.operators.feature_sets import resolve_feature_names

CONFIGS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "configs")


def test_demo_run(spark, tmp_path):
    hp = {"n_estimators": 2, "num_leaves": 3}
    client = {"n_consumers": 40, "positive_fraction": 0.25, "balance_range": [-500, 5000], "amount_scale": 1.0}
    config = {
        "seed": 42, "experiment": {"name": "demo", "log_root": str(tmp_path / "logs")}, "data": {"consumer_file": str(tmp_path / "c.parquet"), "transactions_dir": str(tmp_path / "tx")},
        "demo": {"staging_root": str(tmp_path), "evaluation_date": "2025-01-01", "history_periods": 4, "days_per_period": 30, "transactions_per_period": 6, "consumer_amount_scale_range": [0.7, 1.3],
                 "clients": {"C01": client, "C02": client}, "categories": [{"id": k, "amount_range": r} for k, r in ((3, [1200, 3500]), (10, [50, 400]), (12, [-600, -80]), (16, [-250, -10]), (23, [-45, -5]), (26, [-1200, -100]))]},
        "features": {"feature_sets": ["ledger_56"]}, "model": {"name": "soft_routing_moe", "hyperparameters": {"router": hp, "experts": {"C01": hp, "C02": hp}}, "training": {"min_expert_rows": 5}},
        "evaluation": {"name": "standard_holdout", "permutation_features": ["inflow_gap_mean"], "permutation_n_repeats": 1, "permutation_split": "validation"},
    }
    write_demo_inputs(spark, config)
    write_demo_inputs(spark, config)  # the same data again is fine
    before = logging.getLogger().handlers[:], logging.getLogger().level, sys.stdout
    out = run_experiment(spark, config)
    assert before == (logging.getLogger().handlers, logging.getLogger().level, sys.stdout)
    assert out["metrics"]["n_features"] == 56 and 0 <= out["metrics"]["test_auc"] <= 1
    assert json.load(open(f"{out['run_dir']}/metrics.json"))["permutation_split"] == "validation"
    folder = out["run_dir"]
    assert len(open(f"{folder}/splits.csv").read().splitlines()) == 81
    assert open(f"{folder}/predictions/test_predictions.csv").readline().strip() == "masked_consumer_id,predicted_score,true_label"
    assert {"val_auc", "test_auc", "val_group_auc", "test_group_auc", "per_client_auc", "val_per_client_auc"} <= set(out["metrics"])
    noted = json.load(open(f"{folder}/metadata.json"))
    assert noted["versions"]["numpy"] and noted["files"][0]["bytes"] and load_config(f"{folder}/config.yaml") == config
    assert "rows of the parts" in open(f"{folder}/run.log").read()


def test_a_failed_run_leaves_its_log(spark, tmp_path):
    config = load_config(f"{CONFIGS}/demo.yaml")
    config["experiment"]["log_root"] = str(tmp_path)
    config["data"] = {"consumer_file": str(tmp_path / "none.parquet"), "transactions_dir": str(tmp_path)}
    with pytest.raises(FileNotFoundError):
        run_experiment(spark, config, f"{CONFIGS}/demo.yaml")
    (folder,) = tmp_path.iterdir()
    assert "note_inputs failed" in (folder / "run.log").read_text() and (folder / "source_config.yaml").exists()


def test_runs_never_share_a_folder(tmp_path):
    config = {"experiment": {"name": "x", "log_root": str(tmp_path)}}
    assert len({new_folder(config) for _ in range(5)}) == 5


def test_demo_tables_are_guarded(spark, tmp_path):
    config = load_config(f"{CONFIGS}/demo.yaml")
    config["demo"] |= {"staging_root": str(tmp_path / "staging"), "history_periods": 1}
    config["data"] = {"consumer_file": str(tmp_path / "c.parquet"), "transactions_dir": str(tmp_path / "staging/tx")}
    with pytest.raises(ValueError, match="staging folder"):
        write_demo_inputs(spark, config)
    config["data"]["consumer_file"] = str(tmp_path / "staging/c.parquet")
    spark.range(3).write.parquet(str(tmp_path / "staging/tx/transactions_demo.parquet"))
    with pytest.raises(FileExistsError, match="other rows"):
        write_demo_inputs(spark, config)
    assert not (tmp_path / "staging/c.parquet").exists()
    spark.range(3).write.parquet(str(tmp_path / "staging/tx/transactions_001.parquet"))
    with pytest.raises(FileExistsError, match="aren't the demo's"):
        write_demo_inputs(spark, config)


def test_shipped_configs_are_usable():
    names = sorted(n for n in os.listdir(CONFIGS) if n.endswith(".yaml"))
    assert len(names) == 5
    for name in names:
        config = load_config(f"{CONFIGS}/{name}")
        assert resolve_feature_names(config["features"]["feature_sets"], config["features"].get("extra_features"))
