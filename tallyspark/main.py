"""python -m tallyspark.main CONFIG [--demo]: run an experiment (with --demo on synthetic inputs made first)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyspark.config import load_config
from tallyspark.demo import write_demo_inputs
from tallyspark.experiment import run_experiment


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--demo", action="store_true")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.demo:
        write_demo_inputs(spark, config)
    return run_experiment(spark, config, args.config)


if __name__ == "__main__":
    main()
