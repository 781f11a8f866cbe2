"""Synthetic ledgers from a config's demo section, drawn by hashes, so that they are the same on every run."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalar import EVAL, ID, TARGET


def _unit(seed: int, *parts) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def build_demo_frames(spark: SparkSession, config: dict, seed: int) -> tuple[DataFrame, DataFrame]:
    periods, days, per = int(config["history_periods"]), int(config["days_per_period"]), int(config["transactions_per_period"])
    kinds = config["categories"]
    if periods < 1 or days < 1:
        raise ValueError(f"a demo of {periods} periods of {days} days has no history")
    if not kinds or per < len(kinds):
        raise ValueError(f"{per} transactions a period can't show each of {len(kinds)} categories")
    parts = []
    low, high = config["consumer_amount_scale_range"]
    for name, s in config["clients"].items():
        n, share = int(s["n_consumers"]), float(s["positive_fraction"])
        if n < 1 or not 0 < share < 1:
            raise ValueError(f"demo client {name}: {n} consumers with a share of {share} positives")
        a, b = s["balance_range"]
        rows = spark.range(n).select(F.concat(F.lit(f"{name}_demo_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias(ID), F.col("id").alias("i"))
        # labels: the first round(n * share) of an order that mixes the numbers
        mixed = F.pmod(F.col("i") * next(k for k in range(n // 2 + 1, 2 * n + 2) if _coprime(k, n)), F.lit(n))
        parts.append(rows.select(ID, F.lit(str(config["evaluation_date"])).cast("timestamp_ntz").alias(EVAL), (F.lit(float(a)) + _unit(seed, F.col(ID), "b") * float(b - a)).alias("total_balance"), (mixed < round(n * share)).cast("double").alias(TARGET), (F.lit(float(s["amount_scale"])) * (low + _unit(seed, F.col(ID), "s") * (high - low))).alias("scale")))
    consumers = parts[0]
    for p in parts[1:]:
        consumers = consumers.unionByName(p)
    table = F.array(*[F.struct(F.lit(int(k["id"])).alias("id"), F.lit(float(k["amount_range"][0])).alias("lo"), F.lit(float(k["amount_range"][1])).alias("hi")) for k in kinds])
    tx = consumers.select(ID, EVAL, "scale", F.explode(F.sequence(F.lit(0), F.lit(periods * per - 1))).alias("k")).withColumn("c", F.get(table, F.pmod(F.col("k"), F.lit(per)) % len(kinds)))
    back = F.floor(F.col("k") / per) * days + F.floor(_unit(seed, F.col(ID), F.col("k"), "d") * days)
    amount = (F.col("c.lo") + _unit(seed, F.col(ID), F.col("k"), "a") * (F.col("c.hi") - F.col("c.lo"))) * F.col("scale")
    posted = F.timestamp_add("DAY", -back.cast("int"), F.col(EVAL))
    out = tx.select(ID, F.concat_ws("-", F.col(ID), F.col("k").cast("string")).alias("masked_transaction_id"), posted.cast("timestamp_ntz").alias("posted_date"), amount.alias("amount"), F.col("c.id").alias("category"))
    return consumers.drop("scale"), out


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def write_demo_inputs(spark: SparkSession, config: dict) -> None:
    """Write the demo tables below demo.staging_root. Tables that exist must hold the same rows; all is checked before any is written."""
    folder = config["data"]["transactions_dir"]
    root = os.path.realpath(config["demo"]["staging_root"])
    for path in (config["data"]["consumer_file"], folder):
        if not os.path.realpath(path).startswith(root + os.sep):
            raise ValueError(f"{path} isn't below the staging folder {root}")
    own = "transactions_demo.parquet"
    strange = sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else ()) if n.startswith("transactions_") and n != own)
    if strange:
        raise FileExistsError(f"{folder} holds shards that aren't the demo's: {strange}")
    missing = []
    for df, path in zip(build_demo_frames(spark, config["demo"], config["seed"]), (config["data"]["consumer_file"], os.path.join(folder, own)), strict=True):
        if not os.path.exists(path):
            missing.append((df, path))
            continue
        old = spark.read.parquet(path)
        if old.columns != df.columns or old.exceptAll(df).unionByName(df.exceptAll(old)).limit(1).count():
            raise FileExistsError(f"{path} exists and holds other rows")
    os.makedirs(folder, exist_ok=True)
    for df, path in missing:
        df.write.mode("errorifexists").parquet(path)
