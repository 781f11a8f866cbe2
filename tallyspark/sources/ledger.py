"""Reading and validating ledgers, and ledgers made of the driver's star schema."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalar import EVAL, ID, TARGET

CONSUMER_COLUMNS = (ID, EVAL, "total_balance", TARGET)
TRANSACTION_COLUMNS = (ID, "masked_transaction_id", "posted_date", "amount", "category")


def resolve_data_paths(config: dict) -> tuple[str, list[str]]:
    """The consumer file and the sorted transaction shards of a config; FileNotFoundError if any is missing."""
    consumer = os.path.expanduser(config["data"]["consumer_file"])
    folder = os.path.expanduser(config["data"]["transactions_dir"])
    if not os.path.exists(consumer):
        raise FileNotFoundError(f"consumer_file not found: {consumer}")
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"transactions_dir not found: {folder}")
    shards = sorted(glob.glob(os.path.join(glob.escape(folder), "transactions_*.parquet")))
    if not shards:
        raise FileNotFoundError(f"No transactions_*.parquet files in {folder}")
    return consumer, shards


def load_inputs(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    consumer, shards = resolve_data_paths(config)
    return validate(spark.read.parquet(consumer), spark.read.option("mergeSchema", "true").parquet(*shards))


def report(frame: DataFrame, date: str, number: str, label: str | None = None) -> DataFrame:
    """One row of counts: rows, bad_ids, repeated_ids, bad_dates, infinite, bad_labels. One pass over the table."""
    bad_id = F.col(ID).isNull() | (F.length(F.col(ID).cast("string")) < 3)
    aggregates = [
        F.count("*").alias("n_rows"), F.sum(bad_id.cast("long")).alias("bad_ids"),
        F.sum(F.col(date).isNull().cast("long")).alias("bad_dates"),
        F.sum(F.coalesce((F.abs(F.col(number).cast("double")) == float("inf")), F.lit(False)).cast("long")).alias("infinite"),
    ]
    if label is not None:
        aggregates.append((F.count(ID) - F.count_distinct(ID)).alias("repeated_ids"))
        aggregates.append(F.sum((F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")) & ~F.col(label).isin(0, 1)).cast("long")).alias("bad_labels"))
    return frame.agg(*aggregates)


def validate(consumers: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables with parsed dates; ValueError where the data contract is broken."""
    for frame, columns, name in ((consumers, CONSUMER_COLUMNS, "Consumer"), (transactions, TRANSACTION_COLUMNS, "Transaction")):
        missing = sorted(set(columns) - set(frame.columns))
        if missing:
            raise ValueError(f"{name} table lacks {missing}")
    out = []
    for frame, date, number, label, name in (
        (consumers, EVAL, "total_balance", TARGET, "Consumer"), (transactions, "posted_date", "amount", None, "Transaction"),
    ):
        kinds = dict(frame.dtypes)
        if kinds[ID] != "string":
            raise ValueError(f"{name} table: ids are text that begins with a client's three characters")
        if kinds[number] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kinds[number].startswith("decimal"):
            raise ValueError(f"{name} table: {number} is no number")
        if kinds[date] == "string":
            frame = frame.withColumn(date, F.try_to_timestamp(date).cast("timestamp_ntz"))
        elif kinds[date] != "timestamp_ntz":
            frame = frame.withColumn(date, F.col(date).cast("timestamp_ntz"))
        r = report(frame, date, number, label).collect()[0].asDict()
        if not r["n_rows"]:
            raise ValueError(f"{name} table has no rows")
        faults = {"bad_ids": "ids without a client's three characters", "repeated_ids": "ids that stand in several rows", "bad_labels": f"{TARGET} other than 0, 1 and null", "bad_dates": f"{date} without a date", "infinite": f"infinite {number}"}
        found = [f"{r[key]} {what}" for key, what in faults.items() if r.get(key)]
        if found:
            raise ValueError(f"{name} table: {', '.join(found)}")
        out.append(frame)
    return out[0], out[1]


def _id(key: str):
    return F.concat(F.lit("C0"), (F.col(key) % 3 + 1).cast("string"), F.lit("_"), F.lpad(F.col(key).cast("string"), 8, "0"))


def order_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumers of order_ledger, for what needs no transactions."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    target = F.when(F.col("c_custkey") % 17 == 0, None).when((F.col("c_custkey") * 7919) % 10 < 3, 1.0).otherwise(0.0)
    evaluation = F.to_timestamp_ntz(F.date_sub(F.lit("2000-06-30").cast("date"), (F.col("c_custkey") % 90).cast("int")).cast("string"))
    return customer.select(_id("c_custkey").alias(ID), evaluation.alias(EVAL), F.col("c_acctbal").alias("total_balance"), target.alias(TARGET))


def order_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Consumers and transactions made of customer, orders and lineitem: a long history at midnight."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    codes = F.array(*map(F.lit, (3, 10, 12, 16, 23, 26, 18, 31)))
    category = F.get(codes, ((F.col("l_partkey") + F.col("l_linenumber")) % 8).cast("int"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    tx = lines.select(
        _id("o_custkey").alias(ID), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("masked_transaction_id"),
        F.col("l_shipdate").alias("posted_date"), F.when(category.isin(3, 10), amount).otherwise(-amount).alias("amount"), category.alias("category"),
    )
    return order_consumers(spark, sf_dir), tx


def event_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same of events: times within the day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.select("user_id").distinct()
    consumers = users.select(_id("user_id").alias(ID), F.to_timestamp_ntz(F.lit("2024-01-25 12:00:00")).alias(EVAL), (F.col("user_id") * 37 % 2000 - 500).cast("double").alias("total_balance"), F.lit(None).cast("double").alias(TARGET))
    category = F.create_map(*[F.lit(x) for p in (("signup", 3), ("click", 10), ("view", 12), ("error", 23), ("purchase", 26)) for x in p])[F.col("event_type")]
    amount = F.when(F.col("event_type").isin("purchase", "error"), -F.col("value")).otherwise(F.col("value"))
    tx = events.select(_id("user_id").alias(ID), F.col("event_id").cast("string").alias("masked_transaction_id"), F.col("ts").alias("posted_date"), amount.alias("amount"), category.alias("category"))
    return consumers, tx
