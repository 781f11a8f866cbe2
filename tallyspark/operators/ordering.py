"""Places and running totals over whole tables without sorting them in one task.

Rows are dealt out by the first digits of a hash, or by slices of a score, which follow the order asked for. A
window within each slice then needs only the total of the slices before it, which one small aggregate gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that make a slice: 4,096 slices.
DIGITS = 3


def after_earlier_slices(df: DataFrame, keys: Sequence[str], value: Column, name: str, few: bool = False) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same keys in smaller `_slice`s. few: keys are few, and the slices' totals are sent to all tasks."""
    cols = [*keys, "_slice"]
    totals = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in cols]).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*([f"_of_{k}" for k in keys] or [F.lit(0)])).orderBy("_of__slice").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as slices for each of keys
    totals = totals.withColumn(name, F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cols])
    return df.join(F.broadcast(totals) if few else totals, same).drop(*[f"_of_{c}" for c in cols])


def number(df: DataFrame, keys: Sequence[str], order: Column, tie: str, name: str, few: bool = False) -> DataFrame:
    """df with `name`: the place (from 1) of each row by the hex hash `order`, then tie, among rows of the same keys."""
    sliced = df.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, DIGITS))
    placed = after_earlier_slices(sliced, keys, F.lit(1).cast("long"), "_before", few)
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_order", tie))
    return placed.withColumn(name, F.col("_before") + within).drop("_order", "_slice", "_before")
