"""Column functions shared by the feature plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to every divisor; a fixed value of the feature definitions.
EPS = 1e-6
ID, EVAL, TARGET = "masked_consumer_id", "evaluation_date", "FPF_TARGET"


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(EPS))


def clean(x: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def inflow(amount: Column) -> Column:
    return F.when(amount > 0, amount).when(amount <= 0, F.lit(0.0))


def outflow(amount: Column) -> Column:
    return F.when(amount < 0, -amount).when(amount >= 0, F.lit(0.0))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed time in whole days, not calendar days."""
    return F.timestamp_diff("DAY", start, end)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def let(x: Column, then) -> Column:
    """then(x) with x evaluated once, though then uses it inside lambdas."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def client(name: str = ID) -> Column:
    return F.substring(name, 1, 3)


def order_hash(seed: int, *names: str) -> Column:
    """A reproducible random order of rows, whatever their partitions."""
    return F.md5(F.concat_ws("|", *[F.col(n).cast("string") for n in names], F.lit(str(seed))))
