"""Point-in-time features of each consumer, as one plan with one shuffle of the transactions.

Transactions are dealt out by consumer once. A window adds the days since the last positive inflow; grouping by
(consumer, month) and then by consumer needs no other shuffle. The months of a consumer end in one sorted array,
on which trends, second differences and spectra are computed by higher-order functions. Balances are constant
between days with transactions, so their statistics come from intervals, not from a row for each day.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalar import EPS, EVAL, ID, TARGET, array_sum, clean, inflow, let, outflow, safe_div, whole_days
from tallyspark.operators.feature_sets import resolve_feature_names

#: Categories of each pivot, and the days it looks back; fixed values.
PIVOTS = {"all": ((3, 12, 26), None), "d30": ((3, 12, 23, 26), 30), "d90": ((3, 10, 12, 23, 26), 90)}
SERIES = ("inflow", "outflow", "net")
SPECTRUM = ("dom_power_ratio", "spectral_entropy", "dom_freq_idx", "low_freq_ratio", "top2_power_ratio")


def prepare(consumers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions of known consumers up to and with their evaluation date, with what features need of a row."""
    known = consumers.select(ID, EVAL)
    tx = transactions.join(known, ID).where(F.col("posted_date") <= F.col(EVAL))
    amount = clean(F.col("amount"))
    return tx.select(
        ID, EVAL, "masked_transaction_id", "posted_date", F.col("category").cast("int").alias("category"), amount.alias("amount"),
        F.abs(amount).alias("amount_abs"), inflow(amount).alias("inflow_amount"), outflow(amount).alias("outflow_amount"),
        whole_days(F.col("posted_date"), F.col(EVAL)).alias("days_before"), F.trunc("posted_date", "MM").alias("month"),
    )


def _within(days: int | None) -> Column:
    return F.lit(True) if days is None else F.col("days_before") <= days


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def with_gaps(tx: DataFrame) -> DataFrame:
    """gap: of a positive inflow, the whole days since the one before."""
    before = Window.partitionBy(ID).orderBy("posted_date").rowsBetween(Window.unboundedPreceding, -1)
    date = F.when(F.col("inflow_amount") > 0, F.col("posted_date"))
    return tx.withColumn("gap", F.when(F.col("inflow_amount") > 0, whole_days(F.last(date, ignorenulls=True).over(before), F.col("posted_date"))))


def monthly_partials(tx: DataFrame, buckets: str = "calendar") -> DataFrame:
    """(consumer, month): everything that adds up over months. tx: prepared, with gaps and category totals."""
    flag = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    ago = F.floor(F.datediff(F.trunc(EVAL, "MM"), F.col("month")) / 30) if buckets == "calendar" else F.lit(0)
    last3, prior3 = ago < 3, (ago >= 3) & (ago < 6)
    row = F.col("amount_abs")
    out = [
        F.first(EVAL).alias("eval"), F.count("*").alias("rows"), F.count("masked_transaction_id").alias("txns"),
        F.count("amount").alias("n"), F.avg("amount").alias("mean"), F.var_pop("amount").alias("var"),
        _total(F.col("inflow_amount")).alias("inflow"), _total(F.col("outflow_amount")).alias("outflow"), _total(F.col("amount")).alias("net"),
        _total(row).alias("abs"), F.max(row).alias("abs_max"), F.min("posted_date").alias("first"), F.max("posted_date").alias("last"),
        flag(F.col("inflow_amount") > 0).alias("positive"), _total(F.when(F.col("inflow_amount") > 0, F.col("inflow_amount"))).alias("positive_sum"),
        F.count("gap").alias("gaps"), F.sum("gap").alias("gap_sum"), F.sum(F.col("gap") * F.col("gap")).alias("gap_sq"), F.max("gap").alias("gap_max"),
        _total(F.when(F.col("category") == 26, row)).alias("cc"), _total(F.when(F.col("category") == 16, row)).alias("gm"),
        F.count(F.when(F.col("category") == 16, F.col("masked_transaction_id"))).alias("gm_n"),
        flag((row % 50 < EPS) | (row % 100 < EPS)).alias("round"), flag(F.weekday("posted_date").isin(5, 6)).alias("weekend"),
        flag(F.dayofmonth("posted_date") >= 25).alias("late"), _total(F.when(F.col("category").isNotNull(), row * F.col("category_total"))).alias("hhi"),
        F.count("category").alias("categorised"), flag(last3).alias("last3"), flag(prior3).alias("prior3"),
    ]
    for name, part in (("last3", last3), ("prior3", prior3)):
        for flow in ("inflow", "outflow"):
            out.append(_total(F.when(part, F.col(f"{flow}_amount"))).alias(f"{name}_{flow}"))
    for days in (7, 30, 90):
        w = _within(days)
        out += [flag(w).alias(f"rows_{days}"), F.count(F.when(w, F.col("masked_transaction_id"))).alias(f"txns_{days}")]
        out += [_total(F.when(w, F.col(f"{flow}_amount"))).alias(f"{flow}_{days}") for flow in ("inflow", "outflow")]
    for prefix, (categories, days) in PIVOTS.items():
        w = _within(days)
        out.append(flag(w & F.col("category").isin(*categories)).alias(f"{prefix}_rows"))
        for c in categories:
            hit = w & (F.col("category") == c)
            out += [F.count(F.when(hit, F.col("masked_transaction_id"))).alias(f"{prefix}_{c}_count"), _total(F.when(hit, row)).alias(f"{prefix}_{c}_amount")]
    return tx.groupBy(ID, "month").agg(*out)


_MAX, _MIN = ("abs_max", "last", "gap_max", "eval"), ("first",)
_OWN = ("month", "mean", "var", ID)


def consumer_partials(months: DataFrame) -> DataFrame:
    """Per consumer: sums, extremes and the sorted array of months."""
    fold = []
    for c in months.columns:
        if c not in _OWN:
            fold.append((F.max if c in _MAX else F.min if c in _MIN else F.sum)(c).alias(c))
    fold.append(F.min(F.when(F.col("positive") > 0, F.col("positive_sum"))).alias("inflow_monthly_min"))
    fields = ("month", "n", "mean", "var", *SERIES, "positive")
    fold.append(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"m_{c}" if c in ("n", "mean", "var") else c) for c in fields]))).alias("months"))
    return months.groupBy(ID).agg(*fold)


def _values(name: str) -> Column:
    return F.transform("months", lambda m: m[name])


def _mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def trend(name: str) -> dict[str, Column]:
    y, n = _values(name), F.size("months")
    mx, my = (n - 1) / F.lit(2.0), _mean(y)
    sxy = let(my, lambda m: array_sum(F.transform(y, lambda v, i: (i - mx) * (v - m))))
    sxx = array_sum(F.transform(y, lambda v, i: (i - mx) * (i - mx)))
    syy = let(my, lambda m: array_sum(F.transform(y, lambda v: (v - m) * (v - m))))
    slope = F.when(n >= 2, safe_div(sxy, sxx))
    second = let(y, lambda v: F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.get(v, i) - 2 * F.get(v, i - 1) + F.get(v, i - 2)))
    return {
        f"ts_{name}_slope": slope,
        f"ts_{name}_slope_norm": F.when(n >= 2, safe_div(slope, my)),
        f"ts_{name}_r2": F.when(n >= 2, safe_div(sxy * sxy, sxx * syy + EPS)),
        f"ts_{name}_d2_mean": F.when(n >= 3, _mean(second)),
    }


def amplitudes(name: str) -> Column:
    """Amplitudes of the harmonics 1 .. n/2 of the months' deviations from their mean."""
    n = F.size("months")

    def harmonics(z: Column) -> Column:
        def at(k: Column) -> Column:
            angle = lambda i: F.lit(2 * math.pi) * F.pmod(k * i, n) / n
            re = array_sum(F.transform(z, lambda v, i: v * F.cos(angle(i))))
            im = array_sum(F.transform(z, lambda v, i: v * F.sin(angle(i))))
            return F.sqrt(re * re + im * im)

        return F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), at)

    centred = let(_values(name), lambda y: let(_mean(y), lambda m: F.transform(y, lambda v: v - m)))
    return F.when(n >= 3, let(centred, harmonics))


def spectrum(name: str) -> dict[str, Column]:
    """Of a column amp_<name>. Equal amplitudes within 1e-9 count as ties, of which the lowest harmonic is dominant."""
    a = F.col(f"amp_{name}")
    total, most = array_sum(a) + EPS, F.array_max(a)
    share = let(total, lambda t: F.transform(a, lambda v: v / t))
    values = (
        most / total,
        -array_sum(F.transform(share, lambda p: p * F.ln(p + EPS))),
        let(most, lambda top: F.array_position(F.transform(a, lambda v: v >= top * (1 - 1e-9)), True)).cast("double"),
        array_sum(F.slice(a, 1, 2)) / total,
        array_sum(F.slice(F.reverse(F.array_sort(a)), 1, 2)) / total,
    )
    return {f"fft_{name}_{s}": v for s, v in zip(SPECTRUM, values, strict=True)}


def features() -> dict[str, Column]:
    """Every feature but balances and spectra, from a consumer's partials joined to the consumer."""
    c = F.col
    some = lambda name, x: F.when(c(name) > 0, x)
    mean = F.try_divide(array_sum(F.transform("months", lambda m: F.coalesce(m["m_n"] * m["m_mean"], F.lit(0.0)))), c("n"))
    squares = let(mean, lambda a: array_sum(F.transform("months", lambda m: F.coalesce(m["m_n"] * (m["m_var"] + (m["m_mean"] - a) * (m["m_mean"] - a)), F.lit(0.0)))))
    balance = F.abs("total_balance") + 1.0
    out_sum, hist = F.coalesce("outflow", F.lit(0.0)), whole_days(c("first"), c("eval"))
    gap_mean = F.try_divide(c("gap_sum"), c("gaps"))
    gap_std = F.when(c("gaps") > 1, F.sqrt(F.greatest(F.lit(0.0), (c("gap_sq") - c("gap_sum") * gap_mean) / (c("gaps") - 1))))
    life = F.greatest(hist, F.lit(1))
    months, flows = F.size("months"), _values("inflow")
    flow_mean = _mean(flows)
    moment = lambda k: let(flow_mean, lambda m: _mean(F.transform(flows, lambda v: F.pow(v - m, F.lit(float(k))))))
    out = {
        "total_balance": c("total_balance"), "amount_mean": mean, "amount_std": F.when(c("n") > 1, F.sqrt(squares / (c("n") - 1))),
        "amount_abs_mean": F.try_divide(c("abs"), c("n")), "amount_abs_max": c("abs_max"), "inflow_sum": c("inflow"),
        "txn_count_7d": some("rows_7", c("txns_7")), "txn_count_30d": some("rows_30", c("txns_30")), "txn_count_90d": some("rows_90", c("txns_90")),
        "inflow_sum_7d": some("rows_7", c("inflow_7")), "inflow_sum_30d": some("rows_30", c("inflow_30")),
        "inflow_to_balance_ratio": safe_div(c("inflow"), balance), "outflow_to_balance_ratio": safe_div(out_sum, balance),
        "outflow_to_inflow_ratio": safe_div(out_sum, c("inflow")),
        "recent_7d_to_30d_txn_ratio": safe_div(some("rows_7", c("txns_7")), some("rows_30", c("txns_30"))),
        "recent_30d_to_90d_txn_ratio": safe_div(some("rows_30", c("txns_30")), some("rows_90", c("txns_90"))),
        "cc_payment_amount_share": safe_div(F.coalesce("cc", F.lit(0.0)), out_sum),
        "gen_merch_avg_txn_amount": safe_div(F.coalesce("gm", F.lit(0.0)), F.coalesce("gm_n", F.lit(0))),
        "inflow_gap_mean": gap_mean, "inflow_gap_cv": safe_div(gap_std, gap_mean), "inflow_monthly_min": c("inflow_monthly_min"),
        "history_days": F.when(c("first").isNotNull(), F.greatest(hist, F.lit(0))),
        "recency_days": F.when(c("last").isNotNull(), F.greatest(whole_days(c("last"), c("eval")), F.lit(0))),
        "risk_overdraft_months_ratio": array_sum(F.transform("months", lambda m: (m["outflow"] > m["inflow"]).cast("double"))) / months,
        "risk_max_inflow_to_mean": safe_div(F.array_max(flows), flow_mean),
        "risk_inflow_monthly_skew": F.when((months >= 3) & (moment(2) > 0), moment(3) / F.pow(moment(2), F.lit(1.5))),
        "risk_months_no_inflow_ratio": safe_div(months - F.size(F.filter(flows, lambda v: v > 0)), months),
        "risk_last3m_inflow_vs_prior3m": safe_div(some("last3", c("last3_inflow")), F.coalesce(some("prior3", c("prior3_inflow")), F.lit(EPS))),
        "risk_last3m_outflow_vs_prior3m": safe_div(some("last3", c("last3_outflow")), F.coalesce(some("prior3", c("prior3_outflow")), F.lit(EPS))),
        "risk_outflow_to_inflow_last3m": safe_div(some("last3", c("last3_outflow")), some("last3", c("last3_inflow"))),
        "risk_round_amount_ratio": safe_div(c("round"), c("txns")), "risk_weekend_txn_ratio": safe_div(c("weekend"), c("txns")),
        "risk_late_month_txn_ratio": safe_div(c("late"), c("txns")),
        "risk_category_hhi": some("categorised", c("hhi") / F.pow(c("abs") + EPS, F.lit(2.0))),
        "risk_inflow_gap_max_norm": safe_div(c("gap_max"), life),
    }
    for name, recent, whole in (("inflow", "inflow_30", "inflow"), ("outflow", "outflow_30", "outflow"), ("txn", "txns_30", "txns")):
        out[f"risk_velocity_{name}_recent"] = safe_div(safe_div(some("rows_30", c(recent)), F.lit(30)), safe_div(c(whole), life))
    for prefix, (categories, _) in PIVOTS.items():
        for k in categories:
            if prefix != "d30":
                out[f"{prefix}_cat_{k}_count"] = some(f"{prefix}_rows", c(f"{prefix}_{k}_count"))
            out[f"{prefix}_cat_{k}_amount"] = some(f"{prefix}_rows", c(f"{prefix}_{k}_amount"))
    for name in SERIES:
        got = trend(name)
        if name != "inflow":
            del got[f"ts_{name}_r2"]
        out |= got
    return out


BALANCES = ("balance_neg_days", "balance_neg_days_ratio", "balance_min", "balance_mean")
SPECTRA = tuple(f"fft_{s}_{x}" for s in SERIES for x in SPECTRUM)


def _day_sums(tx: DataFrame) -> DataFrame:
    return tx.groupBy(ID, F.to_date("posted_date").alias("date")).agg(_total(F.col("amount")).alias("net"), F.max(F.to_date(EVAL)).alias("end"))


def balance_steps(consumers: DataFrame, tx: DataFrame) -> DataFrame:
    """Consumer, date, days, balance: a row for each day with transactions, whose balance holds for so many days."""
    later = Window.partitionBy(ID).orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    order = Window.partitionBy(ID).orderBy("date")
    steps = _day_sums(tx).withColumns({"after": F.coalesce(F.sum("net").over(later), F.lit(0.0)), "next": F.lead("date").over(order)})
    days = F.datediff(F.coalesce("next", F.date_add("end", 1)), F.col("date"))
    held = consumers.select(ID, clean(F.col("total_balance")).alias("total_balance"))
    return steps.join(held, ID).select(ID, "date", days.alias("days"), (F.col("total_balance") - F.col("after")).alias("balance"))


def daily_balance(consumers: DataFrame, tx: DataFrame) -> DataFrame:
    """Consumer, date, balance of every calendar day from the first transaction to the evaluation date."""
    steps = balance_steps(consumers, tx)
    return steps.select(ID, F.explode(F.sequence(F.lit(0), F.col("days") - 1)).alias("k"), "date", "balance").select(ID, F.date_add("date", F.col("k")).alias("date"), "balance")


def balance_features(consumers: DataFrame, tx: DataFrame) -> DataFrame:
    known = F.when(F.col("balance").isNotNull(), F.col("days"))
    out = balance_steps(consumers, tx).groupBy(ID).agg(
        F.sum(F.when(F.col("balance") < 0, F.col("days")).otherwise(0)).alias("balance_neg_days"), F.min("balance").alias("balance_min"),
        F.sum(F.col("balance") * F.col("days")).alias("total"), F.coalesce(F.sum(known), F.lit(0)).alias("days"),
    )
    ratio = F.col("balance_neg_days") / F.greatest(F.col("days"), F.lit(1))
    return out.select(ID, "balance_neg_days", ratio.alias("balance_neg_days_ratio"), "balance_min", F.try_divide("total", "days").alias("balance_mean"))


def consumer_state(tx: DataFrame, buckets: str = "calendar", partitions: int | None = None) -> DataFrame:
    """All partials of each consumer from prepared transactions: one shuffle by consumer."""
    dealt = tx.repartition(partitions, ID) if partitions else tx
    total = F.sum("amount_abs").over(Window.partitionBy(ID, "category"))
    dealt = with_gaps(dealt).withColumn("category_total", total)
    return consumer_partials(monthly_partials(dealt, buckets))


def check_categories(tx: DataFrame, requested: list[str]) -> None:
    """Raise ValueError for pivot columns of categories that no transaction of their window has."""
    wanted = {(p, k): f"{p}_cat_{k}" for p, (ks, _) in PIVOTS.items() for k in ks if any(r.startswith(f"{p}_cat_{k}_") for r in requested)}
    if not wanted:
        return
    seen = tx.agg(*[F.max(F.when(_within(PIVOTS[p][1]) & (F.col("category") == k), 1)).alias(n) for (p, k), n in wanted.items()]).collect()[0]
    missing = [r for r in requested if any(r.startswith(f"{n}_") and seen[n] is None for n in wanted.values())]
    if missing:
        raise ValueError(f"Requested features were not produced: {missing}")


def build_feature_frame(
    consumers: DataFrame, transactions: DataFrame, feature_sets: list[str], extra_features: list[str] | None = None,
    *, strict: bool = True, month_buckets: str = "calendar",
) -> DataFrame:
    """id, target, evaluation date and the requested features, in order; a row for each consumer.

    strict looks for categories that are absent altogether, which costs one aggregation. month_buckets: calendar,
    or pandas2 for the historical arithmetic by which all months count as recent.
    """
    requested = resolve_feature_names(feature_sets, extra_features)
    made = features()
    unknown = [r for r in requested if r not in made and r not in SPECTRA and r not in BALANCES]
    if unknown:
        raise ValueError(f"Requested features were not produced: {unknown}")
    tx = prepare(consumers, transactions)
    if strict:
        check_categories(tx, requested)
    base = consumers.withColumn("total_balance", clean(F.col("total_balance"))).join(consumer_state(tx, month_buckets), ID, "left")
    series = [s for s in SERIES if any(r.startswith(f"fft_{s}_") for r in requested)]
    if series:
        base = base.withColumns({f"amp_{s}": amplitudes(s) for s in series})
        made = made | reduce(lambda a, s: a | spectrum(s), series, {})
    cols = [made[r].alias(r) for r in requested if r in made]
    if any(r in BALANCES for r in requested):
        wide = base.select(ID, TARGET, EVAL, *cols).join(balance_features(consumers, tx), ID, "left")
        return wide.select(ID, TARGET, EVAL, *requested)
    return base.select(ID, TARGET, EVAL, *cols)
