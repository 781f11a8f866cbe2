"""The reference operators' queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalar import ID
from tallyspark.operators import features as fx
from tallyspark.operators.feature_sets import resolve_feature_names
from tallyspark.plans import model_queries, sql
from tallyspark.sources.ledger import event_ledger, order_ledger, report

#: Features of each query.
FAMILIES: dict[str, list[str]] = {
    "agg_history": "amount_mean amount_std amount_abs_mean amount_abs_max inflow_sum".split(),
    "agg_windows": [f"{k}_{d}d" for d in (7, 30) for k in ("inflow_sum", "txn_count")] + ["txn_count_90d"],
    "category_pivot_all": [f"all_cat_{k}_{w}" for k in (3, 12, 26) for w in ("count", "amount")],
    "category_pivot_d30": [f"d30_cat_{k}_amount" for k in (3, 12, 23, 26)],
    "category_pivot_d90": [f"d90_cat_{k}_{w}" for k in (3, 10, 12, 23, 26) for w in ("count", "amount")],
    "spending_ratios": """inflow_to_balance_ratio outflow_to_balance_ratio outflow_to_inflow_ratio recent_7d_to_30d_txn_ratio
        recent_30d_to_90d_txn_ratio cc_payment_amount_share gen_merch_avg_txn_amount""".split(),
    "income_gaps": ["inflow_gap_mean", "inflow_gap_cv"],
    "inflow_monthly_min": ["inflow_monthly_min"],
    "history_recency": ["history_days", "recency_days"],
    "trend_slopes": [f"ts_{s}_{x}" for s in fx.SERIES for x in ("slope", "slope_norm")] + ["ts_inflow_r2"],
    "second_differences": [f"ts_{s}_d2_mean" for s in fx.SERIES],
    **{f"fft_{s}": [f"fft_{s}_{x}" for x in fx.SPECTRUM] for s in fx.SERIES},
    "risk_velocity": [f"risk_velocity_{x}_recent" for x in ("inflow", "outflow", "txn")],
    "risk_monthly": "risk_overdraft_months_ratio risk_max_inflow_to_mean risk_inflow_monthly_skew risk_months_no_inflow_ratio".split(),
    "risk_recent_ratio": "risk_last3m_inflow_vs_prior3m risk_last3m_outflow_vs_prior3m risk_outflow_to_inflow_last3m".split(),
    "risk_mix": "risk_round_amount_ratio risk_weekend_txn_ratio risk_late_month_txn_ratio".split(),
    "risk_hhi": ["risk_category_hhi"],
    "risk_gap_norm": ["risk_inflow_gap_max_norm"],
    "balance_features": list(fx.BALANCES),
    "feature_frame_44": resolve_feature_names(["ledger_44"]),
    "feature_frame_56": resolve_feature_names(["ledger_56"]),
    "feature_frame_60": resolve_feature_names(["ledger_60"]),
}
_EVENT = {"event_windows": FAMILIES["agg_windows"], "event_gaps": FAMILIES["income_gaps"], "event_history": FAMILIES["history_recency"], "event_balance": list(fx.BALANCES)}


def _query(names, ledger):
    def run(spark, sf_dir):
        out = fx.build_feature_frame(*ledger(spark, sf_dir), [], names, strict=False)
        return out.select(ID, *[F.col(n).cast("double").alias(n) for n in names])

    return run


def _prepare(ledger):
    def run(spark, sf_dir):
        tx = fx.prepare(*ledger(spark, sf_dir))
        return tx.groupBy(ID).agg(F.count("*").alias("n_rows"), F.sum("amount_abs").alias("abs_sum"), F.sum("inflow_amount").alias("inflow_sum"), F.sum("days_before").alias("days_sum"))

    return run


_PREPARE = "select id as masked_consumer_id, count(*) as n_rows, sum(a) as abs_sum, sum(inf) as inflow_sum, cast(sum(d) as bigint) as days_sum from tx group by id"


def _months(spark, sf_dir):
    tx = fx.prepare(*order_ledger(spark, sf_dir))
    return tx.groupBy(ID, "month").agg(F.sum("inflow_amount").alias("inflow"), F.sum("outflow_amount").alias("outflow"), F.sum("amount").alias("net"))


def _daily(spark, sf_dir):
    consumers, tx = order_ledger(spark, sf_dir)
    return fx.daily_balance(consumers, fx.prepare(consumers, tx))


def _validation(spark, sf_dir):
    return report(order_ledger(spark, sf_dir)[0], "evaluation_date", "total_balance", "FPF_TARGET")


QUERIES = {
    "prepare_cutoff": _prepare(order_ledger),
    "event_prepare": _prepare(event_ledger),
    **{k: _query(v, order_ledger) for k, v in FAMILIES.items()},
    **{k: _query(v, event_ledger) for k, v in _EVENT.items()},
    "monthly_series": _months,
    "daily_balance": _daily,
    "validation_report": _validation,
    **model_queries.QUERIES,
}
SQL = {
    "prepare_cutoff": sql.select(_PREPARE),
    "event_prepare": sql.select(_PREPARE, sql.EVENTS),
    **{k: sql.features(v) for k, v in FAMILIES.items()},
    **{k: sql.features(v, sql.EVENTS) for k, v in _EVENT.items()},
    "monthly_series": sql.select("select id as masked_consumer_id, month, inflow, outflow, net from mon"),
    "daily_balance": sql.select("select id as masked_consumer_id, date + cast(k as integer) as date, balance from (select id, date, balance, unnest(range(days)) as k from step)"),
    "validation_report": sql.select("""select count(*) as n_rows, cast(sum(case when id is null or length(id) < 3 then 1 else 0 end) as bigint) as bad_ids,
        cast(sum(case when eval is null then 1 else 0 end) as bigint) as bad_dates, cast(sum(case when isinf(bal) then 1 else 0 end) as bigint) as infinite,
        count(id) - count(distinct id) as repeated_ids, cast(sum(case when y is not null and y not in (0, 1) then 1 else 0 end) as bigint) as bad_labels from cons"""),
    **model_queries.SQL,
}
