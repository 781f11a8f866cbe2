"""Queries of splits, sampling, weights, blending and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalar import ID, TARGET, client
from tallyspark.operators import evaluation, moe, sampling
from tallyspark.plans import sql
from tallyspark.sources.ledger import order_consumers

SEED = 42


def _labelled(spark, sf_dir):
    return order_consumers(spark, sf_dir).where(F.col(TARGET).isNotNull()).withColumn("score", F.floor("total_balance").cast("double") % 97 / 97)


def _split(spark, sf_dir):
    return sampling.split_manifest(sampling.split_622(_labelled(spark, sf_dir), SEED))


def _down(spark, sf_dir):
    return sampling.downsample_negatives(_labelled(spark, sf_dir), 0.2, SEED).select(ID, TARGET)


def _augmented(spark, sf_dir):
    df = _labelled(spark, sf_dir).select(ID, TARGET, "total_balance", "score")
    return sampling.augment_clients(df, ["total_balance", "score"], 2.0, 5, SEED)


def _smote(spark, sf_dir):
    return _augmented(spark, sf_dir).groupBy(client().alias("client"), F.col(TARGET).alias("label")).agg(F.count("*").alias("n"))


def _smote_features(spark, sf_dir):
    by = [client().alias("client"), F.col(TARGET).alias("label"), F.contains(F.col(ID), F.lit("#")).alias("synthetic")]
    x = F.col("total_balance")
    return _augmented(spark, sf_dir).groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("balance_sum"), F.sum(x * x).alias("balance_squares"), F.sum("score").alias("score_sum"))


def _smote_rows(spark, sf_dir):
    made = _augmented(spark, sf_dir).where(F.contains(F.col(ID), F.lit("#")))
    return made.select(ID, F.round("total_balance", 6).alias("total_balance"), F.round("score", 6).alias("score"))


def _weights(spark, sf_dir):
    w = sampling.sample_weights({"sample_weight": True, "downsample_negative_keep_ratio": 0.2, "smote_positive_multiplier": 2.0})
    return _labelled(spark, sf_dir).select(ID, w.alias("weight"))


def _blend(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    router = {"C01": F.col("score") / 2 + 0.1, "C02": F.lit(0.3), "C03": F.lit(0.6) - F.col("score") / 2}
    experts = {"C01": F.col("score"), "C03": F.lit(1.0) - F.col("score")}
    return df.select(ID, moe.blend(router, experts).alias("risk"))


def _group_auc(spark, sf_dir):
    return evaluation.auc_by(_labelled(spark, sf_dir).withColumn("client", client()), ["client"])


def _pooled(spark, sf_dir):
    return evaluation.auc_by(_labelled(spark, sf_dir).withColumn("pool", F.lit(0)), ["pool"])


def _client_mean(spark, sf_dir):
    each = evaluation.auc_by(_labelled(spark, sf_dir).withColumn("client", client()), ["client"])
    return evaluation.group_mean(each.withColumn("pool", F.lit(0)), ["pool"]).select(F.col("auc").alias("group_auc"))


REPEATS = 5


def _repeats(spark, sf_dir):
    """The pooled AUC as it is and of each repeat of permuting the score."""
    df = _labelled(spark, sf_dir)
    base = evaluation.auc_by(df.withColumn("pool", F.lit(0)), ["pool"]).select("pool", F.col("auc").alias("base"))
    each = evaluation.auc_by(evaluation.permuted(df.select(ID, TARGET, "score"), "score", SEED, range(REPEATS)), ["_repeat"])
    return each.withColumn("pool", F.lit(0)).join(F.broadcast(base), "pool").select(F.col("_repeat").alias("repeat"), "base", (F.col("base") - F.col("auc")).alias("drop"))  # one row


def _drop(spark, sf_dir):
    return _repeats(spark, sf_dir).where("repeat = 0").select("base", F.col("drop").alias("auc_drop"))


def _importance(spark, sf_dir):
    r = _repeats(spark, sf_dir)
    return r.agg(F.avg("drop").alias("mean_auc_drop"), F.stddev_pop("drop").alias("std_auc_drop"))


QUERIES = {
    "split_manifest": _split, "downsample": _down, "smote_counts": _smote, "smote_features": _smote_features, "sample_weights": _weights, "soft_routing_blend": _blend,
    "group_auc": _group_auc, "pooled_auc": _pooled, "permutation_drop": _drop, "smote_rows": _smote_rows, "mean_group_auc": _client_mean,
    "permutation_importance": _importance,
}

_LAB = "lab as (select id, y, bal, substr(id, 1, 3) as client, (floor(bal) % 97) / 97 as score from cons where y is not null)"
_RANK = "sum(case when y = 1 then 1 else 0 end) * sum(case when y = 0 then 1 else 0 end)"


def _auc_sql(key: str, src: str, score: str) -> str:
    return f"""select {key}, (sum(case when y = 1 then rk else 0 end) - sum(case when y = 1 then 1 else 0 end) * (sum(case when y = 1 then 1 else 0 end) + 1) / 2.0) / ({_RANK}) as auc
      from (select {key}, y, rank() over (partition by {key} order by {score}) + (count(*) over (partition by {key}, {score}) - 1) / 2.0 as rk from {src}) group by {key}
      having sum(case when y = 1 then 1 else 0 end) > 0 and sum(case when y = 0 then 1 else 0 end) > 0"""


_WITH = f"with {sql.ORDERS}{_LAB}"
_QUOTA = """
q0 as (select client, y, count(*) as n from lab group by client, y),
q1 as (select *, ceil(sum(n) over (partition by client) * 0.2 - 1e-9) as tot, n * ceil(sum(n) over (partition by client) * 0.2 - 1e-9) / sum(n) over (partition by client) as ex from q0),
q2 as (select *, floor(ex) + case when row_number() over (partition by client order by ex - floor(ex) desc, y) <= tot - sum(floor(ex)) over (partition by client) then 1 else 0 end as nt from q1),
q3 as (select *, n - nt as rest from q2),
q4 as (select *, ceil(sum(rest) over (partition by client) * 0.25 - 1e-9) as tot2, rest * ceil(sum(rest) over (partition by client) * 0.25 - 1e-9) / sum(rest) over (partition by client) as ex2 from q3),
q5 as (select client, y, nt, floor(ex2) + case when row_number() over (partition by client order by ex2 - floor(ex2) desc, y) <= tot2 - sum(floor(ex2)) over (partition by client) then 1 else 0 end as nv from q4),
rk as (select id, client, y, row_number() over (partition by client, y order by md5(id || '|42'), id) as r from lab)
"""
_UNIT = "cast(cast('0x' || substr(md5(j || '|{0}|42'), 1, 12) as bigint) as double) / 281474976710656"
_SMOTE = f"""
pos as (select id, client, coalesce(bal, 0.0) as x, score as z, row_number() over (partition by client order by md5(id || '|42'), id) - 1 as i
  from (select id, client, bal, y, score from lab) where y = 1),
sizes as (select client, count(*) as n, cast(round_even(count(*) * 2.0, 0) as bigint) - count(*) as extra, least(5, count(*) - 1) as k from pos group by client having count(*) >= 2),
draws as (select client, j, cast(floor({_UNIT.format('base')} * n) as bigint) as i, cast(floor({_UNIT.format('pick')} * k) as bigint) + 1 as pick, {_UNIT.format('alpha')} as alpha
  from (select client, n, k, unnest(range(extra)) as j from sizes)),
near as (select d.client, d.j, d.alpha, d.pick, b.id, b.x as bx, o.x as ox, b.z as bz, o.z as oz,
  row_number() over (partition by d.client, d.j order by (b.x - o.x) * (b.x - o.x) + (b.z - o.z) * (b.z - o.z), o.id) as r
  from draws d join pos b on b.client = d.client and b.i = d.i join pos o on o.client = d.client and o.id <> b.id),
made as (select id || '#s' || j as id, client, bx + alpha * (ox - bx) as x, bz + alpha * (oz - bz) as z from near where r = pick),
every as (select client, y, false as synthetic, coalesce(bal, 0.0) as x, score as z from lab
  union all select client, 1.0, true, x, z from made)
"""
_REPEATS = f"""
one as (select 0 as pool, * from lab), a as (select row_number() over (order by md5(id || '|row|42'), id) as r, y from lab),
b as (select t, row_number() over (partition by t order by md5(id || '|score|' || t || '|42'), id) as r, score from lab, range(5) as ts(t)),
mix as (select t, y, score from a join b on a.r = b.r),
drops as (select z.t as repeat, x.auc as base, x.auc - z.auc as drop from ({_auc_sql('pool', 'one', 'score')}) x, ({_auc_sql('t', 'mix', 'score')}) z)
"""
SQL = {
    "split_manifest": f"{_WITH}, {_QUOTA} select id as masked_consumer_id, rk.client, case when r <= nt then 'test' when r <= nt + nv then 'validation' else 'train' end as split from rk join q5 on rk.client = q5.client and rk.y = q5.y",
    "downsample": f"""{_WITH}, r as (select *, count(*) over (partition by y) as n, row_number() over (partition by y order by md5(id || '|42'), id) as k from lab)
      select id as masked_consumer_id, cast(y as double) as "FPF_TARGET" from r where y = 1 or k <= round_even(n * 0.2, 0)""",
    "smote_counts": f"{_WITH}, {_SMOTE} select client, cast(y as double) as label, count(*) as n from every group by client, y",
    "smote_features": f"{_WITH}, {_SMOTE} select client, cast(y as double) as label, synthetic, count(*) as n, sum(x) as balance_sum, sum(x * x) as balance_squares, sum(z) as score_sum from every group by client, y, synthetic",
    "smote_rows": f"{_WITH}, {_SMOTE} select id as masked_consumer_id, round(x, 6) as total_balance, round(z, 6) as score from made",
    "mean_group_auc": f"{_WITH} select avg(auc) as group_auc from ({_auc_sql('client', 'lab', 'score')})",
    "permutation_importance": f"{_WITH}, {_REPEATS} select avg(drop) as mean_auc_drop, stddev_pop(drop) as std_auc_drop from drops",
    "sample_weights": f"{_WITH} select id as masked_consumer_id, case when y = 0 then 1 / 0.2 else 0.5 end as weight from lab",
    "soft_routing_blend": f"{_WITH} select id as masked_consumer_id, ((score / 2 + 0.1) * score + (0.6 - score / 2) * (1 - score)) / greatest(0.7, 1e-9) as risk from lab",
    "group_auc": f"{_WITH} {_auc_sql('client', 'lab', 'score')}",
    "pooled_auc": f"{_WITH}, one as (select 0 as pool, * from lab) {_auc_sql('pool', 'one', 'score')}",
    "permutation_drop": f"{_WITH}, {_REPEATS} select base, drop as auc_drop from drops where repeat = 0",
}
