"""SQL for the catalog's queries, written from the features' definitions."""

from __future__ import annotations


# Fixed values of the features' definitions, written out here so that the SQL checks the plans' own.
PIVOTS = {"all": ((3, 12, 26), None), "d30": ((3, 12, 23, 26), 30), "d90": ((3, 10, 12, 23, 26), 90)}
SERIES = ("inflow", "outflow", "net")

_CODES = "case (l_partkey + l_linenumber) % 8 when 0 then 3 when 1 then 10 when 2 then 12 when 3 then 16 when 4 then 23 when 5 then 26 when 6 then 18 else 31 end"
_KEY = "'C0' || cast({0} % 3 + 1 as varchar) || '_' || lpad(cast({0} as varchar), 8, '0')"

ORDERS = f"""
cons as (select {_KEY.format("c_custkey")} as id, cast(date '2000-06-30' - cast(c_custkey % 90 as integer) as timestamp) as eval, c_acctbal as bal,
  case when c_custkey % 17 = 0 then null when (c_custkey * 7919) % 10 < 3 then 1.0 else 0.0 end as y from customer),
raw as (select {_KEY.format("o_custkey")} as id, l_orderkey || '-' || l_linenumber as txn, l_shipdate as posted, {_CODES} as cat,
  case when {_CODES} in (3, 10) then 1 else -1 end * (l_extendedprice * (1 - l_discount)) as amount from lineitem join orders on l_orderkey = o_orderkey),
"""
EVENTS = f"""
cons as (select {_KEY.format("user_id")} as id, timestamp '2024-01-25 12:00:00' as eval, cast(user_id * 37 % 2000 - 500 as double) as bal, cast(null as double) as y
  from (select distinct user_id from events)),
raw as (select {_KEY.format("user_id")} as id, cast(event_id as varchar) as txn, ts as posted, case event_type when 'signup' then 3 when 'click' then 10
  when 'view' then 12 when 'error' then 23 when 'purchase' then 26 end as cat, case when event_type in ('purchase', 'error') then -value else value end as amount from events),
"""
_E = "0.000001"


def _agg() -> str:
    out = []
    for w in (7, 30, 90):
        out += [f"count(case when d <= {w} then txn end) as c{w}", f"sum(case when d <= {w} then inf end) as in{w}", f"sum(case when d <= {w} then outf end) as out{w}", f"sum(case when d <= {w} then 1 else 0 end) as r{w}"]
    for p, (cats, days) in PIVOTS.items():
        when = f"d <= {days}" if days else "true"
        out.append(f"sum(case when {when} and cat in {cats} then 1 else 0 end) as {p}_rows")
        for k in cats:
            out += [f"count(case when {when} and cat = {k} then txn end) as {p}_{k}_count", f"sum(case when {when} and cat = {k} then a else 0 end) as {p}_{k}_amount"]
    return ", ".join(out)


BODY = f"""
tx as (select raw.id, eval, txn, posted, cat, amount, abs(amount) as a, greatest(amount, 0) as inf, greatest(-amount, 0) as outf,
  date_sub('day', posted, eval) as d, cast(date_trunc('month', posted) as date) as month,
  floor(date_diff('day', cast(date_trunc('month', posted) as date), cast(date_trunc('month', eval) as date)) / 30) as ago from raw join cons on raw.id = cons.id where posted <= eval),
agg as (select id, avg(amount) as amount_mean, stddev_samp(amount) as amount_std, avg(a) as amount_abs_mean, max(a) as amount_abs_max, sum(inf) as inflow_sum,
  sum(outf) as outs, sum(case when cat = 26 then a else 0 end) as cc, sum(case when cat = 16 then a else 0 end) as gm, count(case when cat = 16 then txn end) as gmn,
  min(posted) as first, max(posted) as last, max(eval) as ev, count(txn) as n, sum(a) as total_abs,
  sum(case when a % 50 < {_E} or a % 100 < {_E} then 1 else 0 end) as rounds, sum(case when isodow(posted) >= 6 then 1 else 0 end) as weekend,
  sum(case when day(posted) >= 25 then 1 else 0 end) as late, sum(case when ago < 3 then inf end) as l3i, sum(case when ago < 3 then outf end) as l3o,
  sum(case when ago >= 3 and ago < 6 then inf end) as p3i, sum(case when ago >= 3 and ago < 6 then outf end) as p3o, {_agg()} from tx group by id),
pos as (select id, posted, inf, month, date_sub('day', lag(posted) over (partition by id order by posted), posted) as gap from tx where inf > 0),
gaps as (select id, avg(gap) as gmean, stddev_samp(gap) as gstd, max(gap) as gmax from pos group by id),
pmin as (select id, min(s) as inflow_monthly_min from (select id, month, sum(inf) as s from pos group by id, month) group by id),
hhi as (select h.id, sum((s / (total_abs + {_E})) * (s / (total_abs + {_E}))) as risk_category_hhi from (select id, cat, sum(a) as s from tx where cat is not null group by id, cat) h join agg on agg.id = h.id group by h.id),
mon as (select id, month, sum(inf) as inflow, sum(outf) as outflow, sum(amount) as net from tx group by id, month),
ser as (select id, month, 'inflow' as s, inflow as v from mon union all select id, month, 'outflow', outflow from mon union all select id, month, 'net', net from mon),
num as (select id, s, v, row_number() over (partition by id, s order by month) - 1 as x, count(*) over (partition by id, s) as n, avg(v) over (partition by id, s) as my,
  v - 2 * lag(v) over (partition by id, s order by month) + lag(v, 2) over (partition by id, s order by month) as d2 from ser),
fit as (select id, s, max(n) as n, max(my) as my, sum((x - (n - 1) / 2.0) * (v - my)) as sxy, sum((x - (n - 1) / 2.0) * (x - (n - 1) / 2.0)) as sxx, sum((v - my) * (v - my)) as syy, avg(d2) as d2 from num group by id, s),
tr as (select id, s, case when n >= 2 then sxy / (sxx + {_E}) end as slope, case when n >= 2 then sxy / (sxx + {_E}) / (my + {_E}) end as slope_norm,
  case when n >= 2 then sxy * sxy / (sxx * syy + {_E} + {_E}) end as r2, case when n >= 3 then d2 end as d2_mean from fit),
amp as (select id, s, k, sqrt(re * re + im * im) as amp from (select id, s, k, sum((v - my) * cos(2 * pi() * ((k * x) % n) / n)) as re, sum((v - my) * sin(2 * pi() * ((k * x) % n) / n)) as im
  from num join (select unnest(range(1, 500)) as k) on k <= n / 2.0 where n >= 3 group by id, s, k)),
ampt as (select id, s, k, amp, sum(amp) over (partition by id, s) + {_E} as t, max(amp) over (partition by id, s) as top, row_number() over (partition by id, s order by amp desc) as r from amp),
fft as (select id, s, max(top / t) as dom_power_ratio, -sum(amp / t * ln(amp / t + {_E})) as spectral_entropy, cast(min(case when amp >= top * (1 - 1e-9) then k end) as double) as dom_freq_idx,
  sum(case when k <= 2 then amp else 0 end) / max(t) as low_freq_ratio, sum(case when r <= 2 then amp else 0 end) / max(t) as top2_power_ratio from ampt group by id, s),
mstat as (select id, count(*) as months, avg(case when outflow > inflow then 1.0 else 0.0 end) as overdraft, avg(inflow) as mi, max(inflow) as xi, sum(case when inflow > 0 then 1 else 0 end) as pm from mon group by id),
skw as (select mon.id, case when count(*) >= 3 and sum((inflow - mi) * (inflow - mi)) > 0 then avg((inflow - mi) * (inflow - mi) * (inflow - mi)) / pow(avg((inflow - mi) * (inflow - mi)), 1.5) end as sk from mon join mstat on mon.id = mstat.id group by mon.id),
dayn as (select id, cast(posted as date) as date, sum(amount) as net, max(cast(eval as date)) as ed from tx group by id, cast(posted as date)),
step as (select dayn.id, date, bal - coalesce(sum(net) over (partition by dayn.id order by date rows between 1 following and unbounded following), 0) as balance,
  coalesce(lead(date) over (partition by dayn.id order by date), ed + 1) - date as days from dayn join cons on cons.id = dayn.id),
bal as (select id, cast(sum(case when balance < 0 then days else 0 end) as bigint) as balance_neg_days, sum(case when balance < 0 then days else 0 end) / cast(greatest(sum(case when balance is not null then days else 0 end), 1) as double) as balance_neg_days_ratio,
  min(balance) as balance_min, sum(balance * days) / sum(days) as balance_mean from step group by id)
"""


def _expressions() -> dict[str, str]:
    e, hist, life = _E, "date_sub('day', agg.first, ev)", "greatest(date_sub('day', agg.first, ev), 1)"
    some = lambda r, x: f"case when {r} > 0 then {x} end"
    out = {c: f"agg.{c}" for c in ("amount_mean", "amount_std", "amount_abs_mean", "amount_abs_max", "inflow_sum")}
    out |= {
        "total_balance": "bal", "inflow_monthly_min": "inflow_monthly_min", "risk_category_hhi": "risk_category_hhi",
        "inflow_to_balance_ratio": f"inflow_sum / (abs(bal) + 1.0 + {e})", "outflow_to_balance_ratio": f"coalesce(outs, 0.0) / (abs(bal) + 1.0 + {e})",
        "outflow_to_inflow_ratio": f"coalesce(outs, 0.0) / (inflow_sum + {e})", "recent_7d_to_30d_txn_ratio": f"{some('r7', 'c7')} / ({some('r30', 'c30')} + {e})",
        "recent_30d_to_90d_txn_ratio": f"{some('r30', 'c30')} / ({some('r90', 'c90')} + {e})", "cc_payment_amount_share": f"coalesce(cc, 0.0) / (coalesce(outs, 0.0) + {e})",
        "gen_merch_avg_txn_amount": f"coalesce(gm, 0.0) / (coalesce(gmn, 0) + {e})", "inflow_gap_mean": "gmean", "inflow_gap_cv": f"gstd / (gmean + {e})",
        "history_days": f"greatest({hist}, 0)", "recency_days": "greatest(date_sub('day', agg.last, ev), 0)",
        "risk_overdraft_months_ratio": "overdraft", "risk_max_inflow_to_mean": f"xi / (mi + {e})", "risk_inflow_monthly_skew": "sk", "risk_months_no_inflow_ratio": f"(months - pm) / (months + {e})",
        "risk_last3m_inflow_vs_prior3m": f"l3i / (coalesce(p3i, {e}) + {e})", "risk_last3m_outflow_vs_prior3m": f"l3o / (coalesce(p3o, {e}) + {e})", "risk_outflow_to_inflow_last3m": f"l3o / (l3i + {e})",
        "risk_round_amount_ratio": f"rounds / (agg.n + {e})", "risk_weekend_txn_ratio": f"weekend / (agg.n + {e})", "risk_late_month_txn_ratio": f"late / (agg.n + {e})", "risk_inflow_gap_max_norm": f"gmax / ({life} + {e})",
    }
    # NULL - NULL, not greatest(NULL, 0), for consumers without transactions
    for k in ("history_days", "recency_days", "risk_inflow_gap_max_norm"):
        out[k] = f"case when agg.first is not null then {out[k]} end"
    for w in (7, 30, 90):
        out[f"txn_count_{w}d"], out[f"inflow_sum_{w}d"] = some(f"r{w}", f"c{w}"), some(f"r{w}", f"in{w}")
    for name, recent, whole in (("inflow", "in30", "inflow_sum"), ("outflow", "out30", "outs"), ("txn", "c30", "agg.n")):
        out[f"risk_velocity_{name}_recent"] = f"{some('r30', recent)} / (30 + {e}) / ({whole} / ({life} + {e}) + {e})"
    for p, (cats, _) in PIVOTS.items():
        for k in cats:
            for what in ("count", "amount"):
                out[f"{p}_cat_{k}_{what}"] = some(f"{p}_rows", f"{p}_{k}_{what}")
    for s in SERIES:
        out |= {f"ts_{s}_{x}": f"tr_{s}.{x}" for x in ("slope", "slope_norm", "r2", "d2_mean")}
        out |= {f"fft_{s}_{x}": f"fft_{s}.{x}" for x in ("dom_power_ratio", "spectral_entropy", "dom_freq_idx", "low_freq_ratio", "top2_power_ratio")}
    return out | {c: f"bal.{c}" for c in ("balance_neg_days", "balance_neg_days_ratio", "balance_min", "balance_mean")}


def features(names: list[str], ledger: str = ORDERS) -> str:
    made = _expressions()
    joins = ["agg", "gaps", "pmin", "hhi", "mstat", "skw", "bal"]
    text = "".join(f" left join {t} on {t}.id = cons.id" for t in joins)
    for s in SERIES:
        if any(n.startswith(f"ts_{s}") for n in names):
            text += f" left join (select * from tr where s = '{s}') tr_{s} on tr_{s}.id = cons.id"
        if any(n.startswith(f"fft_{s}") for n in names):
            text += f" left join (select * from fft where s = '{s}') fft_{s} on fft_{s}.id = cons.id"
    # the balance column and the balance table share a name
    body = BODY.replace("\nbal as (", "\nbalances as (")
    text = text.replace(" left join bal on bal.id", " left join balances on balances.id")
    picked = ", ".join(f"cast({made[n].replace('bal.balance', 'balances.balance')} as double) as {n}" for n in names)
    picked = picked.replace("cast(bal as double)", "cast(cons.bal as double)").replace("abs(bal)", "abs(cons.bal)")
    return f"with {ledger}{body} select cons.id as masked_consumer_id, {picked} from cons{text}"


def select(what: str, ledger: str = ORDERS) -> str:
    return f"with {ledger}{BODY} {what}"
