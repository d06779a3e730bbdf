"""Queries of market statistics, residuals, trailing sums, ensembles, overlays and regimes, with oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions.frames import safe_div
from panelloom.operators import daily, evaluation as ev, factors, panel as pan, portfolio as pf, statistics as st
from panelloom.plans import oracle as q
from panelloom.plans import panel_queries as p
from panelloom.plans.factor_queries import prepared, rounded
from panelloom.sources import bars as src


def _market_months(s, d):
    """month, spx_ret_k, spx_vol_63d at each month's last market day."""
    m = src.market_of(src.table(s, d, "lineitem"))
    last = Window.orderBy("date").rowsBetween(-62, 0)
    m = m.withColumn("spx_vol_63d", F.when(F.count("m").over(last) >= 21, F.stddev_samp("m").over(last) * F.sqrt(F.lit(252.0))))
    ends = m.groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("level", "date").alias("level"), F.max_by("spx_vol_63d", "date").alias("spx_vol_63d"))
    by = Window.orderBy("month")
    return ends.withColumns({f"spx_ret_{k}m": F.col("level") / F.lag("level", k).over(by) - 1 for k in (1, 3, 6, 12)})


def market_months(s, d):
    return rounded(_market_months(s, d))


def residual_features(s, d):
    """Month-end returns without the market's part, and risk against what beta implies."""
    ends = factors.months(prepared(s, d), ["ret_1m", "ret_12m"], (daily.market_beta, daily.volatility), ["beta_252d", "vol_21d"])
    rows = ends.join(F.broadcast(_market_months(s, d)), "month")
    b = F.coalesce("beta_252d", F.lit(1.0))
    implied = F.abs("beta_252d") * F.col("spx_vol_63d")
    return rounded(rows.select("instrument", "month", (F.col("ret_1m") - b * F.col("spx_ret_1m")).alias("residual_ret_1m"), (F.col("ret_12m") - b * F.col("spx_ret_12m")).alias("residual_ret_12m"), (F.col("vol_21d") / (implied + 1e-9) - 1).alias("vol_excess")), 4)


def beta_interactions(s, d):
    """Month-end products and differences of betas: risk of both kinds, and beta in rising against falling markets."""
    daily = factors.market_beta(prepared(s, d)).select("instrument", "date", "close", "beta_252d", "idio_vol_252d", "up_beta_63d", "down_beta_63d")
    ends = src.month_ends(daily)
    return rounded(ends.select("instrument", "month", (F.abs("beta_252d") * F.col("idio_vol_252d")).alias("beta_x_idiovol"), (F.col("up_beta_63d") - F.col("down_beta_63d")).alias("up_down_beta_spread")), 4)


def ttm_sums(s, d):
    """Trailing four quarters of order value per customer, of four at least, and growth over four quarters before."""
    quarter = F.trunc("o_orderdate", "quarter")
    rows = src.table(s, d, "orders").groupBy("o_custkey", quarter.alias("quarter")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    w = Window.partitionBy("o_custkey").orderBy("quarter")
    four = w.rowsBetween(-3, 0)
    ttm = F.when(F.count("value").over(four) >= 4, F.sum("value").over(four))
    rows = rows.withColumn("ttm", ttm)
    return rounded(rows.withColumn("growth", safe_div(F.col("ttm"), F.lag("ttm", 4).over(w)) - 1), 4)


def log_size(s, d):
    """ln of a month's money and its shortfall against the largest."""
    w = p.weights(s, d)
    return rounded(w.select("month", "instrument", F.log("value").alias("log_mktcap"), (F.log("value") - F.max(F.log("value")).over(Window.partitionBy("month"))).alias("rel_size")))


def ensemble_score(s, d):
    """60, 20 and 20 % of three z-scores; missing ones count as 0."""
    z = lambda c: F.coalesce(pan.cs_zscore(F.col(c)), F.lit(0.0))
    return rounded(p.panel(s, d).select("month", "instrument", (0.6 * z("mom_accel") + 0.2 * z("vol_20d") + 0.2 * z("hl_range")).alias("score")))


def pitch_overlay(s, d):
    book = pf.tilt_by_score(p.scored(s, d), 0.004, p.LEAST)
    best = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("score"), "instrument"))
    picks = book.withColumn("_k", best).filter(F.col("_k") <= 5).select("month", "instrument")
    return rounded(pf.overlay(book, picks, 0.002).select("month", "instrument", "pitch_w"), 8)


def benchmark_regression(s, d):
    return rounded(pf.against_benchmark(pf.backtest(pf.tilt_by_score(p.scored(s, d), 0.004, p.LEAST))), 5)


def strategy_difference(s, d):
    base = p.scored(s, d)
    return rounded(pf.paired_difference(pf.backtest(pf.tilt_by_score(base, 0.004, p.LEAST)), pf.backtest(pf.tilt_by_blocks(base, 0.003, 10, p.LEAST))), 5)


def stress_regimes(s, d):
    m = p.panel(s, d).groupBy("month").agg(F.round(F.avg("vol_20d"), 9).alias("vol"))
    return rounded(pf.regime_of(m, "vol", "1998-12-31"))


def rank_persistence(s, d):
    return rounded(st.rank_persistence(p.long(s, d), [1, 2, 3], p.LEAST))


def permutation_test(s, d):
    return rounded(ev.shuffle_tests(p.panel(s, d), p.FACTORS, 100, p.LEAST).select("factor", "ic_mean", "p"))


QUERIES = {f.__name__: f for f in (market_months, residual_features, beta_interactions, ttm_sums, log_size, ensemble_score, pitch_overlay, benchmark_regression, strategy_difference, stress_regimes, rank_persistence, permutation_test)}

_MM = f"""mk as (select *, case when count(m) over w >= 21 then stddev_samp(m) over w * sqrt(252) end as v from market window w as (order by date rows between 62 preceding and current row)),
me as (select date_trunc('month', date)::date as month, arg_max(level, date) as level, arg_max_null(v, date) as spx_vol_63d from mk group by 1),
mm as (select *, {', '.join(f"level / lag(level, {k}) over (order by month) - 1 as spx_ret_{k}m" for k in (1, 3, 6, 12))} from me)"""
_zz = lambda c: f"coalesce({p._z(c, 'stddev_pop')}, 0)"
_BLOCKS = f"""kb as (select *, row_number() over (partition by month order by score desc, instrument) as best, row_number() over (partition by month order by score, instrument) as worst, count(*) over (partition by month) as cnt from sc where score is not null),
bb as (select *, weight / sum(weight) over (partition by month) as bench_w from kb where cnt >= {p.LEAST}), rb as (select *, greatest(bench_w + case when best <= 10 then 0.003 when worst <= 10 then -0.003 else 0 end, 0) as raw from bb),
b2 as (select *, raw / sum(raw) over (partition by month) as port_w from rb)"""
ORACLES = {
    "market_months": f"with {q.BARS}, {q.MARKET}, {_MM} select month, {q.rounded(['level', 'spx_vol_63d', 'spx_ret_1m', 'spx_ret_3m', 'spx_ret_6m', 'spx_ret_12m'])} from mm",
    "residual_features": f"""with {p._P}, {_MM}, bd as (select instrument, date_trunc('month', date)::date as month, date, {q.beta('r', 'm', 252, 126)} as b, {q.std('r', 21, 7)} as vol_21d from base),
be as (select * from bd qualify row_number() over (partition by instrument, month order by date desc) = 1)
select instrument, month, round(ret_1m - coalesce(b, 1) * spx_ret_1m, 4) + 0 as residual_ret_1m, round(ret_12m - coalesce(b, 1) * spx_ret_12m, 4) + 0 as residual_ret_12m, round(vol_21d / (abs(b) * spx_vol_63d + 1e-9) - 1, 4) + 0 as vol_excess
from panel join be using (instrument, month) join mm using (month)""",
    "beta_interactions": f"""with {q.RETURNS}, a as (select instrument, date, r, m, {q.beta('r', 'm', 252, 126)} as b, {q.beta('case when r is not null then case when m > 0 then r else 0 end end', 'case when m is not null then greatest(m, 0) end', 63, 21)} as ub, {q.beta('case when r is not null then case when m < 0 then r else 0 end end', 'case when m is not null then least(m, 0) end', 63, 21)} as db from base),
c as (select *, {q.std('r - b * m', 252, 126)} as iv from a)
select instrument, date_trunc('month', date)::date as month, round(abs(b) * iv, 4) + 0 as beta_x_idiovol, round(ub - db, 4) + 0 as up_down_beta_spread from c qualify row_number() over (partition by instrument, date_trunc('month', date) order by date desc) = 1""",
    "ttm_sums": """with o as (select o_custkey, date_trunc('quarter', o_orderdate)::date as quarter, sum(o_totalprice::decimal(18,2))::double as value from orders group by all),
t as (select *, case when count(value) over w >= 4 then sum(value) over w end as ttm from o window w as (partition by o_custkey order by quarter rows between 3 preceding and current row))
select o_custkey, quarter, round(value, 4) + 0 as value, round(ttm, 4) + 0 as ttm, round(ttm / lag(ttm, 4) over (partition by o_custkey order by quarter) - 1, 4) + 0 as growth from t""",
    "log_size": f"with {q.BARS}, {p._W} select month, instrument, round(ln(value), 6) + 0 as log_mktcap, round(ln(value) - max(ln(value)) over (partition by month), 6) + 0 as rel_size from wt",
    "ensemble_score": f"with {p._P} select month, instrument, round(0.6 * {_zz('mom_accel')} + 0.2 * {_zz('vol_20d')} + 0.2 * {_zz('hl_range')}, 6) + 0 as score from panel",
    "pitch_overlay": f"""with {p._S}, bk as {p._tilt('0.004')}, y as (select *, row_number() over (partition by month order by score desc, instrument) <= 5 as pick from bk), x as (select *, bench_w + case when pick then 0.002 else 0 end as up from y)
select month, instrument, round(case when pick then up else bench_w * greatest(1 - coalesce(sum(up) filter (where pick) over w, 0), 0) / sum(bench_w) filter (where not pick) over w end, 8) + 0 as pitch_w from x window w as (partition by month)""",
    "benchmark_regression": f"with {p._BACK} select count(*) as months, round(covar_samp(port_ret, bench_ret) / var_samp(bench_ret), 5) + 0 as beta, round(corr(port_ret, bench_ret), 5) + 0 as corr, round(avg(port_ret) - covar_samp(port_ret, bench_ret) / var_samp(bench_ret) * avg(bench_ret), 5) + 0 as alpha from bt",
    "stress_regimes": f"""with {p._P}, m as (select month, round(avg(vol_20d), 9) as vol from panel group by month), tr as (select vol as t from m where month <= date '1998-12-31' and vol is not null),
x as (select month, vol, case when vol is not null then (select count(*) from tr where t <= vol) / (select count(*) from tr) end as stress from m)
select month, round(vol, 6) + 0 as vol, round(stress, 6) + 0 as stress, case when stress < 1/3 then 'calm' when stress > 2/3 then 'stress' when stress is not null then 'normal' end as regime from x""",
    "rank_persistence": f"""with {p._L}, nb as (select *, year(month) * 12 + month(month) as k from lf where value is not null), la as (select unnest([1, 2, 3])::int as lag),
j as (select a.factor, lag, a.month, a.value, b.value as later from nb a cross join la join nb b on b.factor = a.factor and b.instrument = a.instrument and b.k = a.k + lag),
r as (select factor, lag, month, {p._rank('value', 'factor, lag, month')} as a, {p._rank('later', 'factor, lag, month')} as b from j)
select factor, lag, round(avg(rho), 6) + 0 as rho, count(*) as n_months from (select factor, lag, month, {p._c('a', 'b')} as rho from r group by all) where rho is not null group by factor, lag""",
}
