"""Queries of tilts, regimes, resampling and strategy reports, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import portfolio as pf, riskparity
from panelloom.plans import extra_queries as x, oracle as q, panel_queries as p
from panelloom.plans.factor_queries import prepared, rounded

ALPHAS = (0.001, 0.002, 0.004, 0.008)
EXCLUDED = ("1997-06-01", "1997-09-30")
UNTIL, SIMS = "1998-12-31", 10_000


def _book(s, d):
    return pf.tilt_by_score(p.scored(s, d), 0.004, p.LEAST)


def _bt(s, d):
    """The back-test with returns to nine places, so that what is resampled is the same in both engines."""
    return pf.backtest(_book(s, d)).select("month", *[F.round(c, 9).alias(c) for c in ("active_ret", "port_ret", "bench_ret")])


def alpha_sweep(s: SparkSession, d: str) -> DataFrame:
    return rounded(pf.performance(pf.sweep(p.scored(s, d), list(ALPHAS), p.LEAST), "alpha").select("alpha", "ann_alpha", "track_err", "info_ratio"), 5)


def best_alpha(s, d):
    stats = pf.performance(pf.sweep(p.scored(s, d), list(ALPHAS), p.LEAST), "alpha")
    return rounded(pf.best_alpha(stats.withColumns({c: F.round(c, 9) for c in ("info_ratio", "track_err")}), 0.01, 0.5), 5)


def tilt_fraction(s, d):
    return rounded(pf.tilt_by_fraction(p.scored(s, d), 0.003, 0.002, 0.2, p.LEAST, 3).select("month", "instrument", "bench_w", "port_w"), 8)


def arithmetic_stats(s, d):
    return rounded(pf.arithmetic_stats(_bt(s, d)), 5)


def top_names(s, d):
    return rounded(pf.top_names(p.scored(s, d), 20))


def name_turnover(s, d):
    return rounded(pf.name_turnover(_book(s, d), 20))


def rule_regimes(s, d):
    return pf.rule_regimes(p.panel(s, d).select("month").distinct(), p.REGIMES, EXCLUDED)


def episode_state(s, d):
    return rounded(pf.episode_state(p.scored(s, d), _bt(s, d), UNTIL, p.LEAST), 4)


def bootstrap_intervals(s, d):
    """Intervals of the information ratio by circular blocks of six, by whole blocks of three, and by single months."""
    bt, out = _bt(s, d), None
    for kind, block, circular in (("circular", 6, True), ("blocks", 3, False), ("independent", 1, True)):
        one = pf.intervals(pf.information_ratios(pf.resampled(bt, "active_ret", SIMS, block, circular), compound=circular)).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)


def regime_attribution(s, d):
    return rounded(pf.regime_attribution(_bt(s, d), p.REGIMES), 5)


def return_fan(s, d):
    """Three years ahead, by drawing the book's own months."""
    return rounded(pf.fan(_bt(s, d), "active_ret"), 5)


def volatility_surface(s, d):
    swept = pf.sweep(p.scored(s, d), list(ALPHAS), p.LEAST)
    return rounded(pf.volatility_surface(swept), 6)


def before_after(s, d):
    base = p.scored(s, d)
    return rounded(pf.before_after(pf.performance(pf.backtest(pf.tilt_by_blocks(base, 0.003, 10, p.LEAST))), pf.performance(pf.backtest(pf.tilt_by_score(base, 0.004, p.LEAST)))), 5)


def tilt_adaptation(s, d):
    """Books whose tilt grows with the month's volatility, against what each brings for a unit of its tilt."""
    vol = p.panel(s, d).groupBy("month").agg(F.round(F.avg("vol_20d"), 6).alias("v")).filter("v > 0").select("month", F.round(0.001 + 0.001 * F.col("v"), 9).alias("alpha_used"))
    # one row a month
    book = pf.tilt_by_score(p.scored(s, d).join(F.broadcast(vol), "month"), F.col("alpha_used"), p.LEAST)
    bt = pf.backtest(book).select("month", F.round("active_ret", 9).alias("active_ret"))
    return rounded(pf.tilt_adaptation(bt.join(vol, "month")), 5)


def linear_bridge(s, d):
    rows = _bt(s, d).join(x._market_months(s, d).select("month", "spx_ret_1m", "spx_vol_63d"), "month")
    return rounded(pf.linear_bridge(rows, "active_ret", "spx_ret_1m", "spx_vol_63d"), 5)


def risk_parity(s, d):
    return rounded(riskparity.risk_parity(p.scored(s, d), prepared(s, d), 20), 6)


QUERIES = {f.__name__: f for f in (
    alpha_sweep, best_alpha, tilt_fraction, arithmetic_stats, top_names, name_turnover, rule_regimes, episode_state, bootstrap_intervals, regime_attribution, return_fan, volatility_surface, before_after, tilt_adaptation, linear_bridge, risk_parity,
)}

P = 2147483647
_fifth = lambda c: f"(({c}) * ({c}) % {P} * (({c}) * ({c}) % {P}) % {P} * ({c}) % {P})"


def mix(name: str, source: str, expression: str, column: str) -> str:
    """Tables that add a column to a source: the integer mixer of an expression."""
    return f"""{name}_a as (select *, (({expression})::bigint * 48271 + 11) % {P} as mx from {source}), {name}_b as (select * exclude mx, ({_fifth('mx')} * 69621 + 977) % {P} as mx from {name}_a), {name} as (select * exclude mx, {_fifth('mx')} as {column} from {name}_b)"""


def _draws(name: str, source: str, block: int, circular: bool, sims: int, keys: str = "") -> str:
    """Tables up to `name` (keys, sim, x): resamples of source (keys, month, x)."""
    k, on = (f"{keys}, ", f"partition by {keys} ") if keys else ("", "")
    blocks = f"(n + {block - 1}) // {block}" if circular else f"greatest(n // {block}, 1)"
    room = "n" if circular else f"greatest(n - {block} + 1, 1)"
    return f"""{name}_n as (select {k}x, row_number() over ({on}order by month) - 1 as pos, count(*) over ({on}) as n from {source}),
{name}_l as (select distinct {k}n from {name}_n), {name}_q as (select *, unnest(range({sims})) as sim from {name}_l), {mix(f'{name}_s', f'{name}_q', 'sim', 'sm')},
{name}_j as (select *, unnest(range({blocks})) as j from {name}_s), {mix(f'{name}_f', f'{name}_j', 'sm + j', 'first')},
{name}_k as (select {k}sim, (first % ({room}) + k) % n as pos from {name}_f cross join (select unnest(range({block})) as k) where j * {block} + k < n),
{name} as (select {k}sim, x from {name}_k join {name}_n using ({k}pos))"""


_IR = "case when stddev_samp(x) > 0 and product(1 + x) > 0 then (pow(product(1 + x), 12 / count(*)) - 1) / (stddev_samp(x) * sqrt(12)) end"
_MEAN_IR = "avg(x) * 12 / (stddev_pop(x) * sqrt(12) + 1e-8)"
_CI = "count(*) as sims, avg(ir) as mean, quantile_cont(ir, 0.025) as ci_lo, quantile_cont(ir, 0.975) as ci_hi"
_RB = f"{p._BACK}, rb as (select month, round(active_ret, 9) as active_ret, round(port_ret, 9) as port_ret, round(bench_ret, 9) as bench_ret from bt)"
_RX = f"{_RB}, rx as (select month, active_ret as x from rb)"
_SWEEP = f"with {p._S}" + "".join(f", bk{i} as {p._tilt(str(a))}, {p._bt(f'bt{i}', f'bk{i}')}" for i, a in enumerate(ALPHAS))
_EACH = " union all ".join(f"select {a}::double as alpha, * from {p._perf(f'bt{i}')}" for i, a in enumerate(ALPHAS))
_LATELY = lambda c: f"coalesce(case when count({c}) over w3 >= 2 then stddev_samp({c}) over w3 end, stddev_samp({c}) over wr, 0) * sqrt(12)"
_SCALED = lambda c: f"coalesce(greatest(least(({c} - avg({c}) filter (where month <= date '{UNTIL}') over ()) / (stddev_samp({c}) filter (where month <= date '{UNTIL}') over () + 1e-8), 5), -5), 0)"
_kinds = (("circular", 6, True), ("blocks", 3, False), ("independent", 1, True))

ORACLES = {
    "best_alpha": f"""{_SWEEP}, al as ({_EACH}), fi as (select alpha, round(info_ratio, 9) as ir from al where round(track_err, 9) between 0.01 and 0.5)
select coalesce((select alpha from fi order by ir desc, alpha limit 1), 0.01)::double as alpha, round((select max(ir) from fi), 5) + 0 as info_ratio, (select count(*) from fi) > 0 as in_range""",
    "tilt_fraction": f"""with {p._S}, k as (select *, row_number() over (partition by month order by score desc, instrument) as best, count(*) over (partition by month) as n from sc where score is not null), k2 as (select *, greatest(3, floor(n * 0.2)) as b from k where n >= {p.LEAST}),
r as (select *, greatest(weight + case when best > n - b then -0.002 when best <= b then 0.003 else 0 end, 0) as raw from k2) select month, instrument, round(weight, 8) + 0 as bench_w, round(raw / sum(raw) over (partition by month), 8) + 0 as port_w from r""",
    "arithmetic_stats": f"""with {_RB}, c as (select *, sum(active_ret) over (order by month) as c from rb), e as (select *, c - max(c) over (order by month) as d from c),
f as (select count(*) as n_months, avg(active_ret) * 12 as ann_alpha, stddev_samp(active_ret) * sqrt(12) as track_err, avg((active_ret > 0)::int) as hit_rate, min(d) as max_active_dd, avg(port_ret) * 12 / (stddev_samp(port_ret) * sqrt(12) + 1e-9) as sharpe from e)
select n_months, {q.rounded(['ann_alpha', 'track_err', 'hit_rate', 'max_active_dd', 'sharpe'], 5)}, case when track_err > 1e-9 then round(ann_alpha / track_err, 5) + 0 end as info_ratio from f where n_months >= 3""",
    "top_names": f"with {p._S}, k as (select *, row_number() over (partition by month order by score desc, instrument) as k from sc where score is not null) select month, count(*) as names, round(avg(fwd_ret_1m), 6) + 0 as ret from k where k <= 20 group by month",
    "name_turnover": f"""with {p._S}, bk as {p._tilt('0.004')}, m as (select month, lag(month) over (order by month) as before from (select distinct month from bk)), t as (select month, instrument from bk qualify row_number() over (partition by month order by port_w desc, instrument) <= 20)
select t.month, round(avg((o.instrument is null)::int), 6) + 0 as entered from t join m using (month) left join t o on o.month = m.before and o.instrument = t.instrument where before is not null group by t.month""",
    "rule_regimes": f"""with {p._P} select month, case when month between date '{EXCLUDED[0]}' and date '{EXCLUDED[1]}' then 'other' {' '.join(f"when month between date '{a}' and date '{b}' then '{n}'" for n, a, b in reversed(p.REGIMES))} else 'other' end as regime from (select distinct month from panel)""",
    "episode_state": f"""with {_RB}, z as (select month, (score - avg(score) over (partition by month)) / (stddev_pop(score) over (partition by month) + 1e-8) as z, count(score) over (partition by month) as n from sc),
g as (select month, avg(abs(z)) as signal_strength, stddev_pop(z) as signal_dispersion from z where n >= {p.LEAST} group by month),
v as (select *, round({_LATELY('bench_ret')}, 12) as bench_vol, {_LATELY('active_ret')} as rolling_te, coalesce(avg(active_ret) over w3, 0) as recent_active_ret from g join rb using (month) window w3 as (order by month rows between 2 preceding and current row), wr as (order by month rows between unbounded preceding and current row)),
u as (select *, coalesce((bench_vol > case when count(bench_vol) over wr >= 6 then quantile_cont(bench_vol, 0.5) over wr end)::int, 0)::double as regime from v window wr as (order by month rows between unbounded preceding and current row))
select month, {', '.join(f'round({_SCALED(c)}, 4) + 0 as {c}' for c in pf.STATE)}, regime from u""",
    "bootstrap_intervals": f"with {_RX}, " + ", ".join(f"{_draws(f'd{i}', 'rx', b, c, SIMS)}, i{i} as (select {_CI}, '{k}' as kind from (select sim, {_IR if c else _MEAN_IR} as ir from d{i} group by sim) where ir is not null)" for i, (k, b, c) in enumerate(_kinds))
    + " " + " union all ".join(f"select kind, sims, {q.rounded(['mean', 'ci_lo', 'ci_hi'], 5)} from i{i}" for i in range(3)),
    "regime_attribution": f"""with {_RB}, v as (select *, case when count(bench_ret) over w >= 3 then round(stddev_samp(bench_ret) over w, 12) end as v from rb window w as (order by month rows between 5 preceding and current row)),
rg as (select regime, f::date as first, l::date as final from (values {', '.join(str(r) for r in p.REGIMES)}) t(regime, f, l)),
pa as (select 'named' as split, regime, month, active_ret as x from v join rg on month between first and final union all select 'vol', case when v <= (select quantile_cont(v, 0.5) from v) then 'low' else 'high' end, month, active_ret from v where v is not null),
{_draws('dr', 'pa', 6, True, SIMS, 'split, regime')}, ci as (select split, regime, {_CI} from (select split, regime, sim, {_IR} as ir from dr group by all) where ir is not null group by all),
w as (select split, regime, count(*) as n, avg(x) * 12 as ann_alpha, avg((x > 0)::int) as hit, {_IR} as ir from pa group by all having count(*) >= 6)
select split, regime, n, {q.rounded(['ann_alpha', 'hit', 'ir'], 5)}, case when n >= 12 then round(ci_lo, 5) + 0 end as ci_lo, case when n >= 12 then round(ci_hi, 5) + 0 end as ci_hi from w left join ci using (split, regime)""",
    "return_fan": f"""with {_RB}, nu as (select active_ret as x, row_number() over (order by month) - 1 as pos, count(*) over () as n from rb), g as (select sim, step, n from (select unnest(range(1000)) as sim) cross join (select unnest(range(36)) as step) cross join (select distinct n from nu)),
{mix('u', 'g', 'sim', 'sm')}, {mix('v', 'u', 'sm + step', 'f')}, x as (select (step + 1)::int as month, (product(1 + x) over (partition by sim order by step) - 1) * 100 as p from v join nu on pos = f % v.n)
select month, {', '.join(f'round(quantile_cont(p, {k / 100}), 5) + 0 as p{k}' for k in (5, 25, 50, 75, 95))} from x group by month""",
    "volatility_surface": f"""{_SWEEP}, r as ({' union all '.join(f"select {a}::double as alpha, row_number() over (order by month) as t, port_ret from bt{i}" for i, a in enumerate(ALPHAS))}),
w as (select a.alpha, h, sum(b.port_ret) as ret from r a cross join (select unnest(range(1, 25))::int as h) join r b on a.alpha = b.alpha and b.t between a.t - h + 1 and a.t where a.t >= h group by a.alpha, h, a.t)
select alpha, h as horizon, count(*) as n, round(stddev_samp(ret) * sqrt(12 / h), 6) + 0 as vol from w group by alpha, h""",
    "before_after": f"""with {p._BACK}, {x._BLOCKS}, {p._bt('c2', 'b2')}, a as (select ann_alpha as alpha_before, info_ratio as ir_before, hit_rate as hit_before from {p._perf('c2')}), b as (select ann_alpha as alpha_after, info_ratio as ir_after, hit_rate as hit_after from {p._perf('bt')})
select {q.rounded(['alpha_before', 'ir_before', 'hit_before', 'alpha_after', 'ir_after', 'hit_after'], 5)}, round(alpha_after - alpha_before, 5) + 0 as d_alpha, round(ir_after - ir_before, 5) + 0 as d_ir, round(hit_after - hit_before, 5) + 0 as d_hit, coalesce(round(alpha_after - alpha_before, 12) < -0.005, false) as regression from a cross join b""",
    "tilt_adaptation": f"""with {p._S}, vm as (select month, round(0.001 + 0.001 * v, 9) as alpha_used from (select month, round(avg(vol_20d), 6) as v from panel group by month) where v > 0), sv as (select sc.*, alpha_used from sc join vm using (month)),
bv as {p._tilt('alpha_used').replace('from sc where', 'from sv where')}, {p._bt('tv', 'bv')}, u as (select alpha_used * 100 as x, round(active_ret, 9) / alpha_used as y from tv join vm using (month)),
c as (select *, (select quantile_cont(x, 0.5) from u) as cut from u)
select count(*) as n, round(corr(x, y), 5) + 0 as r, round(regr_slope(y, x), 5) + 0 as slope, round(regr_intercept(y, x), 5) + 0 as intercept,
  round((avg(y) filter (where x > cut) - avg(y) filter (where x <= cut)) / sqrt(var_samp(y) filter (where x > cut) / count(*) filter (where x > cut) + var_samp(y) filter (where x <= cut) / count(*) filter (where x <= cut)), 5) + 0 as welch_t from c""",
    "linear_bridge": f"""with {_RB}, {x._MM}, j as (select active_ret as y, spx_ret_1m as a, spx_vol_63d as b from rb join mm using (month) where spx_ret_1m is not null and spx_vol_63d is not null),
m as (select count(*) as n, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as byy, var_pop(y) as yy, avg(a) as ma, avg(b) as mb, avg(y) as my from j),
k as (select *, (ay * bb - byy * ab) / (aa * bb - ab * ab) as coef_a, (byy * aa - ay * ab) / (aa * bb - ab * ab) as coef_b from m)
select n, {q.rounded(['coef_a', 'coef_b'], 5)}, round(my - coef_a * ma - coef_b * mb, 5) + 0 as intercept, round((coef_a * ay + coef_b * byy) / yy, 5) + 0 as r2 from k""",
    "strategy_difference": f"""with recursive {p._BACK}, {x._BLOCKS}, {p._bt('c2', 'b2')}, df as (select bt.active_ret - c2.active_ret as d from bt join c2 using (month)), st as (select count(*) as n, avg(d) as mean, stddev_samp(d) as s from df),
tq as (select 0.0::double as lo, 64.0::double as hi, 0 as i, n - 1 as v from st union all select case when {q.student_p('((lo + hi) / 2)', 'v')} <= 0.05 then lo else (lo + hi) / 2 end, case when {q.student_p('((lo + hi) / 2)', 'v')} <= 0.05 then (lo + hi) / 2 else hi end, i + 1, v from tq where i < 40),
z as (select n, mean, s, mean / s * sqrt(n) as t, n - 1 as v, (select hi from tq where i = 40) as tc from st)
select n, round(mean, 5) + 0 as mean, round(t, 5) + 0 as t, round({q.student_p('t', 'v')}, 5) + 0 as p, round(mean - s / sqrt(n) * tc, 5) + 0 as ci_lo, round(mean + s / sqrt(n) * tc, 5) + 0 as ci_hi from z""",
}
