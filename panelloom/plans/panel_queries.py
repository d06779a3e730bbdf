"""Queries over the monthly panel, joins, statistics and portfolios, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators import asof, crosssection as cs, evaluation as ev, panel as pan, portfolio as pf, statistics as st
from panelloom.plans import oracle as q
from panelloom.plans.factor_queries import prepared, rounded
from panelloom.sources import bars as src

LEAST = 5
TAILS = ["ret_1m", "ret_3m", "ret_6m", "ret_12m", "vol_20d", "vol_60d", "vol_252d", "hl_range", "mom_2_12", "mom_accel", "mom_decel", "ir_3m", "ir_12m"]
#: Nine sizes of a fund, in the tables' money.
FUNDS = [1e4, 3e4, 1e5, 3e5, 1e6, 3e6, 1e7, 3e7, 1e8]
FACTORS = ["ret_1m", "ret_3m", "vol_20d", "hl_range", "mom_accel"]
REGIMES = [("early", "1995-01-01", "1996-12-31"), ("mid", "1997-01-01", "1998-12-31"), ("late", "1999-01-01", "2001-12-31")]


def panel(spark: SparkSession, sf_dir: str, lags: tuple = ()) -> DataFrame:
    return pan.extended(pan.base_panel(prepared(spark, sf_dir), lags))


def panel_ahead(spark: SparkSession, sf_dir: str, horizons: tuple) -> DataFrame:
    """The panel with its moves over days of the market's calendar."""
    lines = src.table(spark, sf_dir, "lineitem")
    # one row a date
    index = src.market_of(lines).withColumn("day", F.row_number().over(Window.orderBy("date")))
    return pan.extended(pan.base_panel(src.with_returns(src.daily_bars(lines), index), horizons=horizons))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pan.long_form(panel(spark, sf_dir), FACTORS, ["month", "instrument", "fwd_ret_1m"])


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.weights(src.daily_bars(src.table(spark, sf_dir, "lineitem")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum scores with weights, targets, and what a book needs to be costed."""
    rows = panel(spark, sf_dir).select("month", "instrument", F.col("mom_accel").alias("score"), "fwd_ret_1m", F.col("vol_60d").alias("daily_vol"))
    return rows.join(weights(spark, sf_dir), ["month", "instrument"]).filter("fwd_ret_1m is not null").withColumn("adv", F.col("value") / 21)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, digits)


def base_panel(s, d):
    return _r(panel(s, d).drop("close"))


def monthly_ic_momentum(s, d):
    return _r(st.monthly_ic(long(s, d).filter("factor = 'mom_accel'"), LEAST))


def ic_monthly(s, d):
    return _r(st.monthly_ic(long(s, d), LEAST))


def ic_pearson(s, d):
    return _r(st.monthly_ic(long(s, d), LEAST, rank=False))


def ic_summary(s, d):
    return _r(st.ic_summary(st.monthly_ic(long(s, d), LEAST)))


def ic_decay(s, d):
    return _r(cs.ic_decay(panel(s, d), FACTORS, list(range(61)), LEAST))


def ic_pooled(s, d):
    return _r(st.pooled_ic(long(s, d)))


def quantile_spread(s, d):
    return _r(st.quantile_spread(long(s, d), 5, 20))


def factor_turnover(s, d):
    return _r(st.bucket_turnover(long(s, d), 5, 20))


def regime_stability(s, d):
    return st.regime_stability(st.monthly_ic(long(s, d), LEAST), REGIMES)


def factor_health(s, d):
    ic = st.monthly_ic(long(s, d), LEAST)
    cut = F.lit("1999-01-01").cast("date")
    return _r(st.health(st.ic_summary(ic.filter(F.col("month") < cut)), st.ic_summary(ic.filter(F.col("month") >= cut))))


def factor_correlations(s, d):
    return _r(st.rank_correlations(panel(s, d), FACTORS))


def factor_weights(s, d):
    """Signed shares of the mean absolute IC of factors with an IC."""
    ic = st.ic_summary(st.monthly_ic(long(s, d), LEAST))
    return _r(ic.select("factor", (F.col("ic_mean") / F.sum(F.abs("ic_mean")).over(Window.partitionBy())).alias("weight")))


def combo_score(s, d):
    """Sum of signed weights times each factor's z in the month."""
    w = st.ic_summary(st.monthly_ic(long(s, d), LEAST)).select("factor", (F.col("ic_mean") / F.sum(F.abs("ic_mean")).over(Window.partitionBy())).alias("weight"))
    zs = panel(s, d).select("month", "instrument", "fwd_ret_1m", *[F.coalesce(pan.cs_zscore(F.col(c)), F.lit(0.0)).alias(c) for c in FACTORS])
    rows = pan.long_form(zs, FACTORS, ["month", "instrument"]).join(F.broadcast(w), "factor")
    return _r(rows.groupBy("month", "instrument").agg(F.sum(F.col("value") * F.col("weight")).alias("score")))


def bhy_stepup(s, d):
    """Step-up over all factors' p-values of Student's t."""
    return _r(st.step_up(ev.tests_of(st.ic_summary(st.monthly_ic(long(s, d), LEAST))), 0.3))


def fdr_grid(s, d):
    return ev.step_up_grid(ev.tests_of(st.ic_summary(st.monthly_ic(long(s, d), LEAST))), [0.05, 0.2, 0.5])


def cs_rank(s, d):
    return _r(pan.cs_rank(panel(s, d), FACTORS).select("month", "instrument", *FACTORS))


def cs_zscore(s, d):
    p = panel(s, d)
    return _r(p.select("month", "instrument", *[pan.cs_zscore(F.col(c)).alias(f"{c}_z0") for c in FACTORS], *[pan.cs_zscore(F.col(c), population=False).alias(f"{c}_z1") for c in FACTORS]))


def tail_flags(s, d):
    p = pan.tail_flags(panel(s, d), TAILS)
    return p.select("month", "instrument", *[f"{c}_{k}" for c in TAILS for k in ("top", "bot", "tail")])


def group_moments(s, d):
    """Skewness, kurtosis and quartiles of a month's returns, of months with five rows at least that differ."""
    x = F.col("ret_1m")
    n, g, k = F.count(x), F.skewness(x), F.kurtosis(x)
    out = panel(s, d).groupBy("month").agg(
        n.alias("n"), (g * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).alias("kurt"), *[F.percentile(x, q / 100).alias(f"q{q}") for q in (25, 50, 75)], F.stddev_pop(x).alias("_s"),
    )
    return _r(out.filter((F.col("n") >= 5) & (F.col("_s") > 0)).drop("_s"), 5)


def ts_zscore(s, d):
    m = panel(s, d).groupBy("month").agg(F.avg("vol_20d").alias("macro"))
    return _r(pan.ts_zscore(m, "macro"))


def winsorise(s, d):
    return _r(panel(s, d).select("month", "instrument", pan.winsorised("ret_1m", 0.05, 0.95, "month").alias("ret_1m")))


def clean_universe(s, d):
    return _r(pan.clean_universe(panel(s, d), weights(s, d), 0.003, 1.0).select("month", "instrument", "weight", "fwd_ret_1m"))


def dead_columns(s, d):
    p = panel(s, d).withColumns({"constant": F.lit(1.0), "macro": F.month("month").cast("double")})
    return pan.dead_columns(p, [*FACTORS, "constant", "macro"])


def coverage(s, d):
    return _r(pan.coverage(panel(s, d), FACTORS))


def index_weights(s, d):
    return _r(pf.capped(weights(s, d), 0.02), 8)


def index_concentration(s, d):
    w = weights(s, d)
    at = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("weight"), "instrument"))
    out = w.withColumn("at", at).groupBy("month").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.when(F.col("at") <= 10, F.col("weight"))).alias("top10"), F.count("*").alias("names"))
    return _r(out, 8)


def tilt_zscore(s, d):
    return _r(pf.tilt_by_score(scored(s, d), 0.004, LEAST).select("month", "instrument", "bench_w", "port_w"), 8)


def tilt_block(s, d):
    return _r(pf.tilt_by_blocks(scored(s, d), 0.003, 10, LEAST).select("month", "instrument", "bench_w", "port_w"), 8)


def tilt_backtest(s, d):
    return _r(pf.backtest(pf.tilt_by_score(scored(s, d), 0.004, LEAST)))


def tilt_performance(s, d):
    return _r(pf.performance(pf.backtest(pf.tilt_by_score(scored(s, d), 0.004, LEAST))), 5)


def long_short(s, d):
    return _r(pf.long_short(scored(s, d), 0.2, LEAST))


def capacity_curve(s, d):
    book = pf.tilt_by_score(scored(s, d), 0.004, LEAST)
    return _r(pf.capacity(book.filter("daily_vol is not null"), FUNDS), 5)


def block_bootstrap(s, d):
    ic = st.monthly_ic(long(s, d).filter("factor = 'mom_accel'"), LEAST).select("month", F.round("ic", 9).alias("ic"))
    return _r(pf.block_bootstrap(ic, "ic", 200, 6))


def block_bootstrap_mixed(s, d):
    """As block_bootstrap, with starts drawn by an integer mixer and the reference's 10,000 simulations."""
    ic = st.monthly_ic(long(s, d).filter("factor = 'mom_accel'"), LEAST).select("month", F.round("ic", 9).alias("ic"))
    return _r(pf.block_bootstrap_mixed(ic, "ic", 10_000, 6))


def _side(s, d):
    n = src.table(s, d, "supplier").count()
    return src.side(src.table(s, d, "orders"), n)


def asof_tolerance(s, d):
    daily = prepared(s, d).select("instrument", "date", "close")
    return _r(asof.asof_join(daily, _side(s, d), columns=("side_value",), days=10, days_old="age"))


def asof_no_tolerance(s, d):
    ends = src.month_ends(src.daily_bars(src.table(s, d, "lineitem"))).select("instrument", "date", "close")
    return _r(asof.asof_join(ends, _side(s, d), columns=("side_value",), days_old="age"))


def trading_days_ahead(s, d):
    return _r(asof.trading_days_ahead(src.daily_bars(src.table(s, d, "lineitem")), 5))


def ffill_side(s, d):
    daily = prepared(s, d).select("instrument", "date", "close")
    return _r(asof.forward_fill(daily.join(_side(s, d), ["instrument", "date"], "left"), "side_value"))


def semi_universe(s, d):
    large = weights(s, d).filter("weight >= 0.01").select("month", "instrument")
    return _r(panel(s, d).select("month", "instrument", "ret_1m").join(large, ["month", "instrument"], "left_semi"))


def anti_missing(s, d):
    """Bars on days without a side value."""
    return _r(prepared(s, d).select("instrument", "date", "close").join(_side(s, d), ["instrument", "date"], "left_anti"))


def outer_blocks(s, d):
    return _r(prepared(s, d).select("instrument", "date", "close").join(_side(s, d), ["instrument", "date"], "full_outer"))


def snapshot_dedup(s, d):
    o = src.table(s, d, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month"), "o_orderdate", "o_orderkey", "o_totalprice")
    return _r(asof.keep_last(o, ["o_custkey", "month"], ["o_orderdate", "o_orderkey", "o_totalprice"]).select("o_custkey", "month", "o_orderkey", "o_totalprice"))


def market_series(s, d):
    return _r(src.market(src.daily_bars(src.table(s, d, "lineitem"))))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _in_sectors(s, d):
    """month, instrument, ret_1m, sector of all rows; the sector is the region of the supplier's nation."""
    geo = src.table(s, d, "supplier").join(F.broadcast(src.table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(src.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("sector"))
    return panel(s, d).select("month", "instrument", "ret_1m").join(geo, "instrument")


def sector_panel(s, d):
    """Mean returns and names of each region and month, through supplier and nation."""
    return _r(_in_sectors(s, d).groupBy("sector", "month").agg(F.avg("ret_1m").alias("ret_1m"), F.count("*").alias("names")))


def pivot_returns(s, d):
    """A row a month and a column for the mean return of each sector."""
    return _r(_in_sectors(s, d).groupBy("month").pivot("sector", REGIONS).agg(F.avg("ret_1m")).withColumnsRenamed({c: c.lower().replace(" ", "_") for c in REGIONS}))


def month_returns(s, d):
    """A row a month with all its instruments, rising, and their returns in the same order."""
    rows = panel(s, d).select("month", F.struct("instrument", (F.round("ret_1m", 6) + 0).alias("ret_1m")).alias("x"))
    rows = rows.groupBy("month").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("month", F.col("x.instrument").alias("instruments"), F.col("x.ret_1m").alias("ret_1m"))


def event_counts(s, d):
    """Events of the 7 and 30 days up to each event day of a user: trailing range windows by day number."""
    day = F.unix_date(F.col("ts").cast("date"))
    rows = src.table(s, d, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))
    w = lambda k: Window.partitionBy("user_id").orderBy("day").rangeBetween(-(k - 1), 0)
    return _r(rows.select("user_id", "day", F.sum("n").over(w(7)).alias("n7"), F.sum("n").over(w(30)).alias("n30"), F.log1p(F.sum("n").over(w(30)).cast("double")).alias("activity_30d")))


QUERIES = {f.__name__: f for f in (
    base_panel, monthly_ic_momentum, ic_monthly, ic_pearson, ic_summary, ic_decay, ic_pooled, quantile_spread, factor_turnover, regime_stability, factor_health, factor_correlations, factor_weights, combo_score, bhy_stepup,
    fdr_grid, cs_rank, cs_zscore, tail_flags, group_moments, ts_zscore, winsorise, clean_universe, dead_columns, coverage, index_weights, index_concentration, tilt_zscore, tilt_block, tilt_backtest, tilt_performance, long_short,
    capacity_curve, block_bootstrap, block_bootstrap_mixed, asof_tolerance, asof_no_tolerance, trading_days_ahead, ffill_side, semi_universe, anti_missing, outer_blocks, snapshot_dedup, market_series, sector_panel, pivot_returns, month_returns, event_counts,
)}

_P = f"""{q.RETURNS},
dv as (select *, date_trunc('month', date)::date as month, {', '.join(f"{q.std('r', n, max(5, n // 4))} * sqrt(252) as vol_{n}d" for n in (20, 60, 252))} from base),
hl as (select instrument, month, avg((high - low) / close) as hl_range from dv group by all),
pe as (select instrument, month, date, close, vol_20d, vol_60d, vol_252d from dv qualify row_number() over (partition by instrument, month order by date desc) = 1),
p1 as (select pe.*, hl_range, {', '.join(f"close / lag(close, {k}) over (partition by instrument order by month) - 1 as ret_{k}m" for k in (1, 3, 6, 12))} from pe join hl using (instrument, month)),
panel as (select *, -ret_1m as rev_1m, lead(ret_1m) over (partition by instrument order by month) as fwd_ret_1m, ret_12m - ret_1m as mom_2_12, ret_3m - (ret_12m - ret_3m) as mom_accel,
  ret_12m / (abs(vol_252d) + 1e-6) as ir_12m, ret_3m / (abs(vol_60d) + 1e-6) as ir_3m, ret_1m / (abs(ret_6m) / 6 + 1e-9) - 1 as mom_decel from p1)"""
_L = _P + f""",
lf as (select * from (select month, instrument, fwd_ret_1m, {', '.join(FACTORS)} from panel) unpivot include nulls (value for factor in ({', '.join(FACTORS)})))"""


def _rank(x: str, within: str) -> str:
    by = f"partition by {within}" if within else ""
    ties = f"partition by {within}, {x}" if within else f"partition by {x}"
    return f"(rank() over ({by} order by {x} nulls last) + (count(*) over ({ties}) - 1) / 2.0)"


def _c(x: str, y: str, least: int = LEAST) -> str:
    return f"case when count(*) >= {least} and stddev_pop({x}) * stddev_pop({y}) > 1e-15 then corr({x}, {y}) end"


_IC = _L + f""",
rk as (select factor, month, {_rank('value', 'factor, month')} as a, {_rank('fwd_ret_1m', 'factor, month')} as b from lf where value is not null and fwd_ret_1m is not null),
ic as (select * from (select factor, month, count(*) as n, {_c('a', 'b')} as ic from rk group by factor, month) where ic is not null)"""
_SUM = _IC + """,
su as (select *, case when ic_std > 1e-8 then ic_mean / ic_std end as icir, case when ic_std > 1e-8 then ic_mean / ic_std * sqrt(n_months) end as t_stat
  from (select factor, count(ic) as n_months, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(case when round(ic, 12) > 0 then 1.0 else 0.0 end) as pct_positive from ic group by factor) where n_months >= 3)"""
_W = "wt as (select *, value / sum(value) over (partition by month) as weight from (select date_trunc('month', date)::date as month, instrument, sum(dollar_vol::decimal(18,2))::double as value from bars group by all))"
_S = _P + f""", {_W},
sc as (select month, instrument, mom_accel as score, fwd_ret_1m, vol_60d as daily_vol, value, weight, value / 21 as adv from panel join wt using (month, instrument) where fwd_ret_1m is not null)"""


def _tilt(alpha: str) -> str:
    return f"""(select *, raw / sum(raw) over (partition by month) as port_w from (select *, greatest(bench_w + {alpha} * z, 0) as raw from (
  select *, weight / sum(weight) over (partition by month) as bench_w, (score - avg(score) over (partition by month)) / sd as z from (
    select *, stddev_pop(score) over (partition by month) as sd, count(score) over (partition by month) as cnt from sc where score is not null) where sd > 1e-12 and cnt >= {LEAST})))"""


def _bt(name: str, book: str) -> str:
    return f"""{name}_m as (select month, lag(month) over (order by month) as before from (select distinct month from {book})),
{name}_t as (select month, sum(abs(coalesce(w, 0) - coalesce(w0, 0))) as turnover from (
  select coalesce(a.month, b.month) as month, a.port_w as w, b.port_w as w0 from {book} a full join (select m.month, instrument, port_w from {name}_m m join {book} k on k.month = m.before) b on a.month = b.month and a.instrument = b.instrument) group by month),
{name} as (select *, port_ret - bench_ret as active_ret from (select *, port_ret_gross - txn_cost as port_ret from (select g.*, turnover, 0.001 * turnover as txn_cost
  from (select month, sum(port_w * fwd_ret_1m) as port_ret_gross, sum(bench_w * fwd_ret_1m) as bench_ret, count(*) as n_stocks from {book} group by month) g join {name}_t using (month))))"""


def _perf(bt: str) -> str:
    return f"""(select months, ann_port, ann_bench, ann_alpha, track_err, hit_rate, max_active_dd, maxdd, case when track_err > 0 then ann_alpha / track_err end as info_ratio, case when vol > 0 then ann_port / vol end as sharpe from (
  select count(*) as months, case when product(1 + port_ret) > 0 then pow(product(1 + port_ret), 12 / count(*)) - 1 end as ann_port, case when product(1 + bench_ret) > 0 then pow(product(1 + bench_ret), 12 / count(*)) - 1 end as ann_bench, case when product(1 + active_ret) > 0 then pow(product(1 + active_ret), 12 / count(*)) - 1 end as ann_alpha,
    stddev_samp(active_ret) * sqrt(12) as track_err, stddev_samp(port_ret) * sqrt(12) as vol, avg(case when active_ret > 0 then 1.0 else 0.0 end) as hit_rate, min(da) as max_active_dd, min(dp) as maxdd
  from (select *, a / max(a) over (order by month) - 1 as da, p / max(p) over (order by month) - 1 as dp from (select *, product(1 + active_ret) over (order by month) as a, product(1 + port_ret) over (order by month) as p from {bt}))) where months >= 6)"""


_PERF = ["ann_port", "ann_bench", "ann_alpha", "track_err", "hit_rate", "max_active_dd", "maxdd", "info_ratio", "sharpe"]
_BACK = _S + f", bk as {_tilt('0.004')}, {_bt('bt', 'bk')}"
_SIDE = "sd as (select o_custkey % (select count(*) from supplier) + 1 as instrument, o_orderdate::date as date, arg_max(o_totalprice, {'k': o_orderkey, 'p': o_totalprice}) as side_value from orders group by all)"
_TESTS = _SUM + f", te as (select factor, round({q.student_p('t_stat', '(n_months - 1)')}, 9) as p from su)"


def _step(level: float, dependent: bool) -> str:
    c = "sum(1.0 / rank) over ()" if dependent else "1.0"
    return f"""(select factor, p, rank, threshold, least(min(p * m * c / rank) over (order by rank rows between current row and unbounded following), 1.0) as adjusted,
  coalesce(rank <= max(case when p <= threshold then rank end) over (), false) as rejected
  from (select *, rank * {level} / (m * c) as threshold from (select *, {c} as c from (select *, row_number() over (order by p, factor) as rank, count(*) over () as m from te))))"""


_BUCKET = _L + f""",
q1 as (select *, {', '.join(f"quantile_cont(value, {i / 5}) over w as e{i}" for i in range(6))}, count(*) over w as n from lf where value is not null and fwd_ret_1m is not null window w as (partition by factor, month)),
qb as (select *, greatest({' + '.join(f"(e{i} < value)::int" for i in range(6))}, 1) as bucket from q1 where n >= 20 and {' and '.join(f"e{i} <> e{i + 1}" for i in range(5))})"""
_fifth = lambda x: f"(({x}) * ({x}) % 2147483647 * (({x}) * ({x}) % 2147483647) % 2147483647 * ({x}) % 2147483647)"
_z = lambda c, f: f"case when {f}({c}) over (partition by month) > 1e-12 then ({c} - avg({c}) over (partition by month)) / {f}({c}) over (partition by month) end"
_prank = lambda c: f"case when {c} is not null then {_rank(c, 'month')} / count({c}) over (partition by month) end"

ORACLES = {
    "base_panel": f"with {_P} select instrument, month, date, {q.rounded(['vol_20d', 'vol_60d', 'vol_252d', 'hl_range', 'ret_1m', 'ret_3m', 'ret_6m', 'ret_12m', 'rev_1m', 'fwd_ret_1m', 'mom_2_12', 'mom_accel', 'ir_12m', 'ir_3m', 'mom_decel'])} from panel",
    "monthly_ic_momentum": f"with {_IC} select factor, month, n, {q.rounded(['ic'])} from ic where factor = 'mom_accel'",
    "ic_monthly": f"with {_IC} select factor, month, n, {q.rounded(['ic'])} from ic",
    "ic_pearson": f"with {_L} select factor, month, n, {q.rounded(['ic'])} from (select factor, month, count(*) as n, {_c('value', 'fwd_ret_1m')} as ic from lf where value is not null and fwd_ret_1m is not null group by all) where ic is not null",
    "ic_summary": f"with {_SUM} select factor, n_months, {q.rounded(['ic_mean', 'ic_std', 'pct_positive', 'icir', 't_stat'])} from su",
    "ic_decay": f"""with {_L}, nb as (select *, year(month) * 12 + month(month) as k from lf), la as (select unnest(range(61))::int as lag),
j as (select a.factor, lag, a.month, a.value, b.later from nb a cross join la join (select distinct instrument, k, fwd_ret_1m as later from nb) b on b.instrument = a.instrument and b.k = a.k + lag where value is not null and later is not null),
r as (select factor, lag, month, {_rank('value', 'factor, lag, month')} as a, {_rank('later', 'factor, lag, month')} as b from j)
select factor, lag, round(avg(ic), 6) + 0 as ic_mean, count(*) as n_months from (select factor, lag, month, {_c('a', 'b')} as ic from r group by all) where ic is not null group by factor, lag""",
    "ic_pooled": f"with {_L}, r as (select factor, {_rank('value', 'factor')} as a, {_rank('fwd_ret_1m', 'factor')} as b from lf where value is not null and fwd_ret_1m is not null) select factor, count(*) as n, round({_c('a', 'b', 3)}, 6) + 0 as ic from r group by factor",
    "quantile_spread": f"""with {_BUCKET}, c as (select *, greatest(least(fwd_ret_1m, quantile_cont(fwd_ret_1m, 0.99) over w), quantile_cont(fwd_ret_1m, 0.01) over w) as f from qb window w as (partition by factor, month))
select factor, month, {q.rounded(['bottom', 'top'])}, round(top - bottom, 6) + 0 as spread from (select factor, month, avg(f) filter (where bucket = 1) as bottom, avg(f) filter (where bucket = 5) as top from c group by all)""",
    "factor_turnover": f"with {_BUCKET}, l as (select *, lag(bucket) over (partition by factor, instrument order by month) as prior from qb) select factor, round(avg(case when bucket <> prior then 1.0 else 0.0 end), 6) + 0 as turnover, count(*) as n from l where prior is not null group by factor",
    "regime_stability": f"""with {_IC}, rg as (select regime, f::date as first, l::date as final from (values {', '.join(str(r) for r in REGIMES)}) t(regime, f, l)),
mm as (select factor, regime, avg(ic) as ic, count(*) as n from ic join rg on month between first and final group by all having count(*) >= 6)
select *, greatest(positive, regimes - positive) >= 0.75 * regimes as stable from (select factor, count(*) as regimes, count(*) filter (where round(ic, 12) > 0) as positive from mm group by factor)""",
    "factor_health": f"""with {_IC}, two as (select factor, month < date '1999-01-01' as early, round(avg(ic), 12) as ic_mean, count(*) as n from ic group by all having count(*) >= 3),
h as (select a.factor, a.ic_mean as ic_is, b.ic_mean as ic_oos, case when abs(a.ic_mean) > 1e-10 then b.ic_mean / a.ic_mean end as decay_ratio from two a left join two b on a.factor = b.factor and not b.early where a.early)
select factor, {q.rounded(['ic_is', 'ic_oos', 'decay_ratio'])}, case when decay_ratio is null then 'GREY' when decay_ratio < 0 then 'RED' when abs(decay_ratio) >= 0.7 then 'GREEN' when abs(decay_ratio) >= 0.3 then 'AMBER' else 'RED' end as health from h""",
    "factor_correlations": f"""with {_P}, r as (select {', '.join(f"{_rank(c, '')} as {c}" for c in FACTORS)} from panel where {' and '.join(f'{c} is not null' for c in FACTORS)})
""" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0 as rho from r" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]),
    "factor_weights": f"with {_SUM} select factor, round(ic_mean / sum(abs(ic_mean)) over (), 6) + 0 as weight from su",
    "combo_score": f"""with {_SUM}, zz as (select month, instrument, {', '.join(f"coalesce({_z(c, 'stddev_pop')}, 0) as {c}" for c in FACTORS)} from panel),
zl as (select * from zz unpivot (z for factor in ({', '.join(FACTORS)})))
select month, instrument, round(sum(z * weight), 6) + 0 as score from zl join (select factor, ic_mean / sum(abs(ic_mean)) over () as weight from su) using (factor) group by all""",
    "bhy_stepup": f"with {_TESTS} select factor, rank, rejected, {q.rounded(['p', 'threshold', 'adjusted'])} from {_step(0.3, True)}",
    "fdr_grid": f"with {_TESTS} " + " union all ".join(f"select {level}::double as level, '{name}' as test, count(*) filter (where rejected) as rejected from {_step(level, dep)}" for level in (0.05, 0.2, 0.5) for name, dep in (("bh", False), ("bhy", True))),
    "cs_rank": f"with {_P} select month, instrument, {', '.join(f'round(coalesce({_prank(c)} - 0.5, 0), 6) + 0 as {c}' for c in FACTORS)} from panel",
    "cs_zscore": f"with {_P} select month, instrument, {', '.join(f'round({_z(c, f)}, 6) + 0 as {c}_{n}' for c in FACTORS for n, f in (('z0', 'stddev_pop'), ('z1', 'stddev_samp')))} from panel",
    "tail_flags": f"with {_P}, r as (select month, instrument, {', '.join(f'{_prank(c)} as {c}' for c in TAILS)} from panel) select month, instrument, "
    + ", ".join(f"{q.flag(f'{c} >= 0.9')} as {c}_top, {q.flag(f'{c} <= 0.1')} as {c}_bot, {q.flag(f'{c} >= 0.9')} - {q.flag(f'{c} <= 0.1')} as {c}_tail" for c in TAILS) + " from r",
    "group_moments": f"""with {_P} select month, count(ret_1m) as n, round(skewness(ret_1m), 5) + 0 as skew, round(kurtosis(ret_1m), 5) + 0 as kurt, {', '.join(f'round(quantile_cont(ret_1m, {k / 100}), 5) + 0 as q{k}' for k in (25, 50, 75))} from panel group by month having count(ret_1m) >= 5 and stddev_pop(ret_1m) > 0""",
    "ts_zscore": f"""with {_P}, m as (select month, avg(vol_20d) as macro from panel group by month)
select month, round(macro, 6) + 0 as macro, round(case when count(macro) over w >= 9 then (macro - avg(macro) over w) / (stddev_samp(macro) over w + 1e-9) end, 6) + 0 as macro_z from m window w as (order by month rows between 35 preceding and current row)""",
    "winsorise": f"with {_P} select month, instrument, round(case when ret_1m is null then quantile_cont(ret_1m, 0.95) over w else greatest(least(ret_1m, quantile_cont(ret_1m, 0.95) over w), quantile_cont(ret_1m, 0.05) over w) end, 6) + 0 as ret_1m from panel window w as (partition by month)",
    "clean_universe": f"with {_P}, {_W} select month, instrument, {q.rounded(['weight', 'fwd_ret_1m'])} from panel join wt using (month, instrument) where weight >= 0.003 and abs(fwd_ret_1m) <= 1",
    "dead_columns": f"""with {_P}, x as (select *, 1.0 as constant, month(month)::double as macro from panel) """
    + " union all ".join(f"""select '{c}' as "column", (select count(distinct {c}) from x) as n_distinct, (select max(n) from (select count(distinct {c}) as n from x group by month)) as most_in_a_month, (select count(distinct {c}) from x) <= 1 or (select max(n) from (select count(distinct {c}) as n from x group by month)) <= 1 as dead""" for c in [*FACTORS, "constant", "macro"]),
    "coverage": f"with {_P} select month, count(*) as n, {', '.join(f'round(avg(case when {c} is not null then 1.0 else 0.0 end), 6) + 0 as {c}' for c in FACTORS)} from panel group by month",
    # the cap by iterating as an index provider would: clip, then spread the excess over what is under the cap
    "index_weights": f"""with recursive {q.BARS}, {_W}, it as (select month, instrument, value, weight, weight as x, 0 as i from wt
  union all select month, instrument, value, weight, case when x >= 0.02 - 1e-15 then 0.02 else x * (1 - 0.02 * count(*) filter (where x >= 0.02 - 1e-15) over (partition by month)) / sum(x) filter (where x < 0.02 - 1e-15) over (partition by month) end, i + 1 from it where i < 60)
select month, instrument, {q.rounded(['value', 'weight'], 8)}, count(*) over (partition by month) * 0.02 >= 1 as feasible, round(case when count(*) over (partition by month) * 0.02 < 1 then 1.0 / count(*) over (partition by month) else x end, 8) + 0 as capped from it where i = 60""",
    "index_concentration": f"with {q.BARS}, {_W}, r as (select *, row_number() over (partition by month order by weight desc, instrument) as pos from wt) select month, round(sum(weight * weight), 8) + 0 as hhi, round(sum(weight) filter (where pos <= 10), 8) + 0 as top10, count(*) as names from r group by month",
    "tilt_zscore": f"with {_S} select month, instrument, {q.rounded(['bench_w', 'port_w'], 8)} from {_tilt('0.004')}",
    "tilt_block": f"""with {_S}, k as (select *, row_number() over (partition by month order by score desc, instrument) as best, row_number() over (partition by month order by score, instrument) as worst, count(*) over (partition by month) as cnt from sc where score is not null),
b as (select *, weight / sum(weight) over (partition by month) as bench_w from k where cnt >= {LEAST}), r as (select *, greatest(bench_w + case when best <= 10 then 0.003 when worst <= 10 then -0.003 else 0 end, 0) as raw from b)
select month, instrument, round(bench_w, 8) + 0 as bench_w, round(raw / sum(raw) over (partition by month), 8) + 0 as port_w from r""",
    "tilt_backtest": f"with {_BACK} select month, n_stocks, {q.rounded(['port_ret', 'port_ret_gross', 'bench_ret', 'active_ret', 'turnover', 'txn_cost'])} from bt",
    "tilt_performance": f"with {_BACK} select months, {q.rounded(_PERF, 5)} from {_perf('bt')}",
    "alpha_sweep": f"with {_S}" + "".join(f", bk{i} as {_tilt(a)}, {_bt(f'bt{i}', f'bk{i}')}" for i, a in enumerate(("0.001", "0.002", "0.004", "0.008")))
    + " " + " union all ".join(f"select {a}::double as alpha, {q.rounded(['ann_alpha', 'track_err', 'info_ratio'], 5)} from {_perf(f'bt{i}')}" for i, a in enumerate(("0.001", "0.002", "0.004", "0.008"))),
    "long_short": f"""with {_S}, k as (select *, row_number() over (partition by month order by score desc, instrument) as best, row_number() over (partition by month order by score, instrument) as worst, count(*) over (partition by month) as cnt from sc where score is not null)
select month, {q.rounded(['long_ret', 'short_ret'])}, round(long_ret - short_ret, 6) + 0 as spread from (select month, avg(fwd_ret_1m) filter (where best <= greatest(floor(cnt * 0.2), 1)) as long_ret, avg(fwd_ret_1m) filter (where worst <= greatest(floor(cnt * 0.2), 1)) as short_ret from k where cnt >= {LEAST} group by month)""",
    "capacity_curve": f"""with {_S}, bk as (select * from {_tilt('0.004')} where daily_vol is not null), m as (select month, lag(month) over (order by month) as before from (select distinct month from bk)),
tr as (select b.*, abs(b.port_w - coalesce(o.port_w, 0)) as traded from bk b join m using (month) left join bk o on o.month = m.before and o.instrument = b.instrument),
z as (select *, traded * fund / (adv * 3) as part from tr cross join (select unnest([{', '.join(map(str, FUNDS))}])::double as fund))
select fund, round(avg(cost) * 12, 5) + 0 as impact_cost, round(avg(part), 5) + 0 as mean_participation from (select fund, month, sum(traded * daily_vol * sqrt(part)) as cost, avg(part) as part from z group by all) group by fund""",
    "block_bootstrap": f"""with {_IC}, s as (select round(ic, 9) as x, row_number() over (order by month) - 1 as pos from ic where factor = 'mom_accel'), n as (select count(*) as n from s),
dr as (select sim, (sim * 7919 + (i // 6) * 104729 + i % 6) % n as pos from (select unnest(range(200)) as sim) cross join n cross join lateral (select unnest(range(n)) as i))
select sim, round(avg(x), 6) + 0 as mean, round(stddev_samp(x), 6) + 0 as std from dr join s using (pos) group by sim""",
    "block_bootstrap_mixed": f"""with {_IC}, s as (select round(ic, 9) as x, row_number() over (order by month) - 1 as pos from ic where factor = 'mom_accel'), n as (select count(*)::bigint as n from s),
m0 as (select sim::bigint as sim, (sim::bigint * 48271 + 11) % 2147483647 as x from (select unnest(range(10000)) as sim)), m1 as (select sim, ({_fifth('x')} * 69621 + 977) % 2147483647 as x from m0), m2 as (select sim, {_fifth('x')} as x from m1),
b0 as (select sim, j, ((x + j) * 48271 + 11) % 2147483647 as x from m2 cross join n cross join lateral (select unnest(range((n - 1) // 6 + 1)) as j)),
b1 as (select sim, j, ({_fifth('x')} * 69621 + 977) % 2147483647 as x from b0), b2 as (select sim, j, {_fifth('x')} % n as first from b1 cross join n),
dr as (select sim, (first + k) % n as pos from b2 cross join n cross join (select unnest(range(6)) as k) where j * 6 + k < n)
select sim, round(avg(x), 6) + 0 as mean, round(stddev_samp(x), 6) + 0 as std from dr join s using (pos) group by sim""",
    "asof_tolerance": f"""with {q.BARS}, {_SIDE}, j as (select b.instrument, b.date, close, s.side_value, date_diff('day', s.date, b.date) as age from bars b asof left join sd s on b.instrument = s.instrument and b.date >= s.date)
select instrument, date, round(close, 6) + 0 as close, case when age <= 10 then round(side_value, 6) + 0 end as side_value, (case when age <= 10 then age end)::int as age from j""",
    "asof_no_tolerance": f"with {q.BARS}, {q.MONTH_ENDS}, {_SIDE} select b.instrument, b.date, round(close, 6) + 0 as close, round(s.side_value, 6) + 0 as side_value, date_diff('day', s.date, b.date)::int as age from ends b asof left join sd s on b.instrument = s.instrument and b.date >= s.date",
    "trading_days_ahead": f"with {q.BARS}, dy as (select date, row_number() over (order by date) as k from (select distinct date from bars)), nb as (select * from bars join dy using (date)) select a.instrument, a.date, round(a.close, 6) + 0 as close, round(b.close, 6) + 0 as ahead from nb a left join nb b on a.instrument = b.instrument and b.k = a.k + 5",
    "ffill_side": f"with {q.BARS}, {_SIDE} select instrument, date, round(close, 6) + 0 as close, round(last_value(side_value ignore nulls) over (partition by instrument order by date), 6) + 0 as side_value from bars left join sd using (instrument, date)",
    "semi_universe": f"with {_P}, {_W} select month, instrument, round(ret_1m, 6) + 0 as ret_1m from panel where (month, instrument) in (select (month, instrument) from wt where weight >= 0.01)",
    "anti_missing": f"with {q.BARS}, {_SIDE} select instrument, date, round(close, 6) + 0 as close from bars b where not exists (select 1 from sd s where s.instrument = b.instrument and s.date = b.date)",
    "outer_blocks": f"with {q.BARS}, {_SIDE} select instrument, date, round(close, 6) + 0 as close, round(side_value, 6) + 0 as side_value from bars full join sd using (instrument, date)",
    "snapshot_dedup": "select o_custkey, month, o_orderkey, round(o_totalprice, 6) + 0 as o_totalprice from (select *, date_trunc('month', o_orderdate)::date as month from orders) qualify row_number() over (partition by o_custkey, month order by o_orderdate desc, o_orderkey desc, o_totalprice desc) = 1",
    "market_series": f"with {q.BARS}, {q.MARKET} select date, {q.rounded(['level', 'm'])} from market",
    "sector_panel": f"with {_P} select r_name as sector, month, round(avg(ret_1m), 6) + 0 as ret_1m, count(*) as names from panel join supplier on s_suppkey = instrument join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "pivot_returns": f"with {_P} select month, {', '.join(f"round(avg(ret_1m) filter (where r_name = '{c}'), 6) + 0 as {c.lower().replace(' ', '_')}" for c in REGIONS)} from panel join supplier on s_suppkey = instrument join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by month",
    "month_returns": f"with {_P} select month, list(instrument order by instrument) as instruments, list(round(ret_1m, 6) + 0 order by instrument) as ret_1m from panel group by month",
    "event_counts": """with d as (select user_id, date_diff('day', date '1970-01-01', ts::date)::int as day, count(*) as n from events group by all)
select user_id, day, (sum(n) over a)::bigint as n7, (sum(n) over b)::bigint as n30, round(ln(1 + sum(n) over b), 6) + 0 as activity_30d from d
window a as (partition by user_id order by day range between 6 preceding and current row), b as (partition by user_id order by day range between 29 preceding and current row)""",
}
