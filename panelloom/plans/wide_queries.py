"""Queries over all columns of the daily families at once, regimes and retrained rankers, and the oracles SQL can give."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.frames import flag
from panelloom.operators import autoencoder, catalogue, crosssection as cs, evaluation as ev, linear, portfolio as pf, regimes, retrain, riskparity, shuffles, statistics as st, wide
from panelloom.plans import evaluation_queries as e, oracle as q, panel_queries as p
from panelloom.plans.factor_queries import prepared, rounded
from panelloom.plans.more_queries import shared_folder, written
from panelloom.sources import bars as src

UNTIL, AFTER = "1998-12-31", "1997-12-31"
LAGS = [0, 1, 3]
FOLDS = [(f"{y}-01-01", f"{y}-12-31") for y in range(1996, 2002)]
#: The columns that get tail flags.
TAIL_BASES = ["ret_1m", "ret_2w", "ret_1w", "ret_6m", "ret_9m", "ret_12m", "ret_18m", "ret_24m", "vol_momentum_21d", "vol_21d", "vol_252d", "idio_vol_252d", "beta_252d", "maxdd_126d", "size_proxy", "amihud_illiq_21d", "log_mktcap"]
#: Variants of boosted rankers: depth, rate, rounds.
SWEEP = [(2, 0.1, 6), (3, 0.1, 6), (3, 0.3, 3)]
#: A column of ranks whose spread is smaller is constant.
FLAT = 1e-6


def _unranked(s, d) -> tuple[DataFrame, list[str]]:
    rows = e.month_end_features(s, d)
    return rows, e.names_of(rows)


def feature_correlations(s: SparkSession, d: str) -> DataFrame:
    """Every pair of the families' columns whose ranks in the month go together, over the rows that have both."""
    rows, names = _unranked(s, d)
    pairs = wide.redundant(wide.rank_correlations(rows, names, 20, FLAT), 0.5)
    kind = F.when(F.round("size", 9) >= 0.9, "same").when(F.round("size", 9) >= 0.7, "redundant").otherwise("alike")
    return rounded(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "rho", kind.alias("kind")), 5)


def feature_noise(s: SparkSession, d: str) -> DataFrame:
    """Each column's variance inflation and cluster, and how many eigenvalues of all columns' rank correlations stand above the noise band."""
    rows, names = _unranked(s, d)
    pairs = wide.rank_correlations(rows, names, 20, FLAT)
    # columns by columns, whatever the rows
    matrix, n = wide.matrix_of(pairs, names), wide.with_any(rows, names).count()
    if n < 3:
        return s.createDataFrame([], "factor string, vif double, cluster int, signals int, noise_high double")
    valid = wide.nearest_valid(matrix)
    edge = linear.marchenko_pastur(valid, n)
    vif, clusters = linear.variance_inflation(valid), linear.ward_clusters(matrix)
    table = [(c, float(round(v, 4)) if np.isfinite(v) else None, int(k), edge["signals"], float(round(edge["high"], 6))) for c, v, k in zip(names, vif, clusters)]
    return s.createDataFrame(table, "factor string, vif double, cluster int, signals int, noise_high double")


def feature_tails(s: SparkSession, d: str) -> DataFrame:
    """Whether each of 17 columns is in the month's top or bottom tenth, and the difference; missing values are in neither."""
    rows = e.month_end_features(s, d).select("month", "instrument", *[c for c in TAIL_BASES if c not in ("vol_252d", "log_mktcap")])
    rows = rows.join(e.month_end_panel(s, d).select("month", "instrument", "vol_252d"), ["month", "instrument"]).join(p.weights(s, d).select("month", "instrument", F.log("value").alias("log_mktcap")), ["month", "instrument"], "left")
    ranks = wide.ranks_in_month(rows, TAIL_BASES)
    both = rows.select("month", "instrument").join(ranks, ["month", "instrument"], "left")
    flags = {f"{c}_{k}": f for c in TAIL_BASES for k, f in (("top", flag(F.col(c) >= 0.9)), ("bot", flag(F.col(c) <= 0.1)))}
    both = both.withColumns(flags).withColumns({f"{c}_tail": F.col(f"{c}_top") - F.col(f"{c}_bot") for c in TAIL_BASES})
    return both.select("month", "instrument", *[f"{c}_{k}" for c in TAIL_BASES for k in ("top", "bot", "tail")])


def feature_decay(s: SparkSession, d: str) -> DataFrame:
    """The IC of every column of the daily families with the returns of this month, the next and the third after."""
    targets = {f"fwd_ret_1m_{k}" if k else "fwd_ret_1m": k for k in LAGS}
    rows = e.month_ends_ahead(s, d)
    decay = cs.target_ics(rows, [c for c in e.names_of(rows) if c not in targets], targets, p.LEAST)
    return rounded(decay.withColumnRenamed("at", "lag"), 5)


def feature_screening(s: SparkSession, d: str) -> DataFrame:
    """The catalogue of every column of the daily families before a date: IC, persistence, closest other column, shuffles and the step-up test over all."""
    rows = e.month_ends_ahead(s, d).filter(F.col("month") < F.lit(e.CUT).cast("date"))
    names = e.names_of(e.month_end_features(s, d))
    # returns after the date are not known yet
    later = {f"fwd_ret_1m_{k}": F.when(F.add_months("month", k) < F.lit(e.CUT).cast("date"), F.col(f"fwd_ret_1m_{k}")) for k in (1, 3)}
    targets = {"fwd_ret_1m": 0} | {c: int(c.rsplit("_", 1)[1]) for c in later}
    told = written(s, catalogue.month_catalogue(rows.withColumns(later), names, targets, 200, p.LEAST), "catalogue")
    ic = catalogue.of_kind(told, "ic")
    decay = ic.filter("at > 0").groupBy("factor", F.col("at").alias("lag")).agg(F.avg("ic").alias("ic_mean"))
    near = ev.closest(catalogue.correlations(told, names, 20, FLAT).filter("rho is not null"))
    shuffled = shuffles.tested(catalogue.of_kind(told, "sums"), 200, p.LEAST)
    return rounded(ev.screening(st.ic_summary(ic.filter("at = 0")), decay, near, shuffled), 5)


def feature_shape(s: SparkSession, d: str) -> DataFrame:
    """The spread of fifths of every column of the daily families, whether returns rise or fall with them, and whether spread and IC agree."""
    rows = e.month_end_features(s, d)
    shape = ev.monotonic_of(cs.bucket_means(rows, e.names_of(rows), 5, 20))
    audit = ev.direction_audit(st.ic_summary(e.all_ic(s, d)), shape)
    return rounded(shape.join(audit.drop("ann_spread"), "factor"), 4)


def feature_regimes(s: SparkSession, d: str) -> DataFrame:
    """The IC of every column of the daily families in calm and in rough months."""
    state = e.month_end_panel(s, d).groupBy("month").agg(F.round(F.percentile("vol_20d", 0.5), 9).alias("vol"))
    return rounded(ev.ic_by_regime(e.all_ic(s, d), state, "vol"), 5)


def feature_loadings(s: SparkSession, d: str) -> DataFrame:
    """How the panel's score goes together with every column of the daily families, month by month."""
    rows, names = e.month_ends_scored(s, d), e.names_of(e.month_end_features(s, d))
    return rounded(ev.score_loadings(rows, "mom_accel", names, p.LEAST), 5)


def stress_score(s: SparkSession, d: str) -> DataFrame:
    return rounded(regimes.stress_scores(regimes.market_features(p.panel(s, d)), regimes.STRESS, UNTIL))


def hidden_regimes(s: SparkSession, d: str) -> DataFrame:
    """Two hidden states of volatility and return for each instrument's months."""
    count = src.table(s, d, "lineitem").agg(F.approx_count_distinct("l_suppkey")).first()[0]
    return rounded(regimes.hidden_regimes(p.panel(s, d).select("instrument", "month", "vol_60d", "ret_1m"), ["vol_60d", "ret_1m"], series_count=count), 4)


def expanding_boosted(s: SparkSession, d: str) -> DataFrame:
    """Scores of boosted rankers retrained every 12 months on all months before."""
    rows = p.panel(s, d).select("month", "instrument", "fwd_ret_1m", *[c for c in p.TAILS])
    months = rows.filter("fwd_ret_1m is not null").select("month").distinct()
    schema = "month date, instrument int, score double, fwd_ret_1m double, rounds int, fold string"
    cut = F.lit(AFTER).cast("date")
    told = months.agg(F.count(F.when(F.col("month") <= cut, 1)).alias("before"), F.count(F.when(F.col("month") > cut, 1)).alias("after"), F.max(F.when(F.col("month") <= cut, F.col("month"))).alias("last")).first()
    if told["before"] < 24 or not told["after"]:
        return s.createDataFrame([], schema)
    folder = f"{shared_folder(s)}/rankers-{s.sparkContext.applicationId}-{uuid.uuid4().hex}"
    return rounded(retrain.expanding_scores(rows, p.TAILS, "fwd_ret_1m", told["last"], folder, rounds=12, patience=5).withColumn("fold", F.col("fold").cast("string")))


def fold_weights(s: SparkSession, d: str) -> DataFrame:
    """Each year's weights of all columns of the daily families, by the months before it."""
    return rounded(st.fold_weights(e.all_ic(s, d, rank=False), FOLDS).select("first", "factor", "weight"))


def fold_scores(s: SparkSession, d: str) -> DataFrame:
    """Each year's scores by its fold's weights."""
    rows, names = _unranked(s, d)
    # a row a month and column: for the weights, and for the scores
    moments = written(s, cs.month_moments(rows, names), "moments")
    return rounded(cs.weighted_scores(rows, names, moments, st.fold_weights(cs.ics_of(moments, p.LEAST), FOLDS)), 5)


def split_importance(s: SparkSession, d: str) -> DataFrame:
    return rounded(linear.split_importance(p.panel(s, d), p.TAILS, "fwd_ret_1m", UNTIL))


def boosted_sweep(s: SparkSession, d: str) -> DataFrame:
    """Depths, rates and rounds of boosted rankers on purged folds, best first, fitted side by side."""
    rows = p.panel(s, d).dropna(subset=["fwd_ret_1m"]).select("month", "instrument", "fwd_ret_1m", *p.FACTORS)
    if rows.isEmpty():
        return s.createDataFrame([], "variant string, folds int, ic double, worst double, place int")
    return rounded(retrain.sweep(rows, p.FACTORS, "fwd_ret_1m", SWEEP, folds=3, purge=1, parallel=3))


def latent_windows(s: SparkSession, d: str) -> DataFrame:
    """Four latent numbers of each month end's last 20 returns and volumes, learned on the months up to a date."""
    base = prepared(s, d)
    rows = base.withColumn("_v", F.log1p("volume"))
    ends = src.month_ends(autoencoder.windows(rows, ["r", "_v"], 20).filter("x is not null").select("instrument", "date", "x"))
    coder = autoencoder.fit_autoencoder(ends.filter(F.col("month") <= F.lit(UNTIL).cast("date")), "x", latent=4, hidden=32, rounds=60)
    if coder is None:
        return s.createDataFrame([], "instrument int, month date, " + "".join(f"cand_ae_latent_{i} double, " for i in range(4)) + "error double")
    return rounded(autoencoder.encode(ends, "x", coder, ["instrument", "month"]))


def book_nav(s: SparkSession, d: str) -> DataFrame:
    """The tilted book day by day, its weights drifting within each month."""
    book = pf.tilt_by_score(p.scored(s, d), 0.004, p.LEAST).select("month", "instrument", F.col("port_w").alias("weight"))
    return rounded(riskparity.daily_nav(book, prepared(s, d)).drop("nav"), 6)


def risk_parity_nav(s: SparkSession, d: str) -> DataFrame:
    base = prepared(s, d)
    return rounded(riskparity.daily_nav(riskparity.risk_parity(p.scored(s, d), base, 20), base, drift=False).drop("nav"), 6)


def covariance_checks(s: SparkSession, d: str) -> DataFrame:
    return rounded(riskparity.covariance_diagnostics(p.scored(s, d), prepared(s, d), 20), 4)


QUERIES = {f.__name__: f for f in (
    feature_screening, feature_shape, feature_regimes, feature_loadings, feature_tails, fold_weights, fold_scores, split_importance, boosted_sweep, latent_windows, book_nav, risk_parity_nav, covariance_checks, feature_correlations, feature_noise, feature_decay, stress_score, hidden_regimes, expanding_boosted,
)}

_FOLDED = f"""fi as (select * from (select factor, month, {p._c('value', 'fwd_ret_1m')} as ic from fe where value is not null and fwd_ret_1m is not null group by all) where ic is not null), fo as (select f::date as first, l::date as final from (values {', '.join(str(x) for x in FOLDS)}) t(f, l)),
fm as (select first, final, factor, avg(abs(ic)) as m, sign(round(avg(ic), 12)) as s from fi join fo on month < first group by all having count(*) >= 12), fw as (select first, final, factor, s * m / sum(m) over (partition by first) as weight from fm)"""

ORACLES = {
    "feature_correlations": f"""with {p._P}, {e._families()}, rk as materialized (select factor, month, instrument, {p._rank('value', 'factor, month')} / count(*) over (partition by factor, month) as x from fe where value is not null),
c as (select a.factor as a, b.factor as b, count(*) as n, stddev_pop(a.x) as sa, stddev_pop(b.x) as sb, corr(a.x, b.x) as rho from rk a join rk b on a.month = b.month and a.instrument = b.instrument and a.factor < b.factor group by all having count(*) >= 20)
select a, b, n, round(rho, 5) + 0 as rho, case when round(abs(rho), 9) >= 0.9 then 'same' when round(abs(rho), 9) >= 0.7 then 'redundant' else 'alike' end as kind from c where sa > {FLAT} and sb > {FLAT} and round(abs(rho), 9) >= 0.5""",
    "fold_weights": f"""with {p._P}, {e._families()}, {_FOLDED} select first, factor, round(weight, 6) + 0 as weight from fw""",
    "fold_scores": f"""with {p._P}, {e._families()}, {_FOLDED}, z as (select month, instrument, factor, case when stddev_pop(value) over w > 1e-12 then (value - avg(value) over w) / stddev_pop(value) over w end as z from fe window w as (partition by factor, month))
select month, instrument, round(sum(coalesce(z, 0) * weight), 5) + 0 as score from z join fw on fw.factor = z.factor and month between first and final group by month, instrument""",
    "feature_tails": f"""with {p._P}, {p._W}, {e._families()}, tb as (select month, instrument, factor, value from fe where value is not null and factor in ({', '.join(f"'{c}'" for c in TAIL_BASES)})
  union all select month, instrument, 'vol_252d', vol_252d from panel where vol_252d is not null union all select panel.month, panel.instrument, 'log_mktcap', ln(value) from panel join wt on wt.month = panel.month and wt.instrument = panel.instrument),
tr as (select month, instrument, factor, {p._rank('value', 'factor, month')} / count(*) over (partition by factor, month) as x from tb)
select panel.month, panel.instrument, {', '.join(f"coalesce(max(case when x >= 0.9 then 1.0 else 0.0 end) filter (where factor = '{c}'), 0.0)::double as {c}_top, coalesce(max(case when x <= 0.1 then 1.0 else 0.0 end) filter (where factor = '{c}'), 0.0)::double as {c}_bot, (coalesce(max(case when x >= 0.9 then 1.0 else 0.0 end) filter (where factor = '{c}'), 0.0) - coalesce(max(case when x <= 0.1 then 1.0 else 0.0 end) filter (where factor = '{c}'), 0.0))::double as {c}_tail" for c in TAIL_BASES)}
from panel left join tr on tr.month = panel.month and tr.instrument = panel.instrument group by panel.month, panel.instrument""",
    "feature_decay": f"""with {p._P}, {e._families()}, {e._decay('fe', LAGS)}, cn as (select factor, lag, count(*) as n_months from (select factor, lag, month, {p._c('a', 'b')} as ic from de_r group by all) where ic is not null group by all)
select factor, lag, round(ic_mean, 5) + 0 as ic_mean, n_months from de join cn using (factor, lag)""",
    "feature_shape": f"""with {p._P}, {e._families()}, lf as materialized (select factor, month, instrument, value, fwd_ret_1m from fe){e._SHAPE}, rk as (select factor, month, {p._rank('value', 'factor, month')} as a, {p._rank('fwd_ret_1m', 'factor, month')} as b from fe where value is not null and fwd_ret_1m is not null),
im as (select factor, avg(ic) as ic_mean from (select factor, month, {p._c('a', 'b')} as ic from rk group by all) where ic is not null group by factor having count(*) >= 3),
au as (select factor, ann_spread as spread, monotonic, round(ic_mean, 12) as ic_mean, sign(round(ic_mean, 12)) = sign(round(ann_spread, 12)) as direction_ok from im join sx using (factor))
select factor, round(spread, 4) + 0 as ann_spread, monotonic, round(ic_mean, 4) + 0 as ic_mean, direction_ok, case when not direction_ok and abs(ic_mean) > 0.01 then 'WRONG_DIR' else 'OK' end as issue from au""",
    "feature_regimes": f"""with {p._P}, {e._families()}, sm as (select month, round(quantile_cont(vol_20d, 0.5), 9) as vol from panel group by month), sr as (select month, case when vol <= (select quantile_cont(vol, 0.5) from sm) then 'risk_on' else 'risk_off' end as regime from sm where vol is not null),
rk as (select factor, month, {p._rank('value', 'factor, month')} as a, {p._rank('fwd_ret_1m', 'factor, month')} as b from fe where value is not null and fwd_ret_1m is not null),
ic as (select * from (select factor, month, {p._c('a', 'b')} as ic from rk group by all) where ic is not null)
select factor, regime, count(*) as n, round(avg(ic), 5) + 0 as ic, case when stddev_samp(ic) > 0 then round(avg(ic) / stddev_samp(ic), 5) + 0 end as icir from ic join sr using (month) group by all""",
    "feature_loadings": f"""with {p._P}, {e._families()}, r as (select factor, fe.month, {p._rank('mom_accel', 'factor, fe.month')} as a, {p._rank('value', 'factor, fe.month')} as b from fe join panel on panel.month = fe.month and panel.instrument = fe.instrument where mom_accel is not null and value is not null)
select factor, round(avg(rho), 5) + 0 as mean_corr, round(stddev_samp(rho), 5) + 0 as std_corr, count(*) as n_months from (select factor, month, {p._c('a', 'b')} as rho from r group by all) where rho is not null group by factor""",
    "book_nav": f"""with {p._S}, bk as {p._tilt('0.004')}, dy as (select distinct date, date_trunc('month', date)::date as m from base), gr as (select dy.date, dy.m, bk.instrument, port_w as w, coalesce(r, 0) as r from dy join bk on bk.month = dy.m - interval 1 month left join base on base.instrument = bk.instrument and base.date = dy.date),
g2 as (select *, product(1 + r) over (partition by m, instrument order by date) as g from gr), lv as (select m, date, sum(w * g) as level, sum(w) as whole from g2 group by m, date),
rt as (select date, level / coalesce(lag(level) over (partition by m order by date), whole) - 1 as port_ret from lv)
select date, round(port_ret, 6) + 0 as port_ret, round(sum(ln(1 + port_ret)) over (order by date), 6) + 0 as log_nav from rt""",
    "stress_score": f"""with {p._P}, m0 as (select month, round(avg(ret_1m), 12) as bench_ret, round(stddev_samp(ret_1m), 12) as cs_dispersion from panel group by month),
m1 as (select *, case when count(bench_ret) over w6 >= 3 then round(stddev_samp(bench_ret) over w6, 12) end as bench_vol, round(sum(bench_ret) over (order by month rows 2 preceding), 12) as bench_momentum from m0 window w6 as (order by month rows 5 preceding)),
m2 as (select *, round(bench_vol - avg(bench_vol) over (order by month rows 5 preceding), 12) as vol_trend, month <= date '{UNTIL}' as train from m1),
v as (select month, train, variable, coalesce(value, 0) as value, case variable {' '.join(f"when '{c}' then {w}" for c, w in regimes.STRESS.items())} end as weight from (select month, train, {', '.join(regimes.STRESS)} from m2) unpivot include nulls (value for variable in ({', '.join(regimes.STRESS)}))),
x as (select v.*, (select count(*) from v t where t.train and t.variable = v.variable and t.value < v.value) as below, (select count(*) from v t where t.train and t.variable = v.variable) as n,
  row_number() over (partition by variable, value, train order by month) - 1 as tie from v),
sc as (select month, train, round(sum(weight * (below + 0.5) / n), 12) as stress, round(sum(weight * (below + tie + 0.5) / n), 12) as fit from x group by month, train),
cu as (select quantile_cont(fit, 0.33) as a, quantile_cont(fit, 0.67) as b from sc where train)
select month, train, round(stress, 6) + 0 as stress, case when stress < a then 0 when stress >= b then 2 else 1 end as regime, round(least(abs(stress - (a + b) / 2) / greatest(b - a, 1e-6), 1), 6) + 0 as confidence from sc cross join cu where a is not null""",
}
