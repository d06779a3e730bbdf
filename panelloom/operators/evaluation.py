"""Tests, screens and weights of factors, over the long form of statistics.py or over its monthly correlations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import crosssection
from panelloom.operators.crosssection import MIXERS, PRIME  # noqa: F401
from panelloom.operators.panel import average_rank
from panelloom.operators.statistics import _corr


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t with whole degrees of freedom, by the finite series in cos(atan(|t| / sqrt(freedom)))."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    square, even = F.cos(angle) * F.cos(angle), freedom % 2 == 0
    last = F.when(even, freedom / 2 - 1).otherwise((freedom - 3) / 2).cast("int")
    ratio = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
    steps = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: k <= last)

    def step(a, k):
        term = a["term"] * ratio(k) * square
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]
    odd = F.when(freedom == 1, angle).otherwise(angle + F.sin(angle) * F.cos(angle) * series) * (2 / math.pi)
    return F.when((freedom >= 1) & t.isNotNull(), 1 - F.when(even, F.sin(angle) * series).otherwise(odd))


def student_quantile(freedom: Column, p: float = 0.05, steps: int = 40) -> Column:
    """The t whose two-sided p-value is p, by halving an interval; for a few rows, as each step sums the series."""

    def half(a, _):
        middle = (a["lo"] + a["hi"]) / 2
        small = student_p(middle, freedom) <= p
        return F.struct(F.when(small, a["lo"]).otherwise(middle).alias("lo"), F.when(small, middle).otherwise(a["hi"]).alias("hi"))

    return F.when(freedom >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(64.0).alias("hi")), half)["hi"])


def tests_of(summary: DataFrame) -> DataFrame:
    """factor, p: of the mean IC's t statistic with one degree of freedom less than there are months."""
    return summary.select("factor", F.round(student_p(F.col("t_stat"), F.col("n_months") - 1), 9).alias("p"))


def step_up_grid(tests: DataFrame, levels: list[float]) -> DataFrame:
    """level, test (bh or bhy), rejected: how many tests each level of the step-up test rejects.

    The tests are crossed with the grid, a literal of a few entries, and ranked in one window for each of these.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.lit(name).alias("test")) for x in levels for name in ("bh", "bhy")]))
    rows = tests.filter("p is not null").select("factor", "p", grid.alias("g")).select("factor", "p", "g.*")
    whole = Window.partitionBy("level", "test")
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy("p", "factor")))
    penalty = F.when(F.col("test") == "bhy", F.sum(1 / F.col("rank")).over(whole)).otherwise(1.0)
    rows = rows.withColumn("under", F.col("p") <= F.col("rank") * F.col("level") / (F.count("*").over(whole) * penalty))
    last = rows.groupBy("level", "test").agg(F.max(F.when(F.col("under"), F.col("rank"))).alias("last"))
    return last.select("level", "test", F.coalesce("last", F.lit(0)).cast("long").alias("rejected"))


def ic_decay_daily(long: DataFrame, bars: DataFrame, horizons: list[int], least: int = 20) -> DataFrame:
    """factor, horizon, ic_mean, n_months: values of month-end rows (with date) against returns of so many market days on."""
    days = bars.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    closes = bars.select("instrument", "date", "close").join(F.broadcast(days), "date")
    now = long.filter("value is not null").join(closes, ["instrument", "date"]).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    later = closes.select("instrument", F.col("day").alias("then"), F.col("close").alias("later"))
    rows = now.withColumn("then", F.col("day") + F.col("horizon")).join(later, ["instrument", "then"])
    rows = rows.select("factor", "month", "horizon", "value", (F.col("later") / F.col("close") - 1).alias("ahead"))
    ranked = rows.withColumns({"value": average_rank(F.col("value"), "factor", "horizon", "month"), "ahead": average_rank(F.col("ahead"), "factor", "horizon", "month")})
    ic = ranked.groupBy("factor", "horizon", "month").agg(_corr("value", "ahead", least).alias("ic")).filter("ic is not null")
    return ic.groupBy("factor", "horizon").agg(F.avg("ic").alias("ic_mean"), F.count("*").alias("n_months"))


def shuffle_tests(rows: DataFrame, columns: list[str], sims: int = 100, least: int = 20) -> DataFrame:
    """factor, ic_mean, icir, p, p_icir: two-sided shares of shuffles within months whose mean IC, or its ratio to their spread, is as large.

    A shuffle gives each row the return of the row at its place in an order of drawn numbers, a cube modulo a prime that SQL
    can compute too. All shuffles of a month are made where its rows are, and one number of each comes back.
    """
    return shuffle_shares(crosssection.shuffled_ics(rows, columns, sims, least))


def shuffle_shares(ic: DataFrame) -> DataFrame:
    """The same from factor, sim, ic of each month."""
    means = ic.groupBy("factor", "sim").agg(F.avg("ic").alias("m"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).alias("ir"))
    # one number a factor and shuffle: a window of all shuffles of a factor is a small one
    real = Window.partitionBy("factor")
    means = means.withColumns({"ic_mean": F.max(F.when(F.col("sim") == 0, F.col("m"))).over(real), "icir": F.max(F.when(F.col("sim") == 0, F.col("ir"))).over(real)})
    large = lambda x, y: F.avg((F.round(F.abs(x), 12) >= F.round(F.abs(y), 12)).cast("double"))
    return means.filter("sim > 0 and ic_mean is not null").groupBy("factor", "ic_mean", "icir").agg(large("m", "ic_mean").alias("p"), large("ir", "icir").alias("p_icir"))


def oos_diagnostic(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """factor, ic_is, ic_oos, icir_oos, n_oos_months, sign_flip, decay_ratio, label, from monthly ICs of two periods."""
    mean = lambda df: df.groupBy("factor").agg(F.round(F.avg("ic"), 12).alias("m"), F.stddev_samp("ic").alias("s"), F.count("*").alias("n"))
    both = mean(inside).select("factor", F.col("m").alias("ic_is")).join(mean(outside), "factor", "left")
    both = both.select("factor", "ic_is", F.col("m").alias("ic_oos"), F.when(F.col("s") > 0, F.col("m") / F.col("s")).alias("icir_oos"), F.coalesce("n", F.lit(0)).alias("n_oos_months"))
    flip = F.coalesce(F.signum("ic_is") != F.signum("ic_oos"), F.lit(False))
    ratio = F.when(F.abs("ic_is") > 1e-6, F.col("ic_oos") / F.col("ic_is"))
    both = both.withColumns({"sign_flip": flip, "decay_ratio": ratio})
    label = F.when(F.col("sign_flip"), "FLIP").when(F.col("decay_ratio").isNull() | (F.abs("decay_ratio") >= 0.5), "stable").otherwise("decay")
    return both.withColumn("label", label)


def monotonic(long: DataFrame, buckets: DataFrame, count: int = 5) -> DataFrame:
    """factor, ann_spread, monotonic, from rows with buckets: mean returns of the buckets only rise or only fall."""
    return monotonic_of(buckets.groupBy("factor", "bucket").agg(F.avg("fwd_ret_1m").alias("ret")), count)


def monotonic_of(means: DataFrame, count: int = 5) -> DataFrame:
    """The same from factor, bucket, ret."""
    means = means.withColumn("ret", F.round("ret", 12))
    out = means.groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("bucket", "ret"))).alias("x"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: F.element_at("x", i + 1)["ret"] - F.element_at("x", i)["ret"])
    whole = F.size("x") == count
    out = out.withColumn("steps", F.when(whole, steps))
    one_way = F.forall("steps", lambda s: s > 0) | F.forall("steps", lambda s: s < 0)
    return out.filter(whole).select("factor", ((F.element_at("x", -1)["ret"] - F.element_at("x", 1)["ret"]) * 12).alias("ann_spread"), one_way.alias("monotonic"))


def decay_weights(summary: DataFrame, stable: DataFrame, decay: DataFrame, shape: DataFrame) -> DataFrame:
    """factor, ic_mean, use_partial, raw, weight: factors with an IC that is stable over regimes, weighed by their mean |IC| over lags.

    Factors whose buckets are not monotonic are marked for partial use; untested ones are used whole.
    """
    kept = summary.filter(F.abs("ic_mean") > 0).join(stable.filter("stable").select("factor"), "factor")
    raw = decay.groupBy("factor").agg(F.avg(F.abs("ic_mean")).alias("raw"))
    rows = kept.select("factor", "ic_mean").join(raw, "factor", "left").join(shape.select("factor", "monotonic"), "factor", "left")
    rows = rows.withColumns({"raw": F.coalesce("raw", F.abs("ic_mean")), "use_partial": F.coalesce(~F.col("monotonic"), F.lit(False))})
    return rows.select("factor", "ic_mean", "use_partial", "raw", (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("weight"))


def monthly_moments(panel: DataFrame, columns: list[str], target: str) -> DataFrame:
    """month, n and, of rows that have all, the means and second moments of columns and target: a row a month for the driver."""
    rows = panel.dropna(subset=[*columns, target])
    names = [*columns, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("month").agg(F.count("*").alias("n"), *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])


def optimal_weights(panel: DataFrame, columns: list[str], target: str, epochs: int = 500, rate: float = 0.01, least: int = 20) -> DataFrame:
    """factor, weight: softmax weights that raise the mean monthly Pearson IC of the weighted sum, by Adam.

    The IC of a weighted sum depends on each month's covariances alone, so only these (months times factors squared) come
    to the driver, whatever the panel's size.
    """
    k = len(columns)
    months = monthly_moments(panel, columns, target).filter(F.col("n") >= least).orderBy("month").collect()
    if not months:
        return panel.sparkSession.createDataFrame([], "factor string, weight double")
    whole = np.zeros((len(months), k + 1, k + 1))
    for r, row in enumerate(months):
        for i in range(k + 1):
            for j in range(i, k + 1):
                whole[r, i, j] = whole[r, j, i] = row[f"c{i}_{j}"]
    cov, with_target, spread = whole[:, :k, :k], whole[:, :k, k], np.sqrt(whole[:, k, k])
    x, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    for epoch in range(1, epochs + 1):
        w = np.exp(x - x.max())
        w /= w.sum()
        size = np.sqrt(np.einsum("i,rij,j->r", w, cov, w)) + 1e-12
        up = with_target / (size * spread + 1e-12)[:, None] - (with_target @ w)[:, None] * (cov @ w) / (size**3 * spread + 1e-12)[:, None]
        g = -up.mean(axis=0)
        g = w * (g - w @ g)  # through the softmax
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    w = np.exp(x - x.max())
    return panel.sparkSession.createDataFrame([(c, float(a)) for c, a in zip(columns, w / w.sum())], "factor string, weight double")


def weight_floors(long: DataFrame, weights: DataFrame, floors: list[float], least: int = 20, least_months: int = 12) -> DataFrame:
    """weight_floor, factor, ic, t, n_obs: the IC's t statistic among rows of at least so much weight, and returns of at most one in size."""
    rows = long.filter("value is not null and abs(fwd_ret_1m) <= 1").join(weights.select("month", "instrument", "weight"), ["month", "instrument"])
    rows = rows.withColumn("weight_floor", F.explode(F.array(*map(F.lit, floors)))).filter(F.col("weight") >= F.col("weight_floor"))
    ranked = rows.withColumns({"a": average_rank(F.col("value"), "weight_floor", "factor", "month"), "b": average_rank(F.col("fwd_ret_1m"), "weight_floor", "factor", "month")})
    ic = ranked.groupBy("weight_floor", "factor", "month").agg(F.count("*").alias("n"), _corr("a", "b", least).alias("ic"))
    out = ic.groupBy("weight_floor", "factor").agg(F.sum("n").alias("n_obs"), F.count("ic").alias("months"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("s"))
    enough = F.col("months") >= least_months
    return out.select("weight_floor", "factor", F.when(enough, F.col("ic")).alias("ic"), F.when(enough & (F.col("s") > 1e-12), F.col("ic") / (F.col("s") / F.sqrt("months"))).alias("t"), "n_obs")


def closest(pairs: DataFrame, limit: float = 0.85) -> DataFrame:
    """factor, closest, max_corr, is_duplicate: the other factor with the largest mean correlation in size; ties to the smaller name."""
    both = pairs.select(F.col("a").alias("factor"), F.col("b").alias("other"), "rho").union(pairs.select(F.col("b").alias("factor"), F.col("a").alias("other"), "rho"))
    both = both.withColumn("size", F.round(F.abs("rho"), 12))
    best = Window.partitionBy("factor").orderBy(F.desc("size"), "other")
    out = both.withColumn("at", F.row_number().over(best)).filter("at = 1")
    return out.select("factor", F.col("other").alias("closest"), F.col("size").alias("max_corr"), (F.col("size") > limit).alias("is_duplicate"))


def screening(summary: DataFrame, decay: DataFrame, near: DataFrame, shuffled: DataFrame, ic: float = 0.02, icir: float = 0.3, ratio: float = 0.3, level: float = 0.2) -> DataFrame:
    """A catalogue of factors: what they pass of IC, ICIR, persistence, duplication and the shuffle test, and the step-up test over all."""
    lags = decay.groupBy("factor").agg(*[F.max(F.when(F.col("lag") == k, F.col("ic_mean"))).alias(f"ic_lag{k}") for k in (1, 3)])
    rows = summary.select("factor", "ic_mean", "ic_std", "icir").join(lags, "factor", "left").join(near, "factor", "left").join(shuffled.select("factor", F.col("p_icir").alias("ras_p")), "factor", "left")
    rows = rows.withColumns({"ic_lag1": F.coalesce("ic_lag1", F.lit(0.0)), "ic_lag3": F.coalesce("ic_lag3", F.lit(0.0)), "is_duplicate": F.coalesce("is_duplicate", F.lit(False))})
    rows = rows.withColumns({
        "pass_ic": F.abs("ic_mean") > ic, "pass_icir": F.coalesce(F.abs("icir") > icir, F.lit(False)), "pass_persistence": F.abs("ic_lag1") > ratio * F.abs("ic_mean"), "pass_dedup": ~F.col("is_duplicate"),
        "ras_p": F.when(~F.col("is_duplicate"), F.col("ras_p")),
    })
    rows = rows.withColumn("pass_ras", F.coalesce(F.col("ras_p") < 0.05, F.lit(False)))
    # one row a factor
    whole = Window.partitionBy()
    rows = rows.withColumns({"_p": F.coalesce("ras_p", F.lit(1.0)), "_m": F.count("*").over(whole)})
    rows = rows.withColumn("_k", F.row_number().over(Window.orderBy("_p", "factor")))
    rows = rows.withColumn("_c", F.sum(1 / F.col("_k")).over(whole))
    rows = rows.withColumn("_last", F.max(F.when(F.col("_p") <= F.col("_k") * level / (F.col("_m") * F.col("_c")), F.col("_k"))).over(whole))
    rows = rows.withColumn("pass_bhy", F.coalesce(F.col("_k") <= F.col("_last"), F.lit(False)))
    return rows.withColumn("pass_all", F.col("pass_dedup") & F.col("pass_ras") & F.col("pass_bhy")).drop("_p", "_m", "_k", "_c", "_last")


def score_loadings(panel: DataFrame, score: str, columns: list[str], least: int = 20) -> DataFrame:
    """factor, mean_corr, std_corr, n_months: the monthly rank correlations of a score with each column, by one visit to a month's rows."""
    rho = crosssection.monthly_ic(panel, columns, score, least)
    return rho.groupBy("factor").agg(F.avg("ic").alias("mean_corr"), F.stddev_samp("ic").alias("std_corr"), F.count("*").alias("n_months"))


def rolling_ic(ic: DataFrame, months: int = 6, least: int = 3) -> DataFrame:
    """Adds roll_mean and roll_std of each factor's last months."""
    last = Window.partitionBy("factor").orderBy("month").rowsBetween(-(months - 1), 0)
    enough = F.count("ic").over(last) >= least
    return ic.withColumns({"roll_mean": F.when(enough, F.avg("ic").over(last)), "roll_std": F.when(enough, F.stddev_samp("ic").over(last))})


def ic_by_regime(ic: DataFrame, state: DataFrame, x: str) -> DataFrame:
    """factor, regime, n, ic, icir in months with a state at most its median, and above. state: one row a month."""
    median = state.agg(F.percentile(x, 0.5).alias("_cut"))
    split = state.join(F.broadcast(median), F.col(x).isNotNull()).select("month", F.when(F.col(x) <= F.col("_cut"), "risk_on").otherwise("risk_off").alias("regime"))
    out = ic.join(F.broadcast(split), "month").groupBy("factor", "regime").agg(F.count("*").alias("n"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("s"))
    return out.select("factor", "regime", "n", "ic", F.when(F.col("s") > 0, F.col("ic") / F.col("s")).alias("icir"))


def direction_audit(summary: DataFrame, shape: DataFrame, least: float = 0.01) -> DataFrame:
    """factor, ic_mean, ann_spread, direction_ok, issue: whether the mean IC and the buckets' spread have one sign."""
    both = summary.select("factor", F.round("ic_mean", 12).alias("ic_mean")).join(shape.select("factor", F.round("ann_spread", 12).alias("ann_spread")), "factor")
    ok = F.signum("ic_mean") == F.signum("ann_spread")
    return both.withColumn("direction_ok", ok).withColumn("issue", F.when(~ok & (F.abs("ic_mean") > least), "WRONG_DIR").otherwise("OK"))


def regime_moves(panel: DataFrame, regime: str, target: str, until: str) -> DataFrame:
    """Mean size and direction of later returns within a regime (1) and outside (0), their ratio, and how many, up to a date."""
    rows = panel.filter((F.col("month") <= F.lit(until).cast("date")) & F.col(regime).isNotNull() & F.col(target).isNotNull())
    part = lambda v, x: F.avg(F.when(F.col(regime) == v, x))
    size, up = F.abs(target), (F.col(target) > 0).cast("double")
    out = rows.agg(part(1, size).alias("mean_abs_low"), part(0, size).alias("mean_abs_high"), part(1, up).alias("up_low"), part(0, up).alias("up_high"), F.count(F.when(F.col(regime) == 1, 1)).alias("n_low"), F.count(F.when(F.col(regime) == 0, 1)).alias("n_high"))
    return out.withColumn("ratio", F.col("mean_abs_low") / (F.col("mean_abs_high") + 1e-9))


def score_losses(scored: DataFrame, score: str, target: str, top: int = 20) -> DataFrame:
    """month, mse, neg_ic, top_reward: the losses of a ranker as aggregates: squared error, minus Pearson IC, softmax-weighted return of the best."""
    rows = scored.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    month = Window.partitionBy("month")
    rows = rows.withColumns({"_k": F.row_number().over(month.orderBy(F.desc(score), "instrument")), "_z": F.col(score) - F.max(score).over(month)})
    soft = F.when(F.col("_k") <= top, F.exp("_z"))
    out = rows.groupBy("month").agg(F.avg(F.pow(F.col(score) - F.col(target), 2)).alias("mse"), _corr(score, target, 3).alias("_ic"), (F.sum(soft * F.col(target)) / F.sum(soft)).alias("top_reward"))
    return out.select("month", "mse", (-F.col("_ic")).alias("neg_ic"), "top_reward")
