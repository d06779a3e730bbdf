"""Regimes: a stress score against the distribution of earlier rows, and hidden Markov states of many series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.crosssection import _tasks

# ---------------------------------------------------------------- stress


def shares_below(rows: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """Adds below and n to rows of keys, variable, value, train: how many of a variable's training values are smaller, of how many.

    The distribution of the training rows is a table of counted values. It is cut into ranges at `parts` sampled quantiles of each
    variable and numbered within its range, so no task sees all of a variable's values; the ranges' sums (a row for each
    variable and range) are broadcast. Rows look up their value's number by a join, and a value met only later is counted as none.
    """
    train = rows.filter("train and value is not null")
    cuts = train.groupBy("variable").agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    values = rows.filter("value is not null").groupBy("variable", "value").agg(F.sum(F.col("train").cast("long")).alias("_t"))
    values = values.join(F.broadcast(cuts), "variable", "left").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("value"))), F.lit(0))).drop("_cuts")
    before = lambda *k: Window.partitionBy(*k[:-1]).orderBy(k[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy("variable", "_part").agg(F.sum("_t").alias("_s"))
    sums = sums.select("variable", "_part", F.coalesce(F.sum("_s").over(before("variable", "_part")), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy("variable")).alias("n"))
    numbered = values.withColumn("_in", F.coalesce(F.sum("_t").over(before("variable", "_part", "value")), F.lit(0))).join(F.broadcast(sums), ["variable", "_part"])
    told = numbered.select("variable", "value", (F.col("_base") + F.col("_in")).alias("below"), "n")
    return rows.select(*keys, "variable", "value", "train").join(told, ["variable", "value"], "left")


def stress_scores(series: DataFrame, weights: dict[str, float], until: str, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """month, train, stress, regime (0 risk on, 1 between, 2 risk off) and confidence of a table of one row a month.

    stress is the weighted sum of each variable's share of training months (those up to `until`) with a smaller value, half a
    month added; missing values count as 0. The thresholds are the `low` and `high` quantiles of the training months' own
    scores, where equal values are told apart by month, so later rows change neither the thresholds nor an earlier score.
    """
    names = list(weights)
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    rows = series.select("month", (F.col("month") <= F.lit(until).cast("date")).alias("train"), *[finite(c).alias(c) for c in names])
    long = shares_below(rows.unpivot(["month", "train"], names, "variable", "value"), ["month"])
    weight = F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("variable"))
    # among equal training values, the earlier month is the smaller: one value's months at a time
    tie = F.count("*").over(Window.partitionBy("variable", "value", "train").orderBy("month")) - 1
    long = long.withColumns({"_out": weight * (F.col("below") + 0.5) / F.col("n"), "_fit": F.when(F.col("train"), weight * (F.col("below") + tie + 0.5) / F.col("n"))})
    scored = long.groupBy("month", "train").agg(F.round(F.sum("_out"), 12).alias("stress"), F.round(F.sum("_fit"), 12).alias("_fit"))
    cut = scored.filter("train").agg(F.percentile("_fit", low).alias("_a"), F.percentile("_fit", high).alias("_b"))
    # one row
    scored = scored.join(F.broadcast(cut), F.lit(True)).filter("_a is not null")
    away = F.abs(F.col("stress") - (F.col("_a") + F.col("_b")) / 2) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-6))
    return scored.select("month", "train", "stress", F.when(F.col("stress") < F.col("_a"), 0).when(F.col("stress") >= F.col("_b"), 2).otherwise(1).alias("regime"), F.least(away, F.lit(1.0)).alias("confidence"))


def market_features(panel: DataFrame) -> DataFrame:
    """One row a month: bench_ret (mean return), bench_vol (spread over six months), bench_momentum (three months' sum), vol_trend, cs_dispersion."""
    months = panel.groupBy("month").agg(F.round(F.avg("ret_1m"), 12).alias("bench_ret"), F.round(F.stddev_samp("ret_1m"), 12).alias("cs_dispersion"))
    # one row a month
    last = lambda n: Window.orderBy("month").rowsBetween(-(n - 1), 0)
    months = months.withColumns({"bench_vol": F.when(F.count("bench_ret").over(last(6)) >= 3, F.round(F.stddev_samp("bench_ret").over(last(6)), 12)), "bench_momentum": F.round(F.sum("bench_ret").over(last(3)), 12)})
    return months.withColumn("vol_trend", F.round(F.col("bench_vol") - F.avg("bench_vol").over(last(6)), 12))


#: Weights of the stress score's variables: fixed values.
STRESS = {"bench_vol": 0.4, "bench_momentum": -0.3, "vol_trend": 0.2, "cs_dispersion": 0.1}

# ---------------------------------------------------------------- hidden states


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def _densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log densities (series, time, state) of x (series, time, dim) under each series' own normal states."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low[:, None], (x[:, :, None, :] - mean[:, None])[..., None])[..., 0]
    return -0.5 * (z**2).sum(-1) - np.log(np.diagonal(low, axis1=-2, axis2=-1)).sum(-1)[:, None] - 0.5 * x.shape[2] * np.log(2 * np.pi)


def forward_backward(start: np.ndarray, turn: np.ndarray, dens: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, log state probabilities (series, time, state) and log sums of pairs of states, in log space.

    Series of unequal length stand together; `has` marks their rows, which come first.
    """
    n, t, k = dens.shape
    a, b = np.empty((n, t, k)), np.zeros((n, t, k))
    a[:, 0] = start + dens[:, 0]
    for i in range(1, t):
        step = _log_sum(a[:, i - 1, :, None] + turn, 1) + dens[:, i]
        a[:, i] = np.where(has[:, i, None], step, a[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = _log_sum(turn + (dens[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        b[:, i] = np.where(has[:, i + 1, None], step, 0)
    whole = _log_sum(a[:, -1], 1)
    state = a + b - whole[:, None, None]
    pairs = np.full((n, k, k), -np.inf)
    for i in range(1, t):
        step = a[:, i - 1, :, None] + turn + (dens[:, i] + b[:, i])[:, None, :] - whole[:, None, None]
        pairs = np.where(has[:, i, None, None], np.logaddexp(pairs, step), pairs)
    return whole, state, pairs


def most_likely(start: np.ndarray, turn: np.ndarray, dens: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The most likely path of states of each series."""
    n, t, k = dens.shape
    best, back = start + dens[:, 0], np.zeros((n, t, k), int)
    for i in range(1, t):
        step = best[:, :, None] + turn
        back[:, i] = np.where(has[:, i, None], step.argmax(1), np.arange(k))
        best = np.where(has[:, i, None], step.max(1) + dens[:, i], best)
    path = np.empty((n, t), int)
    path[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = np.take_along_axis(back[:, i], path[:, i, None], 1)[:, 0]
    return path


def baum_welch(x: np.ndarray, has: np.ndarray, states: int = 2, rounds: int = 200, tol: float = 1e-4, ridge: float = 0.01):
    """Parameters, log densities and the objective after each round, for series x (series, time, dim) that each have a row at least.

    States start as runs of the first variable in order of size, with means of their own. A round is one step of expectation and
    maximisation; `ridge` is the weight of a prior that keeps covariances from collapsing, so what never falls is the log
    likelihood less ridge times the trace of each inverse covariance. A series stops when a round gains less than `tol`.
    """
    n, t, d = x.shape
    order = np.where(has, x[:, :, 0], np.inf).argsort(1, kind="stable").argsort(1, kind="stable")
    own = np.minimum(order * states // np.maximum(has.sum(1), 1)[:, None], states - 1)
    g = (own[:, :, None] == np.arange(states)) * has[:, :, None] + 1e-3 * has[:, :, None]
    start, turn = np.full((n, states), -np.log(states)), np.log(np.full((n, states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)))

    def shapes(x, g):
        total = g.sum(1)
        mean = np.einsum("ntk,ntd->nkd", g, x) / np.maximum(total, 1e-300)[..., None]
        off = x[:, :, None, :] - mean[:, None]
        cov = np.einsum("ntk,ntkd,ntke->nkde", g, off, off) + 2 * ridge * np.eye(d)
        return mean, cov / np.maximum(total, 1e-12)[..., None, None]

    mean, cov = shapes(x, g)
    # only series that still gain are worked on
    active, trail = np.arange(n), []
    while len(active):
        whole, state, pairs = forward_backward(start[active], turn[active], _densities(x[active], mean[active], cov[active]), has[active])
        now = whole - ridge * np.trace(np.linalg.inv(cov[active]), axis1=-2, axis2=-1).sum(1)
        gains = now - trail[-1][active] >= tol if trail else np.ones(n, bool)
        trail.append(trail[-1].copy() if trail else np.empty(n))
        active = active[gains]
        trail[-1][active] = now[gains]
        if len(trail) > rounds:
            break
        state, pairs = state[gains], pairs[gains]
        turned = pairs - _log_sum(pairs, 2)[..., None]
        # a series of one row has no pairs
        start[active], turn[active] = state[:, 0], np.where(np.isfinite(turned), np.maximum(turned, -700), -np.log(states))
        mean[active], cov[active] = shapes(x[active], np.exp(state) * has[active][:, :, None])
    dens = _densities(x, mean, cov)
    return (start, turn, mean, cov), dens, np.array(trail)


def _states(variables: list[str], key: str, order: str, least: int, states: int, rounds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, order], kind="stable", ignore_index=True)
        _, who, length = np.unique(rows[key].to_numpy(), return_inverse=True, return_counts=True)
        rows = rows[length[who] >= least].reset_index(drop=True)
        out = pd.DataFrame({key: rows[key], order: rows[order], "state": np.zeros(len(rows), np.int32), "p_high": np.zeros(len(rows)), "log_likelihood": np.zeros(len(rows))})
        if len(rows):
            _, first, who, length = np.unique(rows[key].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            at = np.arange(len(rows)) - first[who]
            x = np.zeros((len(first), length.max(), len(variables)))
            x[who, at] = np.nan_to_num(rows[variables].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
            has = np.arange(length.max()) < length[:, None]
            m = has[:, :, None]
            mean = (x * m).sum(1, keepdims=True) / length[:, None, None]
            spread = np.sqrt((((x - mean) * m) ** 2).sum(1, keepdims=True) / length[:, None, None])
            x = (x - mean) / np.where(spread > 1e-12, spread, 1) * m
            (start, turn, centre, _), dens, trail = baum_welch(x, has, states, rounds)
            whole, state, _ = forward_backward(start, turn, dens, has)
            # states are numbered by the mean of the first variable
            rank = centre[:, :, 0].argsort(1, kind="stable").argsort(1, kind="stable")
            path = most_likely(start, turn, dens, has)
            out["state"] = rank[who, path[who, at]].astype(np.int32)
            top = rank.argmax(1)
            out["p_high"] = np.exp(np.minimum(state[who, at, top[who]], 0))
            out["log_likelihood"] = whole[who]
        return out

    return run


def hidden_regimes(series: DataFrame, variables: list[str], key: str = "instrument", order: str = "month", least: int = 12, states: int = 2, rounds: int = 200, together: int = 512, series_count: int | None = None) -> DataFrame:
    """key, order, state (by the most likely path; numbered by the first variable's mean), p_high (of the highest state) and log_likelihood.

    Each series with `least` rows has a hidden Markov model of its own, with normal states of full covariance over the
    variables, in units of the series' own spread; missing values are 0. About `together` series are one group, whose rounds
    run side by side, so a task holds that many histories whatever the number of series; a history is as long as the calendar. `series_count` (about how
    many there are) saves counting them. Adaptive execution doesn't merge the groups' tasks by their few bytes.
    """
    n = series_count if series_count is not None else series.agg(F.approx_count_distinct(key)).first()[0]
    group: Column = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // together))))
    kinds = dict(series.dtypes)
    rows = series.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, *[F.col(c).cast("double").alias(c) for c in variables], group.alias("_group"))
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, state int, p_high double, log_likelihood double"
    return rows.repartition(_tasks(rows), "_group").groupBy("_group").applyInPandas(lambda x: _states(variables, key, order, least, states, rounds)(x.drop(columns="_group")), schema)
