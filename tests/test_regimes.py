import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import regimes


def month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


def plain_stress(x, weights, n, low=0.33, high=0.67):
    score, fit = np.zeros(len(x)), np.zeros(n)
    for c, w in weights.items():
        v = np.nan_to_num(x[c].to_numpy(), nan=0.0, posinf=0.0, neginf=0.0)
        ref = np.sort(v[:n])
        score += w * (np.searchsorted(ref, v, side="left") + 0.5) / n
        ranks = np.empty(n)
        ranks[np.argsort(v[:n], kind="stable")] = (np.arange(n) + 0.5) / n
        fit += w * ranks
    a, b = np.quantile(fit, [low, high])
    return score, np.where(score < a, 0, np.where(score >= b, 2, 1)), np.minimum(abs(score - (a + b) / 2) / max(b - a, 1e-6), 1)


@pytest.mark.parametrize("digits", [1, 6])
def test_stress_against_plain(spark, digits):
    rng = np.random.default_rng(digits)
    x = pd.DataFrame(rng.normal(size=(150, 4)).round(digits), columns=list(regimes.STRESS))
    x.iloc[3, 1] = np.nan
    x.iloc[120, 0] = np.inf
    x.insert(0, "month", [month(k) for k in range(150)])
    got = regimes.stress_scores(spark.createDataFrame(x), regimes.STRESS, str(month(99))).orderBy("month").collect()
    score, regime, confidence = plain_stress(x, regimes.STRESS, 100)
    assert np.allclose([r.stress for r in got], score) and [r.regime for r in got] == regime.tolist() and np.allclose([r.confidence for r in got], confidence)
    early = regimes.stress_scores(spark.createDataFrame(x.iloc[:110]), regimes.STRESS, str(month(99))).orderBy("month").collect()
    assert [r.stress for r in early] == [r.stress for r in got[:110]]
    assert regimes.stress_scores(spark.createDataFrame(x), regimes.STRESS, "1990-01-01").count() == 0


def plain_hmm(x, states=2, rounds=200, tol=1e-4, ridge=0.01):
    """Baum-Welch of one series with scaled probabilities, row by row."""
    t, d = x.shape
    order = x[:, 0].argsort(kind="stable").argsort(kind="stable")
    g = np.array([[(min(order[i] * states // t, states - 1) == k) + 1e-3 for k in range(states)] for i in range(t)])
    start, turn = np.full(states, 1 / states), np.where(np.eye(states) > 0, 0.9, 0.1 / (states - 1))
    trail = []
    for _ in range(rounds + 1):
        if not trail or True:
            mean = [(g[:, [k]] * x).sum(0) / g[:, k].sum() for k in range(states)] if not trail else mean
            cov = [(sum(g[i, k] * np.outer(x[i] - mean[k], x[i] - mean[k]) for i in range(t)) + 2 * ridge * np.eye(d)) / g[:, k].sum() for k in range(states)] if not trail else cov
        dens = np.array([[math.exp(-0.5 * (x[i] - mean[k]) @ np.linalg.inv(cov[k]) @ (x[i] - mean[k])) / math.sqrt((2 * math.pi) ** d * np.linalg.det(cov[k])) for k in range(states)] for i in range(t)])
        a, c = np.zeros((t, states)), np.zeros(t)
        for i in range(t):
            a[i] = dens[i] * (start if i == 0 else a[i - 1] @ turn)
            c[i] = a[i].sum()
            a[i] /= c[i]
        b = np.ones((t, states))
        for i in range(t - 2, -1, -1):
            b[i] = turn @ (dens[i + 1] * b[i + 1]) / c[i + 1]
        now = np.log(c).sum() - ridge * sum(np.trace(np.linalg.inv(s)) for s in cov)
        if trail and now - trail[-1] < tol:
            break
        trail.append(now)
        g = a * b
        pairs = sum(np.outer(a[i - 1], dens[i] * b[i]) * turn / c[i] for i in range(1, t))
        start, turn = g[0], pairs / pairs.sum(1, keepdims=True)
        mean = [(g[:, [k]] * x).sum(0) / g[:, k].sum() for k in range(states)]
        cov = [(sum(g[i, k] * np.outer(x[i] - mean[k], x[i] - mean[k]) for i in range(t)) + 2 * ridge * np.eye(d)) / g[:, k].sum() for k in range(states)]
    return np.array(trail), a * b


def switching(rng, t):
    state = (np.cumsum(rng.random(t) < 0.1) + rng.integers(0, 2)) % 2
    return state, np.column_stack([np.where(state, 3, 1) + rng.normal(size=t) * 0.4, rng.normal(size=t) * np.where(state, 2, 0.7)])


def test_baum_welch_rises_and_equals_plain():
    rng = np.random.default_rng(0)
    lengths = [60, 25, 44]
    x, has = np.zeros((3, 60, 2)), np.arange(60) < np.array(lengths)[:, None]
    for i, t in enumerate(lengths):
        own = switching(rng, t)[1]
        x[i, :t] = (own - own.mean(0)) / own.std(0)
    (start, turn, mean, cov), dens, trail = regimes.baum_welch(x, has)
    assert (np.diff(trail, axis=0) >= -1e-9).all()
    state = np.exp(regimes.forward_backward(start, turn, dens, has)[1])
    for i, t in enumerate(lengths):
        own, g = plain_hmm(x[i, :t])
        rounds = len(own)
        assert np.allclose(trail[: min(rounds, len(trail)), i], own[: len(trail)], atol=1e-6)
        assert np.allclose(state[i, :t], g, atol=2e-2)
    assert np.allclose(np.exp(turn).sum(2), 1) and np.allclose(np.exp(start).sum(1), 1)


def test_many_series(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for k in range(40):
        t = int(rng.integers(30, 90)) if k else 11
        state, x = switching(rng, t)
        truth[k] = state
        rows += [(k, month(i), float(x[i, 0]), float(x[i, 1])) for i in range(t)]
    rows += [(99, month(i), 1.0, None) for i in range(20)]  # flat
    df = spark.createDataFrame(rows, "instrument long, month date, vol double, ret double").repartition(6)
    got = regimes.hidden_regimes(df, ["vol", "ret"], together=10).toPandas().sort_values(["instrument", "month"])
    assert set(got.instrument) == {*range(1, 40), 99}
    right = np.mean(np.concatenate([got[got.instrument == k].state.to_numpy() == truth[k] for k in range(1, 40)]))
    assert right > 0.93
    assert got.p_high.between(0, 1).all() and got.notna().all().all()
    assert ((got.p_high > 0.5).astype(int) == got.state).mean() > 0.97
    assert regimes.hidden_regimes(df.limit(0), ["vol", "ret"]).count() == 0


def test_a_finished_series_costs_no_more_rounds(monkeypatch):
    """rounds go on for the series that still gain alone."""
    rng = np.random.default_rng(4)
    x, has = np.zeros((3, 60, 2)), np.zeros((3, 60), bool)
    for i, t in enumerate((60, 40, 1)):
        own = switching(rng, t)[1]
        x[i, :t], has[i, :t] = (own - own.mean(0)) / np.maximum(own.std(0), 1e-9), True
    sizes, plain = [], regimes.forward_backward
    monkeypatch.setattr(regimes, "forward_backward", lambda start, *rest: sizes.append(len(start)) or plain(start, *rest))
    together = regimes.baum_welch(x, has)
    assert sizes[0] == 3 and sizes[-1] < 3 and sizes == sorted(sizes, reverse=True)
    for i in range(3):
        alone = regimes.baum_welch(x[i : i + 1], has[i : i + 1])
        assert all(np.allclose(a[i], b[0], atol=1e-9) for a, b in zip(together[0], alone[0]))
        assert np.isclose(together[2][-1, i], alone[2][-1, 0])
