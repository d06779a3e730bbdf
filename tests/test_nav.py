import datetime as dt

import numpy as np
import pytest

from panelloom.operators import riskparity
from panelloom.operators.asof import interval_join

DAY = dt.date(2000, 1, 1)


@pytest.mark.parametrize("width", [1, 7, 500])
def test_interval_join_against_all_pairs(spark, width):
    rng = np.random.default_rng(width)
    points = [(int(k), DAY + dt.timedelta(days=int(d)), i) for i, (k, d) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-60, 200, 300)))]
    spans = [(int(k), DAY + dt.timedelta(days=int(a)), DAY + dt.timedelta(days=int(a + n)), i) for i, (k, a, n) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(-60, 200, 60), rng.integers(-3, 40, 60)))]
    got = interval_join(spark.createDataFrame(points, "k int, at date, p int"), spark.createDataFrame(spans, "k int, a date, b date, s int"), "k", "at", "a", "b", width)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for k, d, p in points for j, a, b, s in spans if j == k and a <= d <= b)


@pytest.mark.parametrize("drift", [True, False])
def test_nav_equal_to_plain(spark, drift):
    rng = np.random.default_rng(3)
    days = [DAY + dt.timedelta(days=i) for i in range(150)]
    r = {(i, d): float(rng.normal() * 0.02) for i in range(5) for d in days if rng.random() < 0.9}
    weights = {(dt.date(2000, m, 1), i): float(rng.random()) for m in (1, 2, 3) for i in range(5) if (m + i) % 4}
    daily = spark.createDataFrame([(i, d, x) for (i, d), x in r.items()] + [(0, dt.date(2000, 2, 10), None)], "instrument int, date date, r double").dropDuplicates(["instrument", "date"])
    r = {(x.instrument, x.date): x.r for x in daily.collect() if x.r is not None}
    got = riskparity.daily_nav(spark.createDataFrame([(m, i, w) for (m, i), w in weights.items()], "month date, instrument int, weight double"), daily, drift).orderBy("date").collect()
    nav, want = 1.0, []
    for m in (2, 3, 4):
        own = {i: w for (month, i), w in weights.items() if month == dt.date(2000, m - 1, 1)}
        whole = sum(own.values())
        for d in [x for x in days if x.month == m]:
            moved = {i: w * (1 + r.get((i, d), 0.0)) for i, w in own.items()}
            ret = sum(moved.values()) / sum(own.values()) - 1 if drift else sum(w * r.get((i, d), 0.0) for i, w in own.items())
            nav *= 1 + ret
            want.append((d, ret, nav))
            if drift:
                own = moved
        assert whole > 0
    assert [x.date for x in got] == [x[0] for x in want]
    assert np.allclose([(x.port_ret, x.nav) for x in got], [x[1:] for x in want])


def test_covariance_diagnostics(spark):
    rng = np.random.default_rng(4)
    days = [DAY + dt.timedelta(days=i) for i in range(240)]
    x = rng.normal(size=(240, 6)) @ rng.normal(size=(6, 6)) * 0.01
    daily = spark.createDataFrame([(i, d, float(x[k, i])) for i in range(6) for k, d in enumerate(days)], "instrument long, date date, r double")
    scored = spark.createDataFrame([(dt.date(2000, m, 1), i, float(i if m == 6 else -i)) for m in (6, 7) for i in range(6)], "month date, instrument long, score double")
    out = riskparity.covariance_diagnostics(scored, daily, names=4, days=120).orderBy("month").collect()
    own = lambda m, names: np.cov(np.array([x[k] for k, d in enumerate(days) if dt.timedelta(0) <= m - d < dt.timedelta(days=120)])[:, names], rowvar=False)
    a, b = own(dt.date(2000, 6, 30), [2, 3, 4, 5]), own(dt.date(2000, 7, 31), [0, 1, 2, 3])
    assert [r.n for r in out] == [4, 4] and np.isclose(out[0].raw_cond, np.linalg.cond(a)) and np.isclose(out[1].raw_cond, np.linalg.cond(b))
    assert out[0].raw_change is None and np.isclose(out[1].raw_change, np.linalg.norm(b[2:, 2:] - a[:2, :2]) / np.linalg.norm(a[:2, :2]))
    assert all(r.clean_cond > 1 and 0.95 <= r.explained <= 1 + 1e-9 for r in out)
