import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import merging, shuffles

D = dt.date


def test_side_tables_meet_by_base_and_month(spark):
    panel = spark.createDataFrame([("A.O", D(2020, m, 1), 1.0) for m in (1, 2, 3, 4)] + [("A.N", D(2020, 1, 1), 2.0), ("B", D(2020, 2, 1), 3.0)], "ticker string, month date, ret double")
    side = spark.createDataFrame(
        [("A", D(2020, 2, 3), 5.0, 1.0), ("A", D(2020, 2, 20), 7.0, None), ("A", D(2020, 4, 30), None, 2.0), ("Z", D(2020, 1, 9), 9.0, 9.0), ("B", D(2020, 1, 9), 4.0, 4.0)], "base string, date date, x double, y double"
    )
    got = {(r.ticker, r.month.month): (r.x, r.y) for r in merging.merge_by_base(panel, side, ["x", "y"]).collect()}
    # the smaller of two tickers of a base gets the values; the month's last date counts, with its nulls; nothing before the first
    assert got == {("A.N", 1): (0.0, 0.0), ("A.O", 1): (0.0, 0.0), ("A.O", 2): (0.0, 0.0), ("A.O", 3): (0.0, 0.0), ("A.O", 4): (0.0, 0.0), ("B", 2): (0.0, 0.0)}
    alone = panel.filter("ticker != 'A.N'")
    got = {(r.ticker, r.month.month): (r.x, r.y) for r in merging.merge_by_base(alone, side, ["x", "y"]).collect()}
    assert got == {("A.O", 1): (0.0, 0.0), ("A.O", 2): (7.0, 0.0), ("A.O", 3): (7.0, 0.0), ("A.O", 4): (7.0, 2.0), ("B", 2): (0.0, 0.0)}
    assert merging.merge_by_base(panel, side.limit(0), ["x", "y"]).filter("x != 0").count() == 0 and merging.merge_by_base(panel.limit(0), side, ["x", "y"]).count() == 0


def test_sizes_fall_back_on_shares_of_half_a_year(spark):
    rows = spark.createDataFrame([(i, D(2020, 6, 1), D(2020, 6, 30), c) for i, c in ((1, 2.0), (2, 3.0), (3, 4.0), (4, 0.0), (5, None), (6, 5.0))], "instrument int, month date, date date, close double")
    caps = spark.createDataFrame([(1, D(2020, 6, 1), 100.0), (2, D(2020, 6, 1), 0.0), (6, D(2020, 5, 1), 9.0)], "instrument int, month date, mktcap double")
    shares = spark.createDataFrame([(1, D(2020, 6, 1), 7.0), (2, D(2020, 6, 30), 10.0), (3, D(2019, 12, 28), 10.0), (4, D(2020, 6, 1), 10.0), (5, D(2020, 6, 1), 10.0), (6, D(2019, 12, 27), 8.0), (6, D(2020, 7, 1), 8.0)], "instrument int, date date, shares double")
    got = {r.instrument: (r.log_mktcap, r.origin) for r in merging.log_size(rows, caps, shares).collect()}
    # 28 December is 185 days before 30 June, 27 December is 186
    assert got == {1: (math.log(100), "cap"), 2: (pytest.approx(math.log(30)), "shares"), 3: (pytest.approx(math.log(40)), "shares"), 4: (None, None), 5: (None, None), 6: (None, None)}


def ranked(months=15, names=30, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(months):
        y = rng.normal(size=names)
        a = pd.Series(y * 0.8 + rng.normal(size=names)).rank() / names
        b = pd.Series(rng.normal(size=names))
        b[rng.random(names) < 0.3] = np.nan
        b = b.rank() / b.count()
        y[0] = np.nan
        rows += [(D(2000 + m // 12, m % 12 + 1, 1), i, *(None if np.isnan(v) else float(v) for v in (y[i], a[i], b[i])), 0.5) for i in range(names)]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_shuffles_of_all_columns_equal_single_correlations(spark, parts):
    rows, sims = ranked(), 40
    df = spark.createDataFrame(rows, "month date, instrument int, fwd_ret_1m double, a double, b double, flat double").repartition(parts)
    got = {r.factor: r for r in shuffles.shuffled_ic(df, ["a", "b", "flat"], sims=sims, least=10).collect()}
    assert set(got) == {"a", "b"}
    data = pd.DataFrame(rows, columns=["month", "instrument", "y", "a", "b", "flat"]).dropna(subset=["y"])
    for name in ("a", "b"):
        ic = []
        for month, g in data.groupby("month"):
            g = g.sort_values("instrument")
            y = shuffles.dealt((g["y"].rank() / len(g)).to_numpy(), sims, [27, month.year * 12 + month.month, 0])
            has = g[name].notna().to_numpy()
            ic.append([np.corrcoef(g[name].to_numpy(float)[has], y[has, k])[0, 1] for k in range(sims + 1)])
        ic = np.array(ic)
        mean = ic.mean(axis=0)
        ratio = mean / (ic.std(axis=0) + 1e-9)
        r = got[name]
        assert r.n_months == len(ic) and r.ic_mean == pytest.approx(mean[0]) and r.icir == pytest.approx(ratio[0])
        assert r.p == pytest.approx((abs(mean[1:]) >= abs(mean[0])).mean()) and r.p_icir == pytest.approx((abs(ratio[1:]) >= abs(ratio[0])).mean())
    assert got["a"].p == 0 and got["b"].p > 0.01


def test_large_months_are_dealt_in_blocks(spark, monkeypatch):
    rows = ranked()
    df = spark.createDataFrame(rows, "month date, instrument int, fwd_ret_1m double, a double, b double, flat double")
    whole = {r.factor: r for r in shuffles.shuffled_ic(df, ["a", "b"], sims=20, least=10).collect()}
    monkeypatch.setattr(shuffles, "BLOCK_ROWS", 8)
    apart = {r.factor: r for r in shuffles.shuffled_ic(df, ["a", "b"], sims=20, least=10).collect()}
    # what is not dealt is the same, and a real relation stays apart from the dealt ones
    for name in ("a", "b"):
        assert apart[name].ic_mean == pytest.approx(whole[name].ic_mean) and apart[name].icir == pytest.approx(whole[name].icir)
    assert apart["a"].p == 0
    assert shuffles.shuffled_ic(df.limit(0), ["a", "b"], sims=5).count() == 0
    assert shuffles.shuffled_ic(df, ["a"], sims=5, least=1000).count() == 0


def test_ranks_may_bring_the_targets_rank_and_the_largest_month(spark):
    """the same shuffles as with ranks made by windows over the wide rows, and no row is made to be counted."""
    import datetime

    from panelloom.operators import crosssection as cs

    rng = np.random.default_rng(8)
    data = [(datetime.date(2000, 1 + k, 1), i, float(rng.normal()), None if i % 9 == 0 else float(rng.normal()), None if i % 7 == 0 else float(rng.integers(5))) for k in range(4) for i in range(40)]
    rows = spark.createDataFrame(data, "month date, instrument int, a double, b double, fwd_ret_1m double")
    keys = ("month", "instrument", "fwd_ret_1m")
    plain = shuffles.shuffled_ic(cs.percent_ranks(rows, ["a", "b"], keys), ["a", "b"], sims=10, least=5)
    largest = shuffles.largest_month(rows.filter("fwd_ret_1m is not null"))
    brought = shuffles.shuffled_ic(cs.percent_ranks(rows.selectExpr("*", "fwd_ret_1m as _y"), ["a", "b", "_y"], keys), ["a", "b"], sims=10, least=5, largest=largest)
    assert "Window" not in brought._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, brought.collect())) and largest == 34
