"""Vectors of rolling statistics against pandas, and what families and the panel made by them need of the network."""

import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelloom.functions import rolling as ro
from panelloom.operators import daily, factors
from panelloom.plans import evaluation_queries, factor_queries, panel_queries, wide_queries


def values(seed: int, n: int = 400) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * 0.02
    x[rng.random(n) < 0.1] = np.nan
    x[100:190] = 0.25
    return x


@pytest.mark.parametrize("n, least", [(1, 1), (5, 3), (21, 10), (63, 21), (252, 126), (500, 20)])
def test_vectors_agree_with_pandas(n, least):
    x, y = values(1), values(2)
    with np.errstate(all="ignore"):
        roll, both = pd.Series(x).rolling(n, min_periods=least), ~(np.isnan(x) | np.isnan(y))
        for name, got in {"sum": ro.total(x, n, least), "mean": ro.mean(x, n, least), "max": ro.high(x, n, least), "min": ro.low(x, n, least)}.items():
            np.testing.assert_allclose(got, getattr(roll, name)(), atol=1e-12, err_msg=name)
        np.testing.assert_allclose(ro.quantile(x, 0.05, n, least), roll.quantile(0.05), atol=1e-12)
        if n > 4:
            differs = ~ro.flat(x, n)
            np.testing.assert_allclose(ro.std(x, n, least), roll.std(), atol=1e-9)
            for name, got in {"skew": ro.skew(x, n, least), "kurt": ro.kurt(x, n, least)}.items():
                plain = pd.Series([getattr(pd.Series(x[max(0, i - n + 1) : i + 1]), name)() for i in range(len(x))])
                enough = differs & (ro.count(x, n) >= max(least, 4))
                np.testing.assert_allclose(got[enough], plain[enough], atol=1e-7, err_msg=name)
            pairs = [np.corrcoef(x[s][both[s]], y[s][both[s]])[0, 1] if both[s].sum() >= least else np.nan for s in (slice(max(0, i - n + 1), i + 1) for i in range(len(x)))]
            one = ro.flat(np.where(both, x, np.nan), n) | ro.flat(np.where(both, y, np.nan), n)
            np.testing.assert_allclose(ro.corr(x, y, n, least)[~one], np.array(pairs)[~one], atol=1e-9)


def test_constant_windows_have_no_spread_after_large_values():
    x = np.concatenate((np.array([1e6, -3e5, 7.0]), np.full(80, 0.1)))
    with np.errstate(all="ignore"):
        assert ro.std(x, 21, 10)[-1] == 0 and np.isnan(ro.skew(x, 21, 10)[-1]) and np.isnan(ro.corr(x, np.arange(83.0), 21, 10)[-1])


def lines(spark, folder) -> str:
    data = [(k, 1, i % 7, i % 3, 100.0 + (i * 7 + k) % 13, 2.0, datetime.date(1995, 1, 1) + datetime.timedelta(days=3 * k)) for k in range(60) for i in range(2)]
    spark.createDataFrame(data, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_families_have_no_sliding_frames(spark, tmp_path):
    d = lines(spark, tmp_path)
    for name in daily.FAMILIES:
        plan = factor_queries.QUERIES[f"factor_{name}"](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "specifiedwindowframe(RowFrame, -" not in plan.replace("RowFrame, -1, -1", ""), name
        assert plan.count("Exchange hashpartitioning(instrument") == 1, name


def test_daily_rows_cross_the_network_once_for_the_panel(spark, tmp_path):
    plan = panel_queries.base_panel(spark, lines(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    # one deal of lines by instrument; the panel does not need the market
    assert plan.count("Exchange hashpartitioning(instrument") == plan.count("Exchange ") == 1 and "Join" not in plan


def test_rows_out_of_order_and_infinite_ratios(spark):
    rows = [(1, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(i != 3), 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, i + 1.0) for i in (5, 2, 0, 1, 4, 3, 6)]
    df = spark.createDataFrame(rows, "instrument int, date date, close double, open double, high double, low double, volume double, r double, m double, t double")
    out = factors.all_families(df).orderBy("date").toPandas()
    assert list(out.t) == [float(i) for i in range(1, 8)] and not np.isinf(out.drop(columns="date").to_numpy(float)).any()
    assert np.isnan(out.ret_1w[4]) and out.ret_1w[5] == 0


def test_moments_look_only_at_the_rows_asked_for():
    x, at = values(3), np.array([0, 30, 150, 399])
    with np.errstate(all="ignore"):
        for name, f in {"skew": lambda a: ro.skew(x, 60, 20, a), "kurt": lambda a: ro.kurt(x, 60, 20, a), "quantile": lambda a: ro.quantile(x, 0.05, 21, 5, a), "mean_to": lambda a: ro.mean_to(x, ro.quantile(x, 0.1, 63, 5), 63, a)}.items():
            whole, some = f(None), f(at)
            np.testing.assert_array_equal(some[at], whole[at], err_msg=name)
            assert np.isnan(np.delete(some, at)).all(), name


def test_what_is_made_of_an_array_is_kept_only_while_remembering():
    x, y = values(4), values(5)
    plain = [ro.corr(x, y, 21, 10), ro.std(x, 63, 21), ro.high(x, 21, 10)]
    with np.errstate(all="ignore"), ro.remembering():
        assert ro.count(x, 5) is ro.count(x, 5)
        for _ in range(2):
            for a, b in zip(plain, [ro.corr(x, y, 21, 10), ro.std(x, 63, 21), ro.high(x, 21, 10)]):
                np.testing.assert_array_equal(a, b)
    assert ro.count(x, 5) is not ro.count(x, 5)


def test_rounding_agrees_with_spark(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-8, 17, 3000), rng.integers(-(10**9), 10**9, 3000) / 1e7, [0.0, -0.0, -1e-9, 5e-7, 1.0000005, 2.5e-6, 4.5e9 + 0.1234565, 1e300, -7e18]])
    theirs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").selectExpr("i", "round(x, 6) + 0 as x").orderBy("i").toPandas().x.to_numpy()
    got = ro.half_up(x, 6)
    np.testing.assert_array_equal(got, theirs)
    assert not np.signbit(got[got == 0]).any()


def test_instruments_side_by_side_are_as_alone():
    rng, tables = np.random.default_rng(7), []
    for k, n in enumerate((1, 300, 40, 700)):
        days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=3 * i) for i in range(n)]
        price = 50 + np.cumsum(rng.normal(size=n))
        price[rng.random(n) < 0.05 * k] = np.nan
        r = np.append(np.nan, price[1:] / price[:-1] - 1)
        volume = rng.integers(1, 9, n).astype(float)
        tables.append(pa.table({"date": days, "open": price + 1, "high": price + 2, "low": price - 2, "close": price, "volume": volume, "r": r, "m": rng.normal(size=n) * 0.01, "t": np.arange(1.0, n + 1)}))
    starts = np.cumsum([0] + [t.num_rows for t in tables[:-1]])
    ends = np.concatenate([daily.month_ends(daily.Bars(t))[0] + a for t, a in zip(tables, starts)])
    with np.errstate(all="ignore"), ro.remembering():
        x = daily.SideBySide(pa.concat_tables(tables), starts, ends)
        together = {c: v[x.at] for c, v in daily.all_families(x).items()}
    with np.errstate(all="ignore"):
        alone = [daily.all_families(daily.Bars(t)) for t in tables]
    for c in together:
        plain = np.concatenate([v[c][daily.month_ends(daily.Bars(t))[0]] for v, t in zip(alone, tables)])
        np.testing.assert_allclose(np.where(np.isfinite(together[c]), together[c], np.nan), np.where(np.isfinite(plain), plain, np.nan), rtol=1e-11, atol=1e-14, err_msg=c)


def test_instruments_that_lie_in_several_batches_stay_whole(spark, tmp_path):
    d = lines(spark, tmp_path)
    plan = evaluation_queries._made_features(spark, d)
    assert "MapInArrow" in (shown := plan._jdf.queryExecution().executedPlan().toString()) and shown.count("Exchange hashpartitioning(instrument") == 1
    whole, size = plan.orderBy("instrument", "month").toPandas(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        few = evaluation_queries._made_features(spark, d).orderBy("instrument", "month").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(whole) and not whole.duplicated(["instrument", "month"]).any()
    pd.testing.assert_frame_equal(whole, few)


def test_regimes_of_features_do_not_read_the_lines_again(spark, tmp_path):
    d = lines(spark, tmp_path)
    beside = evaluation_queries.month_end_panel(spark, d)
    assert not any("lineitem" in f for f in beside.inputFiles()) and not any("lineitem" in f for f in wide_queries.feature_regimes(spark, d).inputFiles())
    assert not {"vol_20d", "vol_252d"} & set(evaluation_queries.month_end_features(spark, d).columns)
    plain = panel_queries.panel(spark, d).select(*beside.columns).orderBy("instrument", "month").toPandas()
    pd.testing.assert_frame_equal(beside.orderBy("instrument", "month").toPandas(), plain)
