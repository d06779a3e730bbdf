"""Operators on small hand-made series, against pandas or plain arithmetic, and properties that must hold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import frames as fr
from panelloom.operators import asof, factors, linear, panel, portfolio, series, statistics
from panelloom.sources import landing
from panelloom.streaming import events

DAY = dt.date(2020, 1, 1)


def daily(spark, values, instrument=1):
    rows = [(instrument, DAY + dt.timedelta(days=i), v, i + 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "instrument long, date date, x double, t double")


def column(df, expression):
    return [r[0] for r in df.select("date", expression.alias("v")).orderBy("date").select("v").collect()]


CASES = [[None, 1.0, 2.0, 4.0, 7.0, 3.0, 3.0, 9.0], [1.0, None, 2.0, None, 5.0, 5.0, 5.0, 5.0], [2.0] * 8, [None] * 8, [1.0], [1.0, 3.0]]


@pytest.mark.parametrize("values", CASES)
def test_frames_agree_with_pandas(spark, values):
    df, s = daily(spark, values), pd.Series(values, dtype=float)
    roll = s.rolling(4, min_periods=3)
    for got, want in ((fr.mean("x", 4, 3), roll.mean()), (fr.std("x", 4, 3), roll.std()), (fr.quantile("x", 0.3, 4, 3), roll.quantile(0.3)), (fr.high("x", 4, 3), roll.max())):
        assert [v if v is not None else np.nan for v in column(df, got)] == pytest.approx(want.tolist(), nan_ok=True, abs=1e-12)
    moments = ((fr.skew("x", 6, 4), s.rolling(6, min_periods=4).skew()), (fr.kurt("x", 6, 4), s.rolling(6, min_periods=4).kurt()))
    for got, want in moments:
        for a, b, spread in zip(column(df, got), want, s.rolling(6, min_periods=4).std()):
            assert (a is None) if not spread > 0 else a == pytest.approx(b, abs=1e-9)


def test_flags_of_unknown_comparisons_are_zero(spark):
    assert column(daily(spark, [None, 1.0, -1.0]), fr.flag(F.col("x") > 0)) == [0.0, 1.0, 0.0]


def test_average_rank_and_percent_rank(spark):
    rows = [(1, 3.0), (1, 1.0), (1, 3.0), (1, None), (2, 5.0)]
    df = spark.createDataFrame(rows, "month long, x double")
    got = sorted(((r.month, r.x or 0, r.p) for r in df.withColumn("p", panel.percent_rank(F.col("x"), "month")).collect()), key=str)
    assert got == [(1, 0, None), (1, 1.0, 1 / 3), (1, 3.0, 2.5 / 3), (1, 3.0, 2.5 / 3), (2, 5.0, 1.0)]


def test_asof_takes_the_last_row_and_its_age(spark):
    left = daily(spark, [1.0] * 10)
    right = spark.createDataFrame([(1, DAY + dt.timedelta(days=1), 5.0), (1, DAY + dt.timedelta(days=3), None), (2, DAY, 9.0)], "instrument long, date date, y double")
    got = {(r.date - DAY).days: (r.y, r.age) for r in asof.asof_join(left, right, columns=("y",), days=4, days_old="age").collect()}
    assert got == {0: (None, None), 1: (5.0, 0), 2: (5.0, 1), 3: (None, 0), 4: (None, 1), 5: (None, 2), 6: (None, 3), 7: (None, 4), 8: (None, None), 9: (None, None)}


def test_asof_plan_has_one_exchange_and_no_product(spark):
    left, right = daily(spark, [1.0] * 4), daily(spark, [2.0] * 4).withColumnRenamed("x", "y").drop("t")
    plan = asof.asof_join(left, right, columns=("y",))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_family_of_frames_needs_one_exchange(spark):
    from panelloom.operators import factors
    from panelloom.sources import bars

    lines = spark.createDataFrame([(i, 1, 1, i % 3, 2.0, 10.0 + i, dt.datetime(2020, 1, 1 + i % 28)) for i in range(60)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz")
    base = bars.with_returns(bars.daily_bars(lines)).withColumn("m", F.lit(0.01))
    plan = factors.trend(base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instrument") <= 1


@pytest.mark.parametrize("seed", range(4))
def test_capped_weights_are_those_of_the_iteration(spark, seed):
    rng = random.Random(seed)
    raw = [rng.paretovariate(1) for _ in range(rng.choice([5, 13, 40]))]
    w = np.array(raw) / sum(raw)
    rows = [(1, i, float(x)) for i, x in enumerate(w)]
    out = sorted(portfolio.capped(spark.createDataFrame(rows, "month long, instrument long, weight double"), 0.08).collect(), key=lambda r: r.instrument)
    got = np.array([r.capped for r in out])
    assert got.sum() == pytest.approx(1)
    if len(raw) * 0.08 < 1:
        assert not out[0].feasible and np.allclose(got, 1 / len(raw))
        return
    for _ in range(500):
        over = w >= 0.08 - 1e-15
        w = np.where(over, 0.08, w * (1 - 0.08 * over.sum()) / w[~over].sum())
    assert out[0].feasible and np.allclose(got, w, atol=1e-9) and got.max() <= 0.08 + 1e-12


def book(spark, names=30, months=8, seed=1):
    rng = random.Random(seed)
    rows = [(dt.date(2020, m + 1, 1), i, rng.random(), rng.gauss(0, 1), rng.gauss(0, 0.05)) for m in range(months) for i in range(names)]
    return spark.createDataFrame(rows, "month date, instrument long, weight double, score double, fwd_ret_1m double")


def test_no_tilt_has_no_active_return(spark):
    tilted = portfolio.tilt_by_score(book(spark), 0.0)
    out = portfolio.backtest(tilted, cost=0.0).collect()
    assert len(out) == 8 and all(abs(r.active_ret) < 1e-12 for r in out)
    assert all(abs(r.s - 1) < 1e-9 for r in tilted.groupBy("month").agg(F.sum("port_w").alias("s")).collect())
    first = min(portfolio.turnover(tilted).collect(), key=lambda r: r.month)
    assert first.turnover == pytest.approx(1)


def test_step_up_of_independent_tests_rejects_at_least_as_much(spark):
    rng = random.Random(2)
    p = spark.createDataFrame([(f"f{i}", rng.random() ** 3) for i in range(40)], "factor string, p double")
    loose, strict = ({r.factor for r in statistics.step_up(p, 0.2, dep).filter("rejected").collect()} for dep in (False, True))
    assert strict <= loose and loose


def test_ranks_ignore_monotone_transforms(spark):
    df = book(spark).select("month", "instrument", F.lit("f").alias("factor"), F.col("score").alias("value"), "fwd_ret_1m")
    a, b = (sorted((r.month, round(r.ic, 9)) for r in statistics.monthly_ic(x).collect()) for x in (df, df.withColumn("value", F.exp("value"))))
    assert a == b and len(a) == 8


def test_repeated_edges_skip_the_month(spark):
    df = book(spark).select("month", "instrument", F.lit("f").alias("factor"), F.lit(1.0).alias("value"), "fwd_ret_1m")
    assert statistics.quantile_spread(df).count() == 0


def test_whole_block_bootstrap_rotates(spark):
    rows = spark.createDataFrame([(dt.date(2020, i + 1, 1), float(i)) for i in range(6)], "month date, x double")
    out = portfolio.block_bootstrap(rows, "x", 10, 6).collect()
    assert len(out) == 10 and all(r.mean == pytest.approx(2.5) for r in out)


def test_ward_and_noise_and_inflation():
    m = np.array([[1, 0.95, 0.0], [0.95, 1, 0.05], [0.0, 0.05, 1]])
    assert linear.ward_clusters(m) == [0, 0, 1]
    assert linear.variance_inflation(m)[0] == pytest.approx(np.linalg.inv(m)[0, 0])
    assert np.isinf(linear.variance_inflation(np.ones((2, 2)))).all()
    assert np.allclose(np.diag(linear.denoised(m, 100)), 1)


def test_oscillators_of_a_short_and_a_flat_series(spark):
    rows = [(1, DAY + dt.timedelta(days=i), 5.0, 5.0, 5.0) for i in range(30)] + [(2, DAY, 1.0, 1.0, 1.0)]
    out = series.oscillators(spark.createDataFrame(rows, "instrument long, date date, close double, high double, low double")).collect()
    assert len(out) == 31 and all(r.rsi_14 in (None, 0.0) and abs(r.macd_hist) < 1e-9 for r in out)


def test_landed_blocks_lists_and_facts(spark):
    block = spark.createDataFrame([("2020-01-01", "1.5", "-2"), ("2020-01-02", None, "3")], "date string, `A.O` string, B string")
    out = {(r.instrument, str(r.date)): (r.close, r.open) for r in landing.ohlc({"close": block, "open": block}).collect()}
    assert out == {("A.O", "2020-01-01"): (1.5, 1.5), ("B", "2020-01-02"): (3.0, 3.0)}
    names = landing.membership(spark.createDataFrame([("2020-01-01", "aa, BB-202001,,aa")], "date string, tickers string"))
    assert {r.instrument for r in names.collect()} == {"AA", "BB"}
    text = '{"cik": 7, "facts": {"us-gaap": {"B": {"units": {"USD": [{"end": "2020-03-31", "start": "2020-01-01", "val": 1, "filed": "2020-05-01", "form": "10-Q"}, {"end": "2020-03-31", "start": "2020-01-01", "val": 2, "filed": "2020-06-01", "form": "10-Q"}, {"end": "2020-03-31", "start": "2019-04-01", "val": 9, "filed": "2020-07-01", "form": "10-K"}]}}}}}'
    got = landing.facts(spark.createDataFrame([(text,)], "json string"), ["A", "B"], flow=True).collect()
    assert [(r.cik, r.tag, r.val, str(r.filed)) for r in got] == [(7, "B", 2.0, "2020-06-01")]


def test_snapshots_and_panels_on_disk(spark, tmp_path):
    old = spark.createDataFrame([(1, "2020-01", 1.0), (2, "2020-01", 2.0)], "instrument long, month string, v double").withColumn("seen", F.lit(1))
    new = spark.createDataFrame([(2, "2020-01", 5.0), (3, "2020-02", 3.0)], "instrument long, month string, v double").withColumn("seen", F.lit(2))
    old.write.parquet(f"{tmp_path}/old")
    landing.merge_snapshot(spark, f"{tmp_path}/old", new, ["instrument", "month"], ["seen"], f"{tmp_path}/new")
    assert sorted((r.instrument, r.v) for r in spark.read.parquet(f"{tmp_path}/new").collect()) == [(1, 1.0), (2, 5.0), (3, 3.0)]
    assert sorted((r.instrument, r.v) for r in landing.gap_fill(old, new, ["instrument", "month"]).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    landing.write_panel(spark.createDataFrame([(DAY, 1.0)], "month date, v double"), f"{tmp_path}/panel")
    assert spark.read.parquet(f"{tmp_path}/panel").filter("year = 2020").count() == 1


def test_streams_give_the_batch_result(spark, tmp_path):
    rows = [(i % 40, dt.datetime(2024, 1, 1 + i % 9, i % 24), i % 5, "click", float(i)) for i in range(120)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
    batch = events.windowed_counts(events.with_time(spark.read.parquet(f"{tmp_path}/in")))
    stream = events.run_available(events.windowed_counts(events.read_stream(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/ck")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_bootstrap_draws_differ_between_simulations(spark):
    from panelloom.operators import portfolio as pf

    series = spark.createDataFrame([(i, float(i * i)) for i in range(81)], "month int, x double")
    means = lambda f, n: [r["mean"] for r in f(series, "x", n, 6).collect()]
    found = means(pf.block_bootstrap_mixed, 1000)
    assert len(found) == 1000 and len({round(m, 6) for m in found}) > 900  # rotations of one pattern give 81 at most
    assert abs(sum(found) / 1000 - sum(i * i for i in range(81)) / 81) < 100


def test_month_returns_hold_every_instrument(spark):
    from panelloom.plans import panel_queries as pq

    sf = "/root/testdata/sf0.001"
    out = pq.month_returns(spark, sf)
    assert out.selectExpr("sum(size(instruments))", "sum(size(ret_1m))").first() == (pq.panel(spark, sf).count(),) * 2


def test_long_returns_have_values_after_three_years_of_bars(spark):
    closes = [100.0 * 1.001**i for i in range(800)]
    rows = [(1, DAY + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
    df = factors.momentum(spark.createDataFrame(rows, "instrument long, date date, close double")).orderBy("date").collect()
    assert df[755].ret_36m is None and df[756].ret_36m == pytest.approx(1.001**756 - 1) and df[799].ret_24m == pytest.approx(1.001**504 - 1)


def test_sums_agree_with_frames(spark):
    rng = np.random.default_rng(11)
    values = [None if rng.random() < 0.1 else float(rng.normal() * 0.02) for _ in range(300)]
    df = daily(spark, values)
    sums = fr.Sums(x=F.col("x"), xx=F.col("x") * F.col("x"))
    got = sums.add(df).withColumns({"s": sums.std("xx", "x", 63, 21), "m": sums.mean("x", 63, 21)}).orderBy("date").collect()
    roll = pd.Series(values, dtype=float).rolling(63, min_periods=21)
    assert [r.s if r.s is not None else np.nan for r in got] == pytest.approx(roll.std().tolist(), nan_ok=True, abs=1e-12)
    assert [r.m if r.m is not None else np.nan for r in got] == pytest.approx(roll.mean().tolist(), nan_ok=True, abs=1e-12)


def test_seasonality_is_of_the_same_month_of_earlier_years(spark):
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(40)]
    close = {m: 100.0 + 7 * i % 23 for i, m in enumerate(months) if i not in (14, 27)}
    close[months[5]] = 0.0
    rows = [(1, m + dt.timedelta(days=2 if m.month == 3 else 14), m, c) for m, c in close.items()] + [(2, DAY, DAY, 1.0)]
    got = {(r.instrument, r.month): r for r in factors.seasonality(spark.createDataFrame(rows, "instrument long, date date, month date, close double")).collect()}
    known = list(close)
    # a return over a price of zero is not known
    ret = {m: close[m] / close[a] - 1 if close[a] else None for a, m in zip(known, known[1:])} | {known[0]: None}
    back = lambda m, k: ret.get(m.replace(year=m.year - k))
    assert len(got) == len(rows) and got[2, DAY].ret_1m is None and got[2, DAY].january_dummy == 1
    for m in known:
        r, before = got[1, m], [v for a in known if a.month == m.month and a < m and (v := ret[a]) is not None]
        assert (r.ret_1m, r.ret_same_month_1y, r.ret_same_month_2y) == pytest.approx((ret[m], back(m, 1), back(m, 2)))
        assert r.ret_same_month_avg == (pytest.approx(np.mean(before)) if len(before) >= 2 else None)
        assert r.turn_of_month == (m.month == 3) and r.january_dummy == (m.month == 1)
