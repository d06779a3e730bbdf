"""Operators that SQL can't check, against numpy, pandas or plain Python."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import evaluation as ev, fundamentals as fu, linear, riskparity, statistics as st
from panelloom.sources import landing

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for m in range(30):
        month = dt.date(2000 + m // 12, m % 12 + 1, 1)
        x = rng.normal(size=(40, 3))
        y = 0.8 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=40)
        rows += [(month, i, *map(float, x[i]), float(y[i])) for i in range(40)]
    return spark.createDataFrame(rows, "month date, instrument long, a double, b double, c double, fwd_ret_1m double").cache()


def test_student_p_and_quantile(spark):
    known = [(2.0, 10, 0.073388), (1.0, 1, 0.5), (2.228139, 10, 0.05), (0.0, 7, 1.0), (3.182446, 3, 0.05), (1.959964, 10_000, 0.050028)]
    for t, v, p in known:
        got = spark.range(1).select(ev.student_p(F.lit(t), F.lit(v)).alias("p")).first().p
        assert abs(got - p) < 2e-6, (t, v, got)
    got = spark.range(1).select(ev.student_quantile(F.lit(10)).alias("t")).first().t
    assert abs(got - 2.228139) < 1e-5


def test_normal_cdf(spark):
    xs = [-6.0, -3.1, -0.57, 0.0, 0.2, 1.0, 2.5, 6.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(fu.normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * (1 + math.erf(x / 2**0.5)) for x in xs], atol=1e-12)


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_pooled_rank_is_the_average_rank(spark, parts):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.integers(0, 3, 800), "i": range(800), "v": rng.integers(0, 60, 800).astype(float)})
    x.loc[::17, "v"] = np.nan
    rows = [(int(k), int(i), None if np.isnan(v) else float(v)) for k, i, v in x.itertuples(index=False)]
    got = {r.i: r.v for r in st.pooled_rank(spark.createDataFrame(rows, "k int, i int, v double"), "v", "k", parts).collect()}
    want = x.groupby("k")["v"].rank()
    assert len(got) == 800 and all((got[i] is None and np.isnan(w)) or got[i] == w for i, w in enumerate(want))


def test_optimal_weights_find_the_column_that_ranks(panel):
    w = {r.factor: r.weight for r in ev.optimal_weights(panel, COLUMNS, "fwd_ret_1m").collect()}
    x = panel.toPandas()

    def mean_ic(weights):
        return np.mean([np.corrcoef(g[COLUMNS].to_numpy() @ weights, g["fwd_ret_1m"])[0, 1] for _, g in x.groupby("month")])

    assert abs(sum(w.values()) - 1) < 1e-9 and max(w, key=w.get) == "a"
    assert mean_ic(np.array([w[c] for c in COLUMNS])) > mean_ic(np.ones(3) / 3)


def test_equal_risk():
    rng = np.random.default_rng(5)
    cov = np.cov(rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)), rowvar=False)
    w = riskparity.equal_risk(riskparity.denoised_covariance(cov))
    part = w * (riskparity.denoised_covariance(cov) @ w)
    assert abs(w.sum() - 1) < 1e-9 and np.allclose(part / part.sum(), 1 / 12, atol=1e-6)


def test_risk_parity_of_a_panel(spark):
    rng = np.random.default_rng(6)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    daily = spark.createDataFrame([(i, d, float(rng.normal() * (1 + i))) for i in range(6) for d in days], "instrument long, date date, r double")
    scored = spark.createDataFrame([(dt.date(2000, 7, 1), i, float(i)) for i in range(6)], "month date, instrument long, score double")
    out = riskparity.risk_parity(scored, daily, names=4).toPandas()
    assert sorted(out["instrument"]) == [2, 3, 4, 5] and np.allclose(out["risk_share"], 0.25, atol=1e-5)
    assert out.sort_values("instrument")["weight"].is_monotonic_decreasing


def test_purged_folds_leave_a_gap():
    for train, held in linear.purged_folds(list(range(23)), 5, 2):
        assert held == list(range(held[0], held[-1] + 1)) and min(abs(t - h) for t in train for h in held) == 3
    assert sorted(m for _, held in linear.purged_folds(list(range(23)), 5, 2) for m in held) == list(range(23))


def test_permuted_passes_values_around(panel):
    out = linear.permuted(panel, "a").toPandas().sort_values(["month", "instrument"])
    old = panel.toPandas().sort_values(["month", "instrument"])
    assert (out["b"].to_numpy() == old["b"].to_numpy()).all() and (out["a"].to_numpy() != old["a"].to_numpy()).mean() > 0.9
    assert all(sorted(x["a"]) == sorted(y["a"]) for (_, x), (_, y) in zip(out.groupby("month"), old.groupby("month")))


def test_importance_and_search(panel):
    found = {r.factor: r.importance for r in linear.permutation_importance(panel, COLUMNS, "fwd_ret_1m", "2001-06-01").collect()}
    assert max(found, key=found.get) == "a" and found["a"] > 0.2
    grid = linear.purged_search(panel, COLUMNS, "fwd_ret_1m", [(0.01, 0.5), (5.0, 1.0)], folds=3).toPandas()
    assert len(grid) == 6 and grid[grid["penalty"] == 0.01]["ic"].min() > 0.4


def test_components_are_the_eigenvectors(panel):
    got = linear.components(panel, COLUMNS, 2).toPandas().sort_values(["month", "instrument"])
    ranks = panel.toPandas().sort_values(["month", "instrument"]).groupby("month")[COLUMNS].rank(pct=True) - 0.5
    values, vectors = np.linalg.eigh(np.cov(ranks.to_numpy(), rowvar=False))
    for i in (1, 2):
        want = ranks.to_numpy() @ vectors[:, -i]
        assert np.isclose(abs(np.corrcoef(got[f"pc{i}"], want)[0, 1]), 1, atol=1e-6)


def test_residuals_have_no_leading_component(panel):
    got = linear.pca_residuals(panel, COLUMNS, 0.5).toPandas()
    assert (got[COLUMNS].abs() <= 0.5).all().all() and len(got) == 1200
    ranks = panel.toPandas().sort_values(["month", "instrument"]).groupby("month")[COLUMNS].rank(pct=True) - 0.5
    x = ranks.to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    k = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.5)) + 1
    lead = vectors[:, ::-1][:, :k]
    rest = pd.DataFrame((x - x.mean(axis=0)) @ (np.eye(3) - lead @ lead.T), columns=COLUMNS).assign(month=panel.toPandas().sort_values(["month", "instrument"])["month"].to_numpy())
    want = rest.groupby("month")[COLUMNS].rank(pct=True) - 0.5
    assert np.allclose(got.sort_values(["month", "instrument"])[COLUMNS].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("model", ["linear", "boosted_ic"])
def test_walk_forward_learns_from_the_past_alone(panel, model):
    folds = [("2000-12-01", "2001-01-01", "2001-12-01")]
    out = linear.walk_forward(panel, COLUMNS, "fwd_ret_1m", folds, model)
    assert linear.mean_ic(out) > 0.4 and {r.month.year for r in out.select("month").distinct().collect()} == {2001}
    # what comes later doesn't change the scores
    later = panel.withColumn("fwd_ret_1m", F.when(F.col("month") > F.lit("2000-12-01").cast("date"), -F.col("fwd_ret_1m")).otherwise(F.col("fwd_ret_1m")))
    again = linear.walk_forward(later, COLUMNS, "fwd_ret_1m", folds, model)
    key = lambda df: [(r.month, r.instrument, round(r.score, 9)) for r in df.orderBy("month", "instrument").collect()]
    assert key(out) == key(again)
    if model == "linear":
        x = panel.filter("month <= '2000-12-01'").toPandas()
        design = np.column_stack([np.ones(len(x)), x[COLUMNS]])
        beta = np.linalg.lstsq(design, x["fwd_ret_1m"], rcond=None)[0]
        t = out.join(panel.drop("fwd_ret_1m"), ["month", "instrument"]).toPandas()
        assert np.corrcoef(t["score"], np.column_stack([np.ones(len(t)), t[COLUMNS]]) @ beta)[0, 1] > 0.999


def test_vendor_ratios_and_holdings(spark):
    quarters = [dt.date(2000 + q // 4, 3 * (q % 4) + 3, 28) for q in range(8)]
    table = spark.createDataFrame([(1, e, 1e7 * (k + 1), 1e6, 5e7) for k, e in enumerate(quarters)], "instrument long, end date, revenue double, net_income double, assets double")
    out = {r.month: r for r in fu.vendor_ratios(table).collect()}
    assert len(out) == 8 and sorted(out)[0] == dt.date(2000, 5, 1)
    rows = [out[m] for m in sorted(out)]
    assert rows[1].net_margin is None and rows[2].net_margin == pytest.approx(3e6 / 6e7) and rows[7].net_margin == pytest.approx(4e6 / (1e7 * (5 + 6 + 7 + 8)))
    assert rows[7].revenue_growth == pytest.approx((26 - 10) / 10)
    held = fu.holdings(spark.createDataFrame([(1, quarters[0], 7, 3.0), (1, quarters[0], 8, 1.0), (2, quarters[0], 7, 4.0)], "instrument long, end date, holder long, amount double"))
    one = held.filter("instrument = 1").first()
    assert (one.inst_own_pct, one.num_institutions, one.inst_concentration, one.inst_own_change) == (0.5, 2, 10 / 16, None)


def test_reports_and_folds(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "factor string, ic double")
    landing.write_report(table, f"{tmp_path}/r")
    back = spark.read.option("header", True).csv(f"{tmp_path}/r").collect()
    assert [(r.factor, r.ic) for r in back] == [("a", "1.5"), ("b", None)]
    for fold, n in (("x", 3), ("y", 2), ("x", 4)):
        landing.write_fold(spark.range(n), f"{tmp_path}/f", fold)
    assert {r.fold: r["count"] for r in spark.read.parquet(f"{tmp_path}/f").groupBy("fold").count().collect()} == {"x": 4, "y": 2}


def test_split_importance_finds_the_columns_that_count(panel):
    found = {r.factor: (r.forest, r.boosted) for r in linear.split_importance(panel, COLUMNS, "fwd_ret_1m", "2001-06-01").collect()}
    for k in (0, 1):
        assert max(found, key=lambda c: found[c][k]) == "a" and abs(sum(v[k] for v in found.values()) - 1) < 1e-9


def test_pooled_rank_correlations_are_exact_with_frequent_values(spark):
    """ranks by ranges, a frequent value by its count; the rows are not sorted as one."""
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"instrument": np.arange(3000), "a": np.where(rng.random(3000) < 0.3, 0.5, rng.normal(size=3000)), "b": np.round(rng.normal(size=3000), 1), "c": 1.0})
    x["b"] += np.where(x["a"] > 0, 0.4, 0)
    df = spark.createDataFrame(x.assign(month=pd.Timestamp("2000-01-01").date())).withColumn("a", F.when(F.col("instrument") % 50 > 0, F.col("a")))
    got, n = linear.rank_correlations(df, ["a", "b", "c"], parts=16)
    kept = x[x["instrument"] % 50 > 0]
    assert n == len(kept) and got[0, 1] == pytest.approx(kept["a"].rank().corr(kept["b"].rank()), abs=1e-9)
    assert got[0, 2] == 0 and (np.diag(got) == 1).all()
    assert linear.rank_correlations(df.limit(0), ["a", "b"])[1] == 0


def test_models_read_rows_that_were_written_once(spark, panel, tmp_path):
    """what is read several times can be kept, with the same results."""
    kept = []

    def keep(rows):
        rows.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(rows.columns)
        return spark.read.parquet(f"{tmp_path}/{len(kept) - 1}")

    got = linear.components(panel, COLUMNS, 2, keep)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapGroups" not in plan and len(kept) == 1
    both = got.join(linear.components(panel, COLUMNS, 2).withColumnsRenamed({"pc1": "x", "pc2": "y"}), ["month", "instrument"]).toPandas()
    assert len(both) == panel.count() and np.allclose(both.pc1, both.x) and np.allclose(both.pc2, both.y)
    found = {r.factor: r.importance for r in linear.permutation_importance(panel, COLUMNS, "fwd_ret_1m", "2001-06-01", keep=keep).collect()}
    assert max(found, key=found.get) == "a" and len(kept) == 2


def test_quantile_pairs_hold_no_column_in_a_task(spark):
    """exact at sizes on either side of the small table, with ties, nulls and a column without values."""
    from panelloom.operators import fundamentals as fu

    rng = np.random.default_rng(9)
    x = pd.DataFrame({"a": rng.normal(size=6000), "b": np.round(rng.normal(size=6000), 1), "c": np.where(rng.random(6000) < 0.9, 2.0, rng.normal(size=6000))})
    df = spark.createDataFrame(x).withColumns({"a": F.when(F.col("b") > -1, F.col("a")), "none": F.lit(None).cast("double")})
    x.loc[~(x.b > -1), "a"] = np.nan
    for small, around in ((100_000, 5e-4), (10, 2e-3)):
        found = fu.quantile_pair(df, ["a", "b", "c", "none"], 0.005, 0.995, small, around)
        assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
        r = found.first()
        for c in "abc":
            assert [r[f"_{c}_lo"], r[f"_{c}_hi"]] == pytest.approx(list(x[c].quantile([0.005, 0.995])), abs=1e-12), (c, small)
        assert r["_none_lo"] is None
    # the values that are told apart are few
    assert fu.clipped(df, ["a", "b"]).count() == 6000
