import datetime as dt

import numpy as np
import pytest

from panelloom.operators import retrain
from panelloom.operators.retrain import best_round, expanding_scores, resumed, retrain_plan


def month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


def panel(spark, months=44, names=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(months):
        x = rng.normal(size=(names, 3))
        y = 0.02 * np.abs(x[:, 0]) - 0.01 * x[:, 1] + rng.normal(size=names) * 0.01 + rng.normal() * 0.05
        rows += [(month(k), i, *map(float, x[i, :2]), None if i == 3 else float(x[i, 2]), float(y[i])) for i in range(names)]
    return spark.createDataFrame(rows, "month date, instrument int, a double, b double, c double, y double")


def test_plan():
    plan = retrain_plan([month(k) for k in range(60)], month(35))
    assert [len(x) for x in plan[0]] == [29, 7, 12] and [len(x) for x in plan[1]] == [39, 9, 12] and len(plan) == 2
    for train, held, now in plan:
        assert max(train) < min(held) and max(held) < min(now)
    with pytest.raises(ValueError):
        retrain_plan([month(k) for k in range(60)], month(10))
    assert best_round([0.1, 0.3, 0.2, 0.3, 0.1, 0.9], 3) == 2 and best_round([None, None], 3) == 1 and best_round([0.1, 0.3, 0.2, 0.3, 0.1, 0.9], 9) == 6


def test_scores_learn_stop_and_look_only_back(spark, tmp_path):
    rows = panel(spark)
    got = expanding_scores(rows, ["a", "b", "c"], "y", month(27), str(tmp_path / "one"), every=12, rounds=8, patience=4)
    scores = {(r.month, r.instrument): r.score for r in got.collect()}
    assert len(scores) == 16 * 30 and 1 <= got.agg({"rounds": "max"}).first()[0] <= 8
    by_month = got.toPandas().groupby("month")
    assert by_month.apply(lambda g: g.score.rank().corr(g.fwd_ret_1m.rank())).mean() > 0.5
    # other rows from month 40 on change no score before; the second fit is at month 40
    from pyspark.sql import functions as F

    other = rows.withColumns({c: F.when(F.col("month") >= month(40), -F.col(c) + F.col("instrument")).otherwise(F.col(c)) for c in ("a", "b", "c", "y")})
    later = expanding_scores(other, ["a", "b", "c"], "y", month(27), str(tmp_path / "two"), every=12, rounds=8, patience=4)
    again = {(r.month, r.instrument): r.score for r in later.collect()}
    assert {k: v for k, v in again.items() if k[0] < month(40)} == {k: v for k, v in scores.items() if k[0] < month(40)}
    # months of one fit have the model saved with it
    assert (tmp_path / "one" / "models" / f"{month(27):%Y%m%d}").exists()


def test_a_stopped_run_repeats_no_fold(spark, tmp_path):
    made = []

    def fold(name, fails=False):
        def make():
            made.append(name)
            if fails:
                raise RuntimeError("stopped")
            return None, spark.createDataFrame([(name, 1.5)], "x string, score double")

        return name, make

    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        resumed(spark, folder, [fold("a"), fold("b"), fold("c", True), fold("d")])
    out = resumed(spark, folder, [fold("a"), fold("b"), fold("c"), fold("d")])
    assert made == ["a", "b", "c", "c", "d"]
    assert sorted((r.x, str(r.fold)) for r in out.collect()) == [(x, x) for x in "abcd"]
    assert retrain.resumed(spark, folder, [fold("a")]).count() == 1 and made[-1] == "d"


def test_sweep_chooses_as_one_by_one(spark):
    rows = panel(spark, months=15)
    variants = [(1, 0.1, 2), (3, 0.3, 4)]
    both = [[tuple(r) for r in retrain.sweep(rows, ["a", "b", "c"], "y", variants, folds=3, parallel=n).orderBy("place").collect()] for n in (1, 4)]
    assert both[0] == both[1] and [r[1] for r in both[0]] == [3, 3] and both[0][0][0].startswith("depth 3") and both[0][0][2] > both[0][1][2] >= both[0][1][3]


def test_rows_are_ranked_once_for_all_fits(spark, tmp_path):
    """the ranked rows are a table that every fit reads, with ranks of the month and neutral ones for missing values."""
    rows = panel(spark)
    expanding_scores(rows, ["a", "b", "c"], "y", month(27), str(tmp_path / "run"), every=12, rounds=2, patience=1)
    ranked = spark.read.parquet(str(tmp_path / "run" / "ranked")).toPandas()
    plain = rows.toPandas()
    both = ranked.merge(plain, on=["month", "instrument"], suffixes=("", "_raw"))
    assert len(both) == len(plain) and (both.y == both.y_raw).all()
    for c, raw in (("a", "a_raw"), ("c", "c_raw"), ("_rank", "y_raw")):
        assert ((both[c] - (both.groupby("month")[raw].rank(pct=True) - 0.5).fillna(0)).abs() < 1e-12).all()
