import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions.frames import Extremes
from panelloom.functions.scan import exponential_means


@pytest.mark.parametrize("weights", [(2 / 13, 0.5), (0.004, 1 / 14)])
def test_equal_to_pandas_at_any_length(spark, weights):
    rng = np.random.default_rng(0)
    frames = []
    for k, n in enumerate((1, 3, 40, 700, 3000)):
        x = rng.normal(size=n).cumsum() + 100
        y = np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n))
        y[: n // 5] = np.nan  # starts late
        y[n // 3 : n // 3 + n // 4] = np.nan  # a gap of many blocks
        frames.append(pd.DataFrame({"instrument": k, "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)], "x": x, "y": y, "flag": x > 100}))
    data = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(data).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(5)
    got = exponential_means(df, {"ex": (F.col("x"), weights[0]), "ey": (F.col("y"), weights[1])}).toPandas().sort_values(["instrument", "date"], ignore_index=True)
    assert list(got.columns) == ["instrument", "date", "x", "y", "flag", "ex", "ey"] and len(got) == len(data)
    for c, e, w in (("x", "ex", weights[0]), ("y", "ey", weights[1])):
        want = data.groupby("instrument")[c].transform(lambda s, w=w: s.ewm(alpha=w, adjust=False).mean())
        assert (got[e].isna() == want.isna()).all() and np.allclose(got[e].fillna(0), want.fillna(0), rtol=1e-11, atol=1e-11)


def test_plan_is_native(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0)], "instrument string, date date, x double")
    plan = exponential_means(df, {"e": (F.col("x"), 0.2)})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert exponential_means(df.limit(0), {"e": (F.col("x"), 0.2)}).count() == 0


@pytest.mark.parametrize("n,least", [(1, 1), (7, 3), (50, 20)])
def test_sliding_extremes_against_pandas(spark, n, least):
    rng = np.random.default_rng(n)
    parts = [pd.DataFrame({"instrument": k, "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(m)], "t": np.arange(1.0, m + 1), "x": np.where(rng.random(m) < 0.3, np.nan, rng.normal(size=m).round(1))}) for k, m in enumerate((1, 6, 7, 8, 120, 333))]
    data = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(data).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(4)
    e = Extremes(n, x=F.col("x"))
    got = e.add(df).withColumns({"hi": e.high("x", least), "lo": e.low("x", least)}).drop(*e.names()).toPandas().sort_values(["instrument", "date"], ignore_index=True)
    for c, f in (("hi", "max"), ("lo", "min")):
        want = data.groupby("instrument")["x"].transform(lambda s, f=f: getattr(s.rolling(n, min_periods=least), f)())
        assert (got[c].isna() == want.isna()).all() and np.allclose(got[c].fillna(0), want.fillna(0))
    assert list(got.columns) == ["instrument", "date", "t", "x", "hi", "lo"]
