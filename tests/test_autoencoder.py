import numpy as np
from pyspark.sql import functions as F

from panelloom.operators import autoencoder
from panelloom.operators.autoencoder import Coder, encode, fit_autoencoder, windows


def curve(rng, n):
    t = rng.uniform(-1.5, 1.5, n)
    return np.column_stack([t, t**2, np.sin(3 * t), np.abs(t), np.cos(2 * t)]) + rng.normal(size=(n, 5)) * 0.02


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    coder = Coder.fresh(np.zeros(5), np.ones(5), 7, 2, 1)
    x = rng.normal(size=(11, 5))
    x[2, 3] = np.nan
    _, grads = coder.gradients(x)
    for w, g in zip(coder.weights, grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        kept = w[at]
        losses = []
        for d in (1e-6, -1e-6):
            w[at] = kept + d
            losses.append(coder.gradients(x)[0])
        w[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-4


def test_better_than_components_of_the_same_width(spark, monkeypatch):
    monkeypatch.setattr(autoencoder, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x, later = curve(rng, 2000), curve(rng, 500)
    schema = "k int, x array<double>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, [1.0]), (-2, None), (-3, [])], schema)
    coder = fit_autoencoder(df, "x", latent=1, hidden=24, rounds=250, batch_rows=600, rate=0.01)
    out = encode(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(later)] + [(-1, [1.0])], schema), "x", coder, ["k"])
    assert out.columns == ["k", "cand_ae_latent_0", "error"] and out.count() == 500
    mean, sd = x.mean(0), x.std(0)
    u, v = (x - mean) / sd, (later - mean) / sd
    axis = np.linalg.svd(u, full_matrices=False)[2][:1]
    plain = ((v - v @ axis.T @ axis) ** 2).mean()
    assert out.agg(F.avg("error")).first()[0] < 0.7 * plain
    assert fit_autoencoder(df.limit(0), "x") is None


def test_windows(spark):
    import datetime as dt

    rows = [("a", dt.date(2000, 1, k), float(k), None if k == 2 else 10.0 * k) for k in range(1, 6)]
    got = {r.date.day: r.x for r in windows(spark.createDataFrame(rows, "instrument string, date date, r double, v double"), ["r", "v"], 3).collect()}
    assert got[2] is None and got[5] == [3.0, 4.0, 5.0, 30.0, 40.0, 50.0] and got[3][:3] == [1.0, 2.0, 3.0] and np.isnan(got[3][4])
