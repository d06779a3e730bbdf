"""Linear algebra of wide panels: one pass over the rows gives the moments, and small matrices go to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.crosssection import _tasks, average_ranks, percent_ranks
from panelloom.operators.panel import cs_rank, percent_rank
from panelloom.operators.statistics import _corr


def _vectors(panel: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(panel)


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def _placed(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each value (how many cuts are smaller), and whether it is a value that repeated cuts show to be frequent."""
    part = np.searchsorted(cuts, x, side="left")
    return part, np.append((cuts[1:] == cuts[:-1]), [False, False])[part] & (np.append(cuts, np.nan)[part] == x)


def rank_correlations(panel: DataFrame, columns: list[str], keys: tuple[str, ...] = ("month", "instrument"), parts: int = 256, keep: Callable[[DataFrame], DataFrame] = _as_they_are) -> tuple[np.ndarray, int]:
    """Columns by columns, Spearman's correlations of pooled average ranks over the rows that have all, and how many rows these are.

    Values are cut into ranges at sampled quantiles, counted (columns times ranges come to the driver), and ranked range by range. A
    frequent value has its rank from the counts alone, so that no range grows with it. The rows, unique by `keys`, are read three times:
    `keep` may write them.
    """
    rows = keep(panel.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns))
    found = rows.agg(*[F.percentile_approx(c, [i / parts for i in range(1, parts)], 10_000).alias(c) for c in columns]).first()
    if found[columns[0]] is None:
        return np.eye(len(columns)), 0
    cuts = {c: np.array(found[c], float) for c in columns}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns), parts, 2), np.int64)
        for batch in batches:
            for i, c in enumerate(columns):
                part, often = _placed(batch.column(c).to_numpy(zero_copy_only=False), cuts[c])
                np.add.at(sums[i], (part, often.astype(int)), 1)
        i, part, often = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, part, often, sums[i, part, often])], ["i", "part", "often", "n"])

    totals = np.zeros((len(columns), parts, 2), np.int64)
    for r in rows.select(columns).mapInArrow(count, "i long, part long, often long, n long").groupBy("i", "part", "often").agg(F.sum("n").alias("n")).collect():
        totals[r["i"], r["part"], r["often"]] = r["n"]
    # a frequent value is the last of its range
    before = np.cumsum(totals.reshape(len(columns), -1), axis=1).reshape(totals.shape) - totals

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in enumerate(columns):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                part, often = _placed(x, cuts[c])
                rank = before[i, part, 1] + (totals[i, part, 1] + 1) / 2
                spread = np.where(often, parts + np.arange(len(x)) % parts, part)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(np.full(len(x), i, np.int32)), pa.array(spread.astype(np.int32)), pa.array(np.where(often, rank, x)), pa.array(often)], [*keys, "i", "part", "x", "often"])

    def rank(table: pa.Table) -> pa.Table:
        x, i, part = table.column("x").to_numpy(), int(table.column("i")[0].as_py()), int(table.column("part")[0].as_py())
        ranks = x if part >= parts else average_ranks(x) + before[i, part, 0]
        return pa.table({**{k: table.column(k) for k in keys}, "i": table.column("i"), "x": pa.array(ranks)})

    names = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    long = rows.mapInArrow(deal, f"{names}, i int, part int, x double, often boolean").repartition(_tasks(rows), "i", "part").groupBy("i", "part").applyInArrow(rank, f"{names}, i int, x double")
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"r{i}") for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moments = wide.agg(*[F.covar_pop(f"r{i}", f"r{j}").alias(f"m{i}_{j}") for i, j in pairs]).first()
    out = np.eye(len(columns))
    for i, j in pairs:
        spread = (moments[f"m{i}_{i}"] * moments[f"m{j}_{j}"]) ** 0.5
        if i != j:
            out[i, j] = out[j, i] = moments[f"m{i}_{j}"] / spread if spread > 1e-12 else 0.0
    return out, int(totals[0].sum())


def marchenko_pastur(matrix: np.ndarray, rows: int) -> dict:
    """Edges of the noise band, and how many eigenvalues stand above it."""
    ratio = matrix.shape[0] / rows
    low, high = (1 - ratio**0.5) ** 2, (1 + ratio**0.5) ** 2
    return {"low": low, "high": high, "signals": int((np.linalg.eigvalsh(matrix) > high).sum())}


def denoised(matrix: np.ndarray, rows: int) -> np.ndarray:
    """The matrix with the noise eigenvalues at their mean and a unit diagonal."""
    values, vectors = np.linalg.eigh(matrix)
    noise = values <= marchenko_pastur(matrix, rows)["high"]
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    out = (vectors * values) @ vectors.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d)


def variance_inflation(matrix: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite for columns that others determine."""
    values, vectors = np.linalg.eigh(matrix)
    if values.min() > 1e-10:
        return np.diag(np.linalg.inv(matrix))
    inverse = (vectors * np.where(values > 1e-10, 1 / np.maximum(values, 1e-10), 0)) @ vectors.T
    return np.where((vectors[:, values <= 1e-10] ** 2).sum(axis=1) > 1e-10, np.inf, np.diag(inverse))


def ward_clusters(matrix: np.ndarray, cut: float = 0.5) -> list[int]:
    """Cluster of each column: Ward's linkage on 1 - |rho|, joined while the height is at most `cut`; numbered by first member."""
    d = (1 - np.abs(matrix)).astype(float)
    groups, size = {i: [i] for i in range(len(d))}, dict.fromkeys(range(len(d)), 1)
    dist = {(i, j): d[i, j] for i in groups for j in groups if i < j}
    while dist:
        (i, j), height = min(dist.items(), key=lambda x: (x[1], x[0]))
        if height > cut:
            break
        for k in groups:
            if k not in (i, j):
                a, b = dist[min(i, k), max(i, k)], dist.pop((min(j, k), max(j, k)))
                n = size[i] + size[j] + size[k]
                dist[min(i, k), max(i, k)] = float(np.sqrt(max(0, ((size[i] + size[k]) * a * a + (size[j] + size[k]) * b * b - size[k] * height * height) / n)))
        dist.pop((i, j))
        groups[i] += groups.pop(j)
        size[i] += size.pop(j)
    out = [0] * len(d)
    for n, members in enumerate(sorted(groups.values(), key=min)):
        for m in members:
            out[m] = n
    return out


def pca_residuals(panel: DataFrame, columns: list[str], variance: float = 0.8, fit: DataFrame | None = None) -> DataFrame:
    """Ranked columns without their leading components, ranked again.

    The components are those of the covariance of `fit` (all rows, or an earlier part), the fewest that hold the share
    of variance, and one less than there are columns at most. Only columns-by-columns moments reach the driver.
    """
    ranked = cs_rank(panel, columns)
    base = ranked if fit is None else cs_rank(fit, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moments = base.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"m{n}") for n, (i, j) in enumerate(pairs)], *[F.avg(c).alias(f"a{n}") for n, c in enumerate(columns)]).first()
    if moments["a0"] is None or moments["m0"] is None:
        return ranked
    cov = np.zeros((len(columns), len(columns)))
    for n, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = moments[f"m{n}"]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(int(np.searchsorted(np.cumsum(values) / values.sum(), variance)) + 1, len(columns) - 1)
    keep = np.eye(len(columns)) - vectors[:, :k] @ vectors[:, :k].T
    centred = [F.col(c) - float(moments[f"a{n}"]) for n, c in enumerate(columns)]
    residual = [sum((x * float(w) for x, w in zip(centred, row)), F.lit(0.0)) for row in keep]
    return cs_rank(ranked.withColumns(dict(zip(columns, residual))), columns)


def mean_ic(scored: DataFrame, least: int = 3) -> float | None:
    """Mean over months of the Pearson correlation of score and fwd_ret_1m: one number."""
    by_month = scored.groupBy("month").agg(_corr("score", "fwd_ret_1m", least).alias("ic"))
    return by_month.filter("ic is not null").agg(F.avg("ic")).first()[0]


def _scores(model, rows: DataFrame, target: str) -> DataFrame:
    return model.transform(rows).select("month", "instrument", F.col("prediction").alias("score"), F.col(target).alias("fwd_ret_1m"))


def _boosted_by_ic(past: DataFrame, target: str, seed: int, rounds: tuple[int, ...] = (5, 10, 20), months: int = 12):
    """Boosted trees on the month's rank of the target, with as many rounds as give the best mean IC in the last months of the past."""
    last = past.select("month").distinct().orderBy(F.desc("month")).limit(months).agg(F.min("month")).first()[0]
    ranked = past.withColumn("_rank", percent_rank(F.col(target), "month") - 0.5)
    fit, held = ranked.filter(F.col("month") < F.lit(last)), ranked.filter(F.col("month") >= F.lit(last))
    best = (None, None)
    for n in rounds:
        model = GBTRegressor(labelCol="_rank", maxIter=n, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(ranked if fit.isEmpty() else fit)
        ic = mean_ic(_scores(model, held, target))
        if best[0] is None or (ic is not None and ic > best[0]):
            best = (ic if ic is not None else float("-inf"), model)
        else:
            break
    return best[1]


def walk_forward(panel: DataFrame, columns: list[str], target: str, folds: list[tuple[str, str, str]], model: str = "linear", seed: int = 7) -> DataFrame:
    """month, instrument, score, fwd_ret_1m of each fold (train until, test from, test to), models fitted on earlier months only.

    boosted_ic learns the month's ranks and stops where the IC of the last training months does.
    """
    makers = {
        "linear": lambda past: LinearRegression(labelCol=target, regParam=0.01, elasticNetParam=0.5).fit(past),
        "forest": lambda past: RandomForestRegressor(labelCol=target, numTrees=20, maxDepth=5, seed=seed).fit(past),
        "boosted": lambda past: GBTRegressor(labelCol=target, maxIter=15, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(past),
        "boosted_ic": lambda past: _boosted_by_ic(past, target, seed),
    }
    # iterative fits read the vectors again and again; what is returned reads the panel
    rows, out = _vectors(panel.dropna(subset=[target]), columns).select("month", "instrument", target, "features").persist(), None
    for until, first, final in folds:
        past = rows.filter(F.col("month") <= F.lit(until).cast("date"))
        now = rows.filter(F.col("month").between(F.lit(first).cast("date"), F.lit(final).cast("date")))
        if past.isEmpty():
            continue
        scored = _scores(makers[model](past), now, target)
        out = scored if out is None else out.unionByName(scored)
    rows.unpersist()
    return out if out is not None else rows.select("month", "instrument", F.lit(0.0).alias("score"), F.col(target).alias("fwd_ret_1m")).limit(0)


def purged_folds(months: list, folds: int, purge: int) -> list[tuple[list, list]]:
    """(training, held-out) months: each fold holds out a run of months, and drops `purge` months on either side from training."""
    out = []
    for i in range(folds):
        a, b = len(months) * i // folds, len(months) * (i + 1) // folds
        if b > a:
            out.append(([m for k, m in enumerate(months) if k < a - purge or k >= b + purge], months[a:b]))
    return out


def purged_search(panel: DataFrame, columns: list[str], target: str, grid: list[tuple[float, float]], folds: int = 5, purge: int = 1) -> DataFrame:
    """penalty, mix, fold, ic of elastic nets over a grid, on purged folds of months. Months are a short list on the driver."""
    spark = panel.sparkSession
    rows = _vectors(panel.dropna(subset=[target]), columns).select("month", "instrument", target, "features").persist()
    months = [r["month"] for r in rows.select("month").distinct().orderBy("month").collect()]
    out = []
    for k, (train, held) in enumerate(purged_folds(months, folds, purge)):
        if not train:
            continue
        fit, test = rows.filter(F.col("month").isin(train)), rows.filter(F.col("month").isin(held))
        for penalty, mix in grid:
            model = LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=mix).fit(fit)
            out.append((float(penalty), float(mix), k, mean_ic(_scores(model, test, target))))
    rows.unpersist()
    return spark.createDataFrame(out, "penalty double, mix double, fold int, ic double")


def permuted(panel: DataFrame, column: str) -> DataFrame:
    """panel with one column's values passed on within each month, to the next row in an order by hash."""
    order = Window.partitionBy("month").orderBy(F.xxhash64(F.lit(column), "instrument"), "instrument")
    whole = Window.partitionBy("month").orderBy(F.xxhash64(F.lit(column), "instrument"), "instrument").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumn(column, F.when(F.lead(F.lit(True)).over(order), F.lead(column).over(order)).otherwise(F.first(column).over(whole)))


def permutation_importance(panel: DataFrame, columns: list[str], target: str, until: str, seed: int = 7, keep: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """factor, base_ic, ic, importance: how much a forest's mean IC after a date falls if a column's values are passed around.

    The rows are read for the fit and for each column: `keep` may write them.
    """
    spark, rows = panel.sparkSession, keep(panel.dropna(subset=[*columns, target]).select("month", "instrument", target, *columns))
    cut = F.lit(until).cast("date")
    model = RandomForestRegressor(labelCol=target, numTrees=20, maxDepth=5, seed=seed).fit(_vectors(rows.filter(F.col("month") <= cut), columns))
    test = rows.filter(F.col("month") > cut)
    ic = lambda df: mean_ic(_scores(model, _vectors(df, columns), target))
    base = ic(test)
    found = [(c, base, ic(permuted(test, c))) for c in columns]
    return spark.createDataFrame([(c, b, x, None if b is None or x is None else b - x) for c, b, x in found], "factor string, base_ic double, ic double, importance double")


def components(panel: DataFrame, columns: list[str], k: int, keep: Callable[[DataFrame], DataFrame] = _as_they_are) -> DataFrame:
    """month, instrument and pc1 .. pck: the leading components of the columns' ranks in the month; signs so that loadings sum above zero.

    Ranks are made once a month for all columns, missing ones neutral. They are read twice, for their moments and their scores: `keep` may write them.
    """
    ranked = percent_ranks(panel, columns)
    ranked = keep(ranked.select("month", "instrument", *[F.coalesce(F.col(c) - 0.5, F.lit(0.0)).alias(c) for c in columns]))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moments = ranked.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    if moments["m0_0"] is None:
        return ranked.select("month", "instrument", *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)])
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = moments[f"m{i}_{j}"]
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    vectors = vectors * np.where(vectors.sum(axis=0) >= 0, 1.0, -1.0)
    return ranked.select("month", "instrument", *[sum((F.col(c) * float(w) for c, w in zip(columns, vectors[:, i])), F.lit(0.0)).alias(f"pc{i + 1}") for i in range(k)])


def split_importance(panel: DataFrame, columns: list[str], target: str, until: str, seed: int = 7) -> DataFrame:
    """factor, forest, boosted: how much each column's splits lower the squared error of a forest and of boosted trees up to a date, as shares."""
    rows = _vectors(cs_rank(panel.dropna(subset=[target]).filter(F.col("month") <= F.lit(until).cast("date")).select("month", "instrument", target, *columns), columns), columns)
    rows = rows.withColumn("_rank", percent_rank(F.col(target), "month")).select("_rank", "features").persist()
    try:
        if rows.isEmpty():
            return panel.sparkSession.createDataFrame([], "factor string, forest double, boosted double")
        forest = RandomForestRegressor(labelCol="_rank", numTrees=20, maxDepth=5, seed=seed).fit(rows).featureImportances.toArray()
        boosted = GBTRegressor(labelCol="_rank", maxIter=10, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(rows).featureImportances.toArray()
    finally:
        rows.unpersist()
    return panel.sparkSession.createDataFrame([(c, float(a), float(b)) for c, a, b in zip(columns, forest, boosted)], "factor string, forest double, boosted double")
