"""Boosted rankers retrained as months go by, stopped by rank correlation, and runs over folds that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators import crosssection
from panelloom.operators.linear import purged_folds
from panelloom.operators.panel import cs_rank, percent_rank
from panelloom.operators.statistics import monthly_ic


def staged(model: PipelineModel, rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """rows with _stages: the score after each round, up to `rounds`. Trees are applied side by side, in one pass over the rows."""
    boosted = model.stages[-1]
    out = model.stages[0].transform(rows)
    keep = len(boosted.trees) if rounds is None else rounds
    for k, tree in enumerate(boosted.trees[:keep]):
        out = tree.setPredictionCol(f"_tree{k}").transform(out)
    votes = [F.col(f"_tree{k}") * float(w) for k, w in zip(range(keep), boosted.treeWeights)]
    out = out.withColumn("_votes", F.array(*votes)).drop("features", *[f"_tree{k}" for k in range(keep)])
    sums = F.aggregate("_votes", F.expr("cast(array() as array<double>)"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + v)))
    return out.withColumn("_stages", sums).drop("_votes")


def best_round(ic: list[float | None], patience: int) -> int:
    """The round of the highest IC before `patience` rounds in a row brought none higher; rounds count from 1."""
    best, at = None, 1
    for k, x in enumerate(ic, 1):
        if x is not None and (best is None or x > best):
            best, at = x, k
        elif k - at >= patience:
            break
    return at


def fit_by_ic(train: DataFrame, held: DataFrame, columns: list[str], target: str, rounds: int = 40, patience: int = 15, depth: int = 3, rate: float = 0.1, seed: int = 7, least: int = 6) -> tuple[PipelineModel, int]:
    """Boosted trees on the month's rank of the target, and after how many rounds to stop: where the held months' mean rank IC is highest.

    The squared loss of single returns tells little of a ranking, so the ranking itself is watched. The model is fitted once; the
    scores of all its prefixes over the held months are made and ranked in one job.
    """
    ranked = train if "_rank" in train.columns else train.withColumn("_rank", percent_rank(F.col(target), "month") - 0.5)
    boost = GBTRegressor(labelCol="_rank", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), boost]).fit(ranked)
    scored = staged(model, held.select("month", "instrument", F.col(target).alias("fwd_ret_1m"), *columns))
    names = [f"s{k}" for k in range(len(model.stages[-1].trees))]
    rounds_of = scored.select("month", "fwd_ret_1m", *[F.round(F.col("_stages")[k], 12).alias(c) for k, c in enumerate(names)])
    found = {r["factor"]: r["ic"] for r in crosssection.monthly_ic(rounds_of, names, least=least).groupBy("factor").agg(F.avg("ic").alias("ic")).collect()}
    return model, best_round([found.get(c) for c in names], patience)


def retrain_plan(months: list, after, every: int = 12, least: int = 24) -> list[tuple[list, list, list]]:
    """(training, held, scored) months of each fit: what comes after a date is scored `every` months at a time by a fit on what came before.

    The last months before are held for stopping: a fifth of them, 6 at least and 18 at most.
    """
    months = sorted(months)
    before, later = [m for m in months if m <= after], [m for m in months if m > after]
    if len(before) < least:
        raise ValueError(f"only {len(before)} months up to {after}; {least} are needed")
    out = []
    for i in range(0, len(later), every):
        seen = before + later[:i]
        held = min(18, max(6, len(seen) // 5))
        out.append((seen[:-held], seen[-held:], later[i : i + every]))
    return out


def resumed(spark: SparkSession, folder: str, folds: list[tuple[str, Callable[[], tuple[PipelineModel | None, DataFrame]]]]) -> DataFrame:
    """The rows of all folds, each made once: a fold whose table is complete is read, another is made and written.

    A fold gives a model (or None) and rows. The model is saved first, then the rows; the mark that Spark leaves in a finished
    table is the manifest, so a run that stopped in a fold takes it up again from its start and repeats none before it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    done = lambda where: path(where).getFileSystem(conf).exists(path(f"{where}/_SUCCESS"))
    for name, make in folds:
        if not done(f"{folder}/rows/fold={name}"):
            model, rows = make()
            if model is not None:
                model.write().overwrite().save(f"{folder}/models/{name}")
            rows.write.mode("overwrite").parquet(f"{folder}/rows/fold={name}")
    return spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/fold={name}" for name, _ in folds])


def expanding_scores(panel: DataFrame, columns: list[str], target: str, after, folder: str, every: int = 12, rounds: int = 40, patience: int = 15, seed: int = 7) -> DataFrame:
    """month, instrument, score, fwd_ret_1m, rounds, fold: every month after a date, scored by a model of the months before.

    Every `every` months a new model is fitted on all earlier ones (see retrain_plan and fit_by_ic). Columns are ranks in the month,
    missing ones neutral, so no later row reaches an earlier one. Months are a short list on the driver. Each fit's scores and model
    are written to `folder` and found there again (see resumed).
    """
    spark = panel.sparkSession
    # ranked once, a month in a task, and read by all fits
    kept = panel.filter(F.col(target).isNotNull()).select("month", "instrument", target, F.col(target).alias("_rank"), *columns)
    ranks = crosssection.percent_ranks(kept, ["_rank", *columns], ("month", "instrument", target))
    ranks.select("month", "instrument", target, *[F.coalesce(F.col(c) - 0.5, F.lit(0.0)).alias(c) for c in ("_rank", *columns)]).write.mode("overwrite").parquet(f"{folder}/ranked")
    table = spark.read.parquet(f"{folder}/ranked")
    months = [r["month"] for r in table.select("month").distinct().collect()]

    def one(train, held, now):
        def make():
            part = lambda of: table.filter(F.col("month").isin(of))
            model, best = fit_by_ic(part(train), part(held), columns, target, rounds, patience, seed=seed)
            scored = staged(model, table.filter(F.col("month").isin(now)), best)
            return model, scored.select("month", "instrument", F.element_at("_stages", -1).alias("score"), F.col(target).alias("fwd_ret_1m"), F.lit(best).alias("rounds"))

        return make

    plan = retrain_plan(months, after, every)
    return resumed(spark, folder, [(f"{held[-1]:%Y%m%d}", one(train, held, now)) for train, held, now in plan])


def sweep(panel: DataFrame, columns: list[str], target: str, variants: list[tuple[int, float, int]], folds: int = 5, purge: int = 1, parallel: int = 4, seed: int = 7, least: int = 5) -> DataFrame:
    """variant, folds, ic, worst, place: boosted rankers of several depths, rates and rounds by their mean rank IC over purged folds.

    Every variant is fitted on every fold's training months and ranked on its held ones, `parallel` fits at a time on the same
    cached rows: a stage of small tasks leaves cores to the others, and no more fits than that hold memory at once. The
    figures don't depend on `parallel`. Columns are ranks in the month. Months are a short list on the driver.
    """
    spark = panel.sparkSession
    rows = cs_rank(panel.filter(F.col(target).isNotNull()).select("month", "instrument", target, *columns), columns)
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumn("_rank", percent_rank(F.col(target), "month") - 0.5))
    rows = rows.select("month", "instrument", F.col(target).alias("fwd_ret_1m"), "_rank", "features").persist()
    try:
        months = sorted(r["month"] for r in rows.select("month").distinct().collect())
        parts = [(k, train, held) for k, (train, held) in enumerate(purged_folds(months, folds, purge)) if train]

        def one(job):
            (depth, rate, rounds), (k, train, held) = job
            model = GBTRegressor(labelCol="_rank", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed).fit(rows.filter(F.col("month").isin(train)))
            scored = model.transform(rows.filter(F.col("month").isin(held))).select("month", "instrument", "fwd_ret_1m", F.lit("score").alias("factor"), F.round("prediction", 12).alias("value"))
            ic = monthly_ic(scored, least).agg(F.avg("ic")).first()[0]
            return f"depth {depth}, rate {rate:g}, rounds {rounds}", k, ic

        jobs = [(v, part) for v in variants for part in parts]
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            found = list(pool.map(inheritable_thread_target(spark)(one), jobs))
    finally:
        rows.unpersist()
    table = spark.createDataFrame(found, "variant string, fold int, ic double")
    out = table.groupBy("variant").agg(F.count("ic").cast("int").alias("folds"), F.avg("ic").alias("ic"), F.min("ic").alias("worst"))
    # one row a variant
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("ic", 12)), "variant")))
