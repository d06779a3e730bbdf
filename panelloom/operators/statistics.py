"""How well factors rank the next period's returns. Input in long form: month, instrument, factor, value, fwd_ret_1m."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.panel import average_rank


def _complete(long: DataFrame) -> DataFrame:
    return long.filter(F.col("value").isNotNull() & F.col("fwd_ret_1m").isNotNull())


def _corr(x: str, y: str, least: int) -> Column:
    """Pearson correlation in a group of enough rows, null where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count("*") >= least) & (spread > 1e-15), F.covar_pop(x, y) / spread)


def monthly_ic(long: DataFrame, least: int = 20, rank: bool = True) -> DataFrame:
    """factor, month, n, ic: correlation of ranks (or values) over the month's rows that have both."""
    rows = _complete(long)
    if rank:
        rows = rows.withColumns({"value": average_rank(F.col("value"), "factor", "month"), "fwd_ret_1m": average_rank(F.col("fwd_ret_1m"), "factor", "month")})
    out = rows.groupBy("factor", "month").agg(F.count("*").alias("n"), _corr("value", "fwd_ret_1m", least).alias("ic"))
    return out.filter("ic is not null")


def ic_summary(ic: DataFrame) -> DataFrame:
    """factor, n_months, ic_mean, ic_std, icir, t_stat, pct_positive; of at least three months."""
    out = ic.groupBy("factor").agg(F.count("ic").alias("n_months"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("pct_positive"))
    spread = F.col("ic_std") > 1e-8
    out = out.withColumns({"icir": F.when(spread, F.col("ic_mean") / F.col("ic_std")), "t_stat": F.when(spread, F.col("ic_mean") / F.col("ic_std") * F.sqrt("n_months"))})
    return out.filter("n_months >= 3")


def month_number(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.year("month") * 12 + F.month("month"))


def pooled_rank(df: DataFrame, x: str, key: str, parts: int = 64) -> DataFrame:
    """df with column x replaced by its average-tie rank among the key's rows, however many: no window sees them all.

    Values are counted, cut into ranges at `parts` sampled quantiles of each key, and numbered in their range; rows below a
    range are a sum over the ranges' totals, and ranks come back to the rows by their value.
    """
    cuts = df.filter(F.col(x).isNotNull()).groupBy(key).agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    counts = df.filter(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("_n")).join(F.broadcast(cuts), key)
    counts = counts.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    inside = Window.partitionBy(key, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(key, "_part").agg(F.sum("_n").alias("_t")).withColumn("_below", F.coalesce(F.sum("_t").over(below), F.lit(0)))
    ranked = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(totals.drop("_t")), [key, "_part"])
    ranks = ranked.select(key, x, (F.col("_below") + F.col("_in") + (F.col("_n") + 1) / 2).alias("_rank"))
    return df.join(ranks, [key, x], "left").withColumn(x, F.col("_rank")).drop("_rank")


def pooled_ic(long: DataFrame) -> DataFrame:
    """factor, n, ic: one rank correlation over all months' rows."""
    rows = _complete(long).select("factor", "value", "fwd_ret_1m")
    ranked = pooled_rank(pooled_rank(rows, "value", "factor"), "fwd_ret_1m", "factor")
    return ranked.groupBy("factor").agg(F.count("*").alias("n"), _corr("value", "fwd_ret_1m", 3).alias("ic"))


def quantile_buckets(long: DataFrame, buckets: int = 5, least: int = 20) -> DataFrame:
    """Adds bucket 1..buckets by right-closed linear-interpolation edges; months with repeated edges or few rows go."""
    rows = _complete(long)
    w = Window.partitionBy("factor", "month")
    edges = F.percentile("value", [i / buckets for i in range(buckets + 1)]).over(w)
    rows = rows.withColumns({"_edges": edges, "_n": F.count("*").over(w)}).filter((F.col("_n") >= least) & (F.size(F.array_distinct("_edges")) == buckets + 1))
    bucket = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("value"))), F.lit(1))
    return rows.withColumn("bucket", bucket).drop("_edges", "_n")


def quantile_spread(long: DataFrame, buckets: int = 5, least: int = 20) -> DataFrame:
    """factor, month, bottom, top, spread of mean returns, winsorised at 1 % and 99 % of the month's."""
    rows = quantile_buckets(long, buckets, least)
    w = Window.partitionBy("factor", "month")
    clipped = F.greatest(F.least("fwd_ret_1m", F.percentile("fwd_ret_1m", 0.99).over(w)), F.percentile("fwd_ret_1m", 0.01).over(w))
    rows = rows.withColumn("fwd_ret_1m", clipped)
    out = rows.groupBy("factor", "month").agg(F.avg(F.when(F.col("bucket") == 1, F.col("fwd_ret_1m"))).alias("bottom"), F.avg(F.when(F.col("bucket") == buckets, F.col("fwd_ret_1m"))).alias("top"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def bucket_turnover(long: DataFrame, buckets: int = 5, least: int = 20) -> DataFrame:
    """factor, turnover: share of rows whose bucket differs from the instrument's row before."""
    rows = quantile_buckets(long, buckets, least)
    before = F.lag("bucket").over(Window.partitionBy("factor", "instrument").orderBy("month"))
    return rows.withColumn("_before", before).filter("_before is not null").groupBy("factor").agg(F.avg((F.col("bucket") != F.col("_before")).cast("double")).alias("turnover"), F.count("*").alias("n"))


def regime_stability(ic: DataFrame, regimes: list[tuple[str, str, str]], least_months: int = 6, share: float = 0.75) -> DataFrame:
    """factor, regimes, positive, stable: mean IC in named periods, stable if enough of them agree in sign."""
    spark = ic.sparkSession
    table = spark.createDataFrame(regimes, "regime string, first string, final string")
    table = table.select("regime", F.to_date("first").alias("first"), F.to_date("final").alias("final"))
    inside = ic.join(F.broadcast(table), (F.col("month") >= F.col("first")) & (F.col("month") <= F.col("final")))
    means = inside.groupBy("factor", "regime").agg(F.avg("ic").alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= least_months)
    out = means.groupBy("factor").agg(F.count("*").alias("regimes"), F.sum((F.round("ic", 12) > 0).cast("long")).alias("positive"))
    return out.withColumn("stable", F.greatest("positive", F.col("regimes") - F.col("positive")) >= share * F.col("regimes"))


def health(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """factor, ic_is, ic_oos, decay_ratio, health: GREEN, AMBER, RED or GREY by how the later mean IC holds up."""
    both = inside.select("factor", F.round("ic_mean", 12).alias("ic_is")).join(outside.select("factor", F.round("ic_mean", 12).alias("ic_oos")), "factor", "left")
    both = both.withColumn("decay_ratio", F.when(F.abs("ic_is") > 1e-10, F.col("ic_oos") / F.col("ic_is")))
    ratio = F.abs("decay_ratio")
    label = F.when(F.col("decay_ratio").isNull(), "GREY").when(F.col("decay_ratio") < 0, "RED").when(ratio >= 0.7, "GREEN").when(ratio >= 0.3, "AMBER").otherwise("RED")
    return both.withColumn("health", label)


def rank_correlations(panel: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho for each pair of columns: Pearson of pooled average ranks of rows that have all columns."""
    rows = panel.dropna(subset=columns).select("month", "instrument", *columns)
    ranked = pooled_rank(rows.unpivot(["month", "instrument"], columns, "factor", "value"), "value", "factor")
    rows = ranked.groupBy("month", "instrument").pivot("factor", columns).agg(F.max("value"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.agg(*[_corr(a, b, 3).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], wide.columns, "pair", "rho")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "rho")


def step_up(tests: DataFrame, level: float, any_dependence: bool = True) -> DataFrame:
    """factor, p, rank, threshold, adjusted, rejected: the step-up test over all rows, with the harmonic factor or not.

    One row a factor: the windows without partitions see as many rows as there are factors.
    """
    order = Window.orderBy("p", "factor")
    whole = Window.partitionBy()
    ranked = tests.withColumns({"rank": F.row_number().over(order), "_m": F.count("*").over(whole)})
    factor = F.sum(1 / F.col("rank")).over(whole) if any_dependence else F.lit(1.0)
    ranked = ranked.withColumn("_c", factor).withColumn("threshold", F.col("rank") * level / (F.col("_m") * F.col("_c")))
    ranked = ranked.withColumn("_last", F.max(F.when(F.col("p") <= F.col("threshold"), F.col("rank"))).over(whole))
    above = Window.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    adjusted = F.least(F.min(F.col("p") * F.col("_m") * F.col("_c") / F.col("rank")).over(above), F.lit(1.0))
    return ranked.withColumns({"adjusted": adjusted, "rejected": F.coalesce(F.col("rank") <= F.col("_last"), F.lit(False))}).drop("_m", "_c", "_last")


def rank_persistence(long: DataFrame, lags: list[int], least: int = 20) -> DataFrame:
    """factor, lag, rho, n_months: mean rank correlation of a factor with itself `lag` months on."""
    numbered = month_number(long.filter("value is not null")).select("factor", "instrument", "k", "month", "value")
    later = numbered.select("factor", "instrument", "k", F.col("value").alias("later"))
    pairs = numbered.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("k", F.col("k") + F.col("lag")).join(later, ["factor", "instrument", "k"])
    ranked = pairs.withColumns({"value": average_rank(F.col("value"), "factor", "lag", "month"), "later": average_rank(F.col("later"), "factor", "lag", "month")})
    rho = ranked.groupBy("factor", "lag", "month").agg(_corr("value", "later", least).alias("rho")).filter("rho is not null")
    return rho.groupBy("factor", "lag").agg(F.avg("rho").alias("rho"), F.count("*").alias("n_months"))


def fold_weights(ic: DataFrame, folds: list[tuple[str, str]], least_months: int = 12) -> DataFrame:
    """first, final, factor, weight: for each run of test months the factors' shares of the mean size of the IC before it, with signs.

    A factor's weight is the mean of the IC's size over the months before the fold, over the sum of all factors', with the sign of the
    mean IC of these months; factors with fewer than `least_months` of them have none. Folds are a short table.
    """
    table = ic.sparkSession.createDataFrame(folds, "first string, final string").select(F.to_date("first").alias("first"), F.to_date("final").alias("final"))
    past = ic.join(F.broadcast(table), F.col("month") < F.col("first"))
    means = past.groupBy("first", "final", "factor").agg(F.avg(F.abs("ic")).alias("_m"), F.signum(F.round(F.avg("ic"), 12)).alias("_s"), F.count("*").alias("_n")).filter(F.col("_n") >= least_months)
    return means.select("first", "final", "factor", (F.col("_s") * F.col("_m") / F.sum("_m").over(Window.partitionBy("first"))).alias("weight"))
