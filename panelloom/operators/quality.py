"""Invariants of the tables a panel is built from, as one row a check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, value, good) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check"), "value", F.coalesce(good(F.col("value")), F.lit(False)).alias("ok"))


def audit(bars: DataFrame, weights: DataFrame, panel: DataFrame, cap: float = 0.08, names: int = 5) -> DataFrame:
    """check, value, ok for keys, prices, weights and targets. Each check is one aggregation; nothing is collected."""
    keys = bars.groupBy("instrument", "date").agg(F.count("*").alias("n"))
    sums = weights.groupBy("month").agg(F.sum("weight").alias("s"), F.max("weight").alias("w"), F.count("*").alias("n"))
    checks = [
        _row(keys, "repeated bar keys", F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)), lambda v: v == 0),
        _row(bars, "closes not positive", F.coalesce(F.sum((F.col("close") <= 0).cast("long")), F.lit(0)), lambda v: v == 0),
        _row(bars, "closes outside low and high", F.coalesce(F.sum(((F.col("close") > F.col("high") * (1 + 1e-9)) | (F.col("close") < F.col("low") * (1 - 1e-9))).cast("long")), F.lit(0)), lambda v: v == 0),
        _row(bars, "volume coverage", F.avg((F.col("volume") > 0).cast("double")), lambda v: v > 0.95),
        _row(sums, "largest error of a month's weights", F.max(F.round(F.abs(F.col("s") - 1), 9)), lambda v: v <= 1e-3),
        _row(sums, "largest weight", F.max(F.round("w", 9)), lambda v: v <= cap + 1e-4),
        _row(sums, "fewest names in a month", F.min("n"), lambda v: v >= names),
        _row(panel, "missing targets", F.avg(F.col("fwd_ret_1m").isNull().cast("double")), lambda v: v < 0.1),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def refetch_gate(old: DataFrame, new: DataFrame, least_corr: float = 0.98) -> DataFrame:
    """instruments, mean_corr, share_low, ok: whether monthly returns of a refetched table agree with the old one's."""
    both = old.select("instrument", "month", F.col("ret_1m").alias("a")).join(new.select("instrument", "month", F.col("ret_1m").alias("b")), ["instrument", "month"]).dropna()
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    each = both.groupBy("instrument").agg(F.when((F.count("*") >= 6) & (spread > 1e-15), F.covar_pop("a", "b") / spread).alias("c")).dropna()
    out = each.agg(F.count("*").alias("instruments"), F.avg("c").alias("mean_corr"), F.avg((F.col("c") < 0.95).cast("double")).alias("share_low"))
    return out.withColumn("ok", F.coalesce((F.col("mean_corr") > least_corr) & (F.col("share_low") < 0.05), F.lit(False)))


def survivorship(panel: DataFrame, months: int = 6, tail: int = 1) -> DataFrame:
    """leavers, stayers, leaver_ret, stayer_ret: mean returns of the last months, before the final one, of instruments that end early and of the others.

    An instrument leaves if its last row is over `tail` months before the panel's last month, which is one row, broadcast.
    """
    back = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("month")))
    rows = panel.select("instrument", "month", "ret_1m", F.max("month").over(Window.partitionBy("instrument")).alias("end"), back.alias("back")).filter(F.col("back").between(2, months + 1))
    final = panel.agg(F.add_months(F.max("month"), -tail).alias("cut"))
    rows = rows.join(F.broadcast(final), F.lit(True))
    left = F.col("end") < F.col("cut")
    return rows.agg(F.countDistinct(F.when(left, F.col("instrument"))).alias("leavers"), F.countDistinct(F.when(~left, F.col("instrument"))).alias("stayers"), F.avg(F.when(left, F.col("ret_1m"))).alias("leaver_ret"), F.avg(F.when(~left, F.col("ret_1m"))).alias("stayer_ret"))
