"""Recursions and path statistics that frames can't express, and long runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import lag, last_rows, running
from panelloom.functions.scan import exponential_means

EPS = 1e-9


def oscillators(daily: DataFrame) -> DataFrame:
    """instrument, date, rsi_14, macd_signal, macd_hist, atr_21d_norm, from exponential means over all rows before (see scan)."""
    c = F.col("close")
    rows = daily.select("instrument", "date", "close", "high", "low", lag("close").alias("_b"))
    rows = rows.withColumns({"_d": c - F.col("_b"), "_up": F.greatest(c - F.col("_b"), F.lit(0.0)), "_down": F.greatest(F.col("_b") - c, F.lit(0.0))})
    rows = rows.withColumns({"_up": F.when(F.col("_d").isNotNull(), F.col("_up")), "_down": F.when(F.col("_d").isNotNull(), F.col("_down")), "_n": F.count("_d").over(running())})
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_b")), F.abs(F.col("low") - F.col("_b")))
    rows = exponential_means(rows, {"_gain": (F.col("_up"), 1 / 14), "_loss": (F.col("_down"), 1 / 14), "_fast": (c, 2 / 13), "_slow": (c, 2 / 27), "_range": (true_range, 2 / 15)})
    rows = rows.withColumn("macd_signal", (F.col("_fast") - F.col("_slow")) / (c + EPS))
    rows = exponential_means(rows, {"_smooth": (F.col("macd_signal"), 2 / 10)})
    rsi = F.when(F.col("_n") >= 14, 100 - 100 / (1 + F.col("_gain") / (F.col("_loss") + EPS)))
    return rows.select("instrument", "date", rsi.alias("rsi_14"), "macd_signal", (F.col("macd_signal") - F.col("_smooth")).alias("macd_hist"), (F.col("_range") / (c + EPS)).alias("atr_21d_norm"))


def _windowed(daily: DataFrame, n: int) -> DataFrame:
    """The returns of the last n rows, oldest first, as an array without nulls."""
    return daily.withColumn("_w", F.collect_list("r").over(last_rows(n)))


def longest_runs(daily: DataFrame, n: int = 63) -> DataFrame:
    """cand_max_consec_up_63d and cand_max_consec_down_63d: the longest run of rises and falls in the window."""
    start = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("most"))

    def longest(keep):
        def step(a, x):
            now = F.when(keep(x), a["now"] + 1).otherwise(0.0)
            return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

        return F.aggregate("_w", start, step, lambda a: a["most"])

    enough = F.size("_w") >= n // 3
    return _windowed(daily, n).withColumns({"cand_max_consec_up_63d": F.when(enough, longest(lambda x: x > 0)), "cand_max_consec_down_63d": F.when(enough, longest(lambda x: x < 0))}).drop("_w")


def entropy(daily: DataFrame, n: int = 21, bins: int = 5, least: int = 10) -> DataFrame:
    """cand_return_entropy_21d: Shannon entropy of the window's returns in equal-width bins; null if they are all equal."""
    df = _windowed(daily, n).withColumns({"_lo": F.array_min("_w"), "_hi": F.array_max("_w")})
    bin_of = lambda x: F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    share = lambda b: F.size(F.filter("_w", lambda x: bin_of(x) == b)) / F.size("_w")
    terms = F.transform(F.array(*[F.lit(i) for i in range(bins)]), share)
    value = F.aggregate(terms, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return df.withColumn("cand_return_entropy_21d", F.when((F.size("_w") >= least) & (F.col("_hi") > F.col("_lo")), value)).drop("_w", "_lo", "_hi")


def hurst(daily: DataFrame, n: int = 63, least: int = 20) -> DataFrame:
    """hurst_63d: ln(range of the summed deviations / population spread) / ln(rows) of the window's returns."""
    df = _windowed(daily, n).withColumn("_n", F.size("_w"))
    df = df.withColumn("_mean", F.when(F.col("_n") >= least, F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / F.col("_n")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0.0).alias("q"))

    def step(a, x):
        d = x - F.col("_mean")
        s = a["s"] + d
        return F.struct(s.alias("s"), F.least(a["lo"], s).alias("lo"), F.greatest(a["hi"], s).alias("hi"), (a["q"] + d * d).alias("q"))

    df = df.withColumn("_a", F.aggregate("_w", start, step))
    spread = F.sqrt(F.try_divide(F.col("_a.q"), F.col("_n")))
    ratio = F.try_divide(F.col("_a.hi") - F.col("_a.lo"), spread)
    return df.withColumn("hurst_63d", F.when((F.col("_n") >= least) & (spread > 1e-12) & (ratio > 0), F.log(ratio) / F.log(F.col("_n").cast("double")))).drop("_w", "_n", "_mean", "_a")


def volume_rank_momentum(daily: DataFrame, n: int = 21, least: int = 10) -> DataFrame:
    """cand_volume_return_mom_21d: sum over the window of returns times the volume's average-tie rank in its own window."""
    df = daily.withColumns({"_v": F.collect_list("volume").over(last_rows(n))})
    below, ties = F.size(F.filter("_v", lambda x: x < F.col("volume"))), F.size(F.filter("_v", lambda x: x == F.col("volume")))
    df = df.withColumn("_x", F.when(F.size("_v") >= least, F.col("r") * (below + (ties + 1) / 2) / F.size("_v")))
    total = F.when(F.count("_x").over(last_rows(n)) >= least, F.sum("_x").over(last_rows(n)))
    return df.withColumn("cand_volume_return_mom_21d", total).drop("_v", "_x")


def fractal_dimension(daily: DataFrame, n: int = 63, least: int = 20) -> DataFrame:
    """cand_fractal_dim_63d: 1 + ln(path length / (net move + 1e-10)) / ln(rows) over the window's returns."""
    df = _windowed(daily, n)
    steps = F.zip_with(F.slice("_w", 2, n), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    length = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    net = F.abs(F.element_at("_w", -1) - F.element_at("_w", 1))
    value = 1 + F.log(length / (net + 1e-10)) / F.log(F.size("_w").cast("double"))
    return df.withColumn("_len", F.when(F.size("_w") >= least, length)).withColumn("cand_fractal_dim_63d", F.when(F.col("_len") > 0, value)).drop("_w", "_len")
