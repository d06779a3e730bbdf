"""Side tables that are landed under other names and dates than the panel's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.asof import asof_join
from panelloom.sources.landing import base_ticker


def merge_by_base(panel: DataFrame, side: DataFrame, columns: list[str], ticker: str = "ticker", base: str = "base") -> DataFrame:
    """panel (ticker, month, ..) with columns of a side table (base, date, ..) that knows tickers without exchange suffixes.

    A side row stands for its date's month, and the last date of a month counts (ties: the largest values, column by column). A base is the ticker
    that has it, the smallest of several; a base that no ticker has goes. Values are carried forward over each ticker's months,
    null by null, and are 0 before the first. One exchange by base and one by ticker.
    """
    first = panel.select(ticker, base_ticker(ticker).alias("_base")).groupBy("_base").agg(F.min(ticker).alias(ticker))
    last = side.groupBy(F.col(base).alias("_base"), F.trunc("date", "month").alias("month")).agg(F.max(F.struct("date", *columns)).alias("_last"))
    known = last.join(first, "_base").select(ticker, "month", *[F.col(f"_last.{c}").alias(c) for c in columns])
    joined = panel.drop(*columns).join(known, [ticker, "month"], "left")
    so_far = Window.partitionBy(ticker).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0.0)) for c in columns})


def _log(value: Column) -> Column:
    """The logarithm of a positive finite number, else null."""
    return F.when((value > 0) & (value < float("inf")), F.ln(value))


def log_size(rows: DataFrame, caps: DataFrame, shares: DataFrame, days: int = 185) -> DataFrame:
    """rows (instrument, month, date, close) with log_mktcap and its origin: the cap of the month where one is known, else shares times close.

    caps: instrument, month, mktcap, one row each. shares: instrument, date, shares; the last row at or before a date counts for
    `days` days. Where neither gives a positive number, log_mktcap and origin are null.
    """
    known = asof_join(rows, shares, columns=("shares",), days=days).join(caps, ["instrument", "month"], "left")
    both = known.withColumns({"_cap": _log(F.col("mktcap")), "_made": F.when((F.col("shares") > 0) & (F.col("close") > 0), _log(F.col("shares") * F.col("close")))})
    origin = F.when(F.col("_cap").isNotNull(), "cap").when(F.col("_made").isNotNull(), "shares")
    return both.withColumns({"log_mktcap": F.coalesce("_cap", "_made"), "origin": origin}).drop("_cap", "_made", "mktcap", "shares")
