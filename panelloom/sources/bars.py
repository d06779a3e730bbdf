"""Daily bars and the tables around them, from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.frames import by_date, lag, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """instrument, date, open, high, low, close, volume, dollar_vol: one row per supplier and ship date.

    Lines are dealt by instrument once, for the bars and all windows over them. The number of tasks is fixed, as adaptive execution
    would merge them by bytes, which say little of the work on an instrument's rows.

    close is the volume-weighted price, open that of the first line by order, line, part and price. Money is summed as
    decimals, so that no order of rows changes a bar.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    kept = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    lines = lineitem.filter(F.col("l_quantity") > 0).select(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("date"), *kept)
    bars = lines.repartition(_tasks(lines), "instrument").groupBy("instrument", "date")
    bars = bars.agg(first.alias("f"), F.max(price).alias("high"), F.min(price).alias("low"), money.alias("dollar_vol"), F.sum("l_quantity").alias("volume"))
    return bars.select(
        "instrument", "date", (F.col("f.l_extendedprice") / F.col("f.l_quantity")).alias("open"), "high", "low",
        (F.col("dollar_vol") / F.col("volume")).alias("close"), "volume", "dollar_vol",
    )


def market(bars: DataFrame) -> DataFrame:
    """date, level, m: the price over all instruments and its change. One row a date, so its window is a small one."""
    return _with_change(bars.groupBy("date").agg((F.sum(F.col("dollar_vol").cast("decimal(18,2)")).cast("double") / F.sum("volume")).alias("level")))


def market_of(lineitem: DataFrame) -> DataFrame:
    """The same market straight from the lines, without making bars: only sums of dates leave a task."""
    price, size = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity")
    days = lineitem.filter(size > 0).groupBy(F.col("l_shipdate").cast("date").alias("date"))
    return _with_change(days.agg((F.sum(price).cast("double") / F.sum(size)).alias("level")))


def _with_change(level: DataFrame) -> DataFrame:
    old = F.lag("level").over(Window.orderBy("date"))
    return level.withColumn("m", F.when(old != 0, F.col("level") / old - 1))


def with_returns(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Bars with t (row number), r (change of the last known close) and, given a market, m and what else it has by date."""
    bars = bars.withColumn("close", F.last("close", ignorenulls=True).over(running()))
    old = lag("close")
    out = bars.withColumns({"t": F.row_number().over(by_date()).cast("double"), "r": F.when(old != 0, F.col("close") / old - 1)})
    # a row a day of the calendar
    return out if index is None else out.join(F.broadcast(index.drop("level")), "date", "left")


def month_ends(bars: DataFrame) -> DataFrame:
    """The last bar of each instrument and month, with the month's first day as `month`."""
    month = F.trunc("date", "month")
    return bars.withColumn("month", month).groupBy("instrument", "month").agg(F.max_by(F.struct("*"), "date").alias("x")).select("x.*")


def weights(bars: DataFrame) -> DataFrame:
    """month, instrument, value, weight: shares of each month's money."""
    value = bars.groupBy(F.trunc("date", "month").alias("month"), "instrument").agg(F.sum(F.col("dollar_vol").cast("decimal(18,2)")).cast("double").alias("value"))
    return value.withColumn("weight", F.col("value") / F.sum("value").over(Window.partitionBy("month")))


def side(orders: DataFrame, instruments: int) -> DataFrame:
    """instrument, date, side_value: the last order value of a day, unique by instrument and date."""
    key = F.pmod(F.col("o_custkey"), F.lit(instruments)) + 1
    last = F.max(F.struct("o_orderkey", "o_totalprice"))
    rows = orders.groupBy(key.alias("instrument"), F.col("o_orderdate").cast("date").alias("date")).agg(last.alias("x"))
    return rows.select("instrument", "date", F.col("x.o_totalprice").alias("side_value"))
