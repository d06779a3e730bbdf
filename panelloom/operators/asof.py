"""As-of joins: the last row of the right side at or before each row's date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str = "instrument", on: str = "date", columns: tuple[str, ...] = (), days: int | None = None, days_old: str | None = None) -> DataFrame:
    """left with `columns` of the last right row of the same `by` whose date is not later.

    Both sides are stacked and the last right row is carried forward, one exchange in all. It is the last *row*: its
    nulls stay nulls, and a row older than `days` gives nulls, not an older one. The right side must be unique by
    (by, on). days_old names a column for the age in days.
    """
    value = F.struct(F.col(on).alias("_at"), *columns)
    rows = left.withColumns({"_row": F.struct(*left.columns), "_side": F.lit(1)}).select(by, on, "_row", "_side", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"))
    marks = right.select(by, on, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), value.alias("_value"))
    order = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(marks).withColumn("_value", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1")
    age = F.datediff(F.col(on), F.col("_value._at"))
    fresh = F.lit(True) if days is None else age <= days
    out = carried.select("_row.*", *[F.when(fresh, F.col(f"_value.{c}")).alias(c) for c in columns], *([F.when(fresh, age).alias(days_old)] if days_old else []))
    return out


def forward_fill(df: DataFrame, column: str, by: str = "instrument", on: str = "date") -> DataFrame:
    """The last value that is not null, up to each row."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)))


def trading_days_ahead(bars: DataFrame, k: int) -> DataFrame:
    """instrument, date, ahead: the close k days on in the market's calendar, where the instrument traded that day."""
    days = bars.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    numbered = bars.select("instrument", "date", "close").join(F.broadcast(days), "date")
    later = numbered.select("instrument", (F.col("day") - k).alias("day"), F.col("close").alias("ahead"))
    return numbered.join(later, ["instrument", "day"], "left").select("instrument", "date", "close", "ahead")


def keep_last(snapshots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order: a snapshot appended to an older one replaces it."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return snapshots.withColumn("_at", at).filter("_at = 1").drop("_at")


def interval_join(points: DataFrame, spans: DataFrame, by: str, on: str, first: str, last: str, width: int) -> DataFrame:
    """Every point with every span of the same `by` that holds its date, both ends included; other columns must have names of their own.

    Dates are cut into buckets of `width` days. A point is in one bucket and a span in all that it touches, so a pair meets once, and
    a point meets the spans of its bucket instead of all of its `by`: choose a width about as long as the spans.
    """
    bucket = lambda d: F.floor(F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) / width)
    held = spans.filter(F.col(first) <= F.col(last)).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    return points.withColumn("_bucket", bucket(on)).join(held, [by, "_bucket"]).filter(F.col(on).between(F.col(first), F.col(last))).drop("_bucket")
