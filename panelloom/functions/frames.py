"""Rolling and running expressions over each instrument's rows, in date order.

All frames share one partitioning and order, so that a job with many of them exchanges and sorts its rows once.
Missing values are nulls; a window's value is null until it has `least` values that are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    return Window.partitionBy("instrument").orderBy("date")


def running():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_rows(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_date())


def rolling(f, x: str | Column, n: int, least: int | None = None) -> Column:
    """f over the last n rows, if at least `least` of them (default n) have a value."""
    x = col(x)
    return F.when(F.count(x).over(last_rows(n)) >= (n if least is None else least), f(x).over(last_rows(n)))


def rolling2(f, x: str | Column, y: str | Column, n: int, least: int) -> Column:
    """A statistic of pairs over the last n rows, if `least` of them have both."""
    x, y = col(x), col(y)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(last_rows(n))
    return F.when(both >= least, f(x, y).over(last_rows(n)))


def mean(x, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, n, least)


def total(x, n: int, least: int | None = None) -> Column:
    return rolling(F.sum, x, n, least)


def std(x, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, least)


def high(x, n: int, least: int | None = None) -> Column:
    return rolling(F.max, x, n, least)


def low(x, n: int, least: int | None = None) -> Column:
    return rolling(F.min, x, n, least)


def quantile(x, p: float, n: int, least: int | None = None) -> Column:
    """Linear interpolation between order statistics."""
    return rolling(lambda c: F.percentile(c, p), x, n, least)


def corr(x, y, n: int, least: int) -> Column:
    """Pearson correlation of the rows that have both; null where either is constant."""
    x, y = col(x), col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x).over(last_rows(n)) * F.stddev_pop(y).over(last_rows(n))
    return F.when(F.count(x).over(last_rows(n)) >= least, F.when(spread > 1e-15, F.covar_pop(x, y).over(last_rows(n)) / spread))


def beta(y, x, n: int, least: int, eps: float = 1e-12) -> Column:
    """Covariance of both over the variance of all of x in the frame."""
    return rolling2(F.covar_samp, y, x, n, least) / (F.var_samp(col(x)).over(last_rows(n)) + eps)


def skew(x, n: int, least: int) -> Column:
    """Bias-corrected skewness of at least three values that differ."""
    x = col(x)
    k, g = F.count(x).over(last_rows(n)), F.skewness(x).over(last_rows(n))
    return F.when((k >= max(least, 3)) & (F.stddev_pop(x).over(last_rows(n)) > 0), g * F.sqrt(k * (k - 1)) / (k - 2))


def kurt(x, n: int, least: int) -> Column:
    """Bias-corrected excess kurtosis of at least four values that differ."""
    x = col(x)
    k, g = F.count(x).over(last_rows(n)), F.kurtosis(x).over(last_rows(n))
    return F.when((k >= max(least, 4)) & (F.stddev_pop(x).over(last_rows(n)) > 0), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g + 6))


def slope(x, n: int) -> Column:
    """Least-squares slope on the row number over a full window."""
    return F.when(F.count(col(x)).over(last_rows(n)) >= n, F.regr_slope(col(x), F.col("t")).over(last_rows(n)))


def fit_r2(x, n: int) -> Column:
    """R squared of that fit; 1 for a flat window."""
    x = col(x)
    flat = F.var_pop(x).over(last_rows(n)) * n < 1e-14
    return F.when(F.count(x).over(last_rows(n)) >= n, F.when(flat, 1.0).otherwise(F.regr_r2(x, F.col("t")).over(last_rows(n))))


def change(x: str, k: int) -> Column:
    """Relative change over k rows, of the last known values; null where the older one is zero."""
    old = lag(x, k)
    return F.when(old != 0, col(x) / old - 1)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown comparison is 0."""
    return F.when(condition, 1.0).otherwise(0.0)


def safe_div(a, b, eps: float = 1e-10) -> Column:
    return F.when(F.abs(col(b)) > eps, col(a) / col(b))


class Sums:
    """Frames by running sums: a window's sum is the difference of two of them, so a row costs the same for any window.

    The sums are decimals of 18 places, so differences of long ones lose nothing: for values of the size of returns and
    their products. `add` gives the columns of the running sums, which have to be there before anything else is used.
    """

    def __init__(self, **values: Column):
        self.values = values

    def add(self, df: DataFrame) -> DataFrame:
        sums = {f"_s_{k}": F.sum(F.coalesce(v, F.lit(0.0)).cast("decimal(38,18)")).over(running()) for k, v in self.values.items()}
        counts = {f"_n_{k}": F.count(v).over(running()) for k, v in self.values.items()}
        return df.withColumns(sums | counts)

    def names(self) -> list[str]:
        return [f"{a}_{k}" for a in ("_s", "_n") for k in self.values]

    def _within(self, column: str, n: int) -> Column:
        return F.col(column) - F.coalesce(lag(column, n), F.lit(0))

    def sum(self, k: str, n: int) -> Column:
        return self._within(f"_s_{k}", n).cast("double")

    def count(self, k: str, n: int) -> Column:
        return self._within(f"_n_{k}", n)

    def mean(self, k: str, n: int, least: int) -> Column:
        return F.when(self.count(k, n) >= F.greatest(F.lit(least), F.lit(1)), self.sum(k, n) / self.count(k, n))

    def cross(self, xy: str, x: str, y: str, n: int) -> Column:
        """Summed products of the deviations of x and y; all three must be null together."""
        return self.sum(xy, n) - self.sum(x, n) * self.sum(y, n) / F.greatest(self.count(xy, n), F.lit(1))

    def std(self, xx: str, x: str, n: int, least: int) -> Column:
        k = self.count(x, n)
        return F.when(k >= F.greatest(F.lit(least), F.lit(2)), F.sqrt(F.greatest(self.cross(xx, x, x, n), F.lit(0.0)) / (k - 1)))


class Extremes:
    """Largest and smallest values of one frame length by blocks, so a row costs the same for any window.

    A history is cut into blocks of n rows (by t, the row number). The last n rows of a row are the end of one block and the
    start of the next, so their extreme is that of a running extreme from the block's end, n - 1 rows before, and of one from the
    block's start. `add` gives those columns, which have to be there before anything else is used.
    """

    def __init__(self, n: int, **values: Column):
        self.n, self.values = n, values

    def add(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("_e_block", F.floor((F.col("t") - 1) / self.n))
        within = Window.partitionBy("instrument", "_e_block")
        up, down = within.orderBy("date").rowsBetween(Window.unboundedPreceding, 0), within.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
        sides = {f"_e_{k}_{name}_{f.__name__}": f(v).over(w) for k, v in self.values.items() for name, w in (("from", up), ("to", down)) for f in (F.max, F.min)}
        return df.withColumns(sides | {f"_e_{k}_n": F.count(v).over(running()) for k, v in self.values.items()})

    def names(self) -> list[str]:
        return ["_e_block", *[f"_e_{k}_{side}_{f}" for k in self.values for side in ("from", "to") for f in ("max", "min")], *[f"_e_{k}_n" for k in self.values]]

    def _of(self, k: str, f: str, join, least: int) -> Column:
        enough = F.col(f"_e_{k}_n") - F.coalesce(lag(f"_e_{k}_n", self.n), F.lit(0)) >= max(least, 1)
        # null sides are passed over
        return F.when(enough, join(F.col(f"_e_{k}_from_{f}"), lag(f"_e_{k}_to_{f}", self.n - 1)))

    def high(self, k: str, least: int) -> Column:
        return self._of(k, "max", F.greatest, least)

    def low(self, k: str, least: int) -> Column:
        return self._of(k, "min", F.least, least)
