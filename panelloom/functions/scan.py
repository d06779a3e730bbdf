"""Exponential means of long series as scans over blocks of rows, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of rows loses this many powers of e at most, so weights within it keep their digits.
SPAN = 18.0
#: What earlier blocks add is followed until it is under e to the minus this.
DEPTH = 42.0


def exponential_means(rows: DataFrame, means: dict[str, tuple[Column, float]], key: str = "instrument", order: str = "date") -> DataFrame:
    """Adds the exponential mean of each column expression, given with its weight of the newest value, started at the first value.

    A row with a value is the map y -> a*y + b of the mean before it, one without is the identity; after a gap of k rows the old
    mean has weight (1-w)**k against w. Maps compose, so a row's mean is that of its own block of rows from the block's
    start (a running product and a running sum) applied to the mean at the end of the block before, and that one follows from the ends
    of a few blocks more. Rows of a block are all that a running sum spans, however long a history is; of each block
    one row goes on. Null values keep the mean, which is null before the first value.
    """
    kept = rows.columns
    size = max(2, min(int(SPAN / -math.log1p(-w)) for _, w in means.values()))
    history = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_at", F.row_number().over(history)).withColumns({f"_x_{c}": x.cast("double") for c, (x, _) in means.items()})
    rows = rows.withColumn("_block", F.floor((F.col("_at") - 1) / size))
    rows = rows.withColumns({f"_k_{c}": F.col("_at") - F.max(F.when(F.col(f"_x_{c}").isNotNull(), F.col("_at"))).over(history.rowsBetween(Window.unboundedPreceding, -1)) for c in means})
    maps = {}
    for c, (_, w) in means.items():
        x, k = F.col(f"_x_{c}"), F.col(f"_k_{c}")
        old = F.pow(F.lit(1 - w), k)
        first = k.isNull() | x.isNull()
        maps |= {f"_a_{c}": F.when(first, 1.0).otherwise(old / (old + w)), f"_b_{c}": F.when(x.isNull(), 0.0).when(k.isNull(), x).otherwise(w * x / (old + w))}
    rows = rows.withColumns(maps)
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_p_{c}": F.product(f"_a_{c}").over(within) for c in means})
    rows = rows.withColumns({f"_y_{c}": F.col(f"_p_{c}") * F.sum(F.col(f"_b_{c}") / F.col(f"_p_{c}")).over(within) for c in means})

    ends = rows.groupBy(key, "_block").agg(*[f(x).alias(x) for c in means for f, x in ((lambda x: F.max_by(x, "_at"), f"_p_{c}"), (lambda x: F.max_by(x, "_at"), f"_y_{c}"), (F.count, f"_x_{c}"))])
    blocks = Window.partitionBy(key).orderBy("_block")
    carried = {}
    for c, (_, w) in means.items():
        # among blocks with a value, so that two of them in a row always lose a block's share
        has = F.col(f"_x_{c}") > 0
        valued = Window.partitionBy(key, has).orderBy("_block")
        p, total, share = F.col(f"_p_{c}"), F.col(f"_y_{c}"), F.col(f"_p_{c}")
        for j in range(1, 2 + math.ceil(DEPTH / (size * -math.log1p(-w)))):
            total = total + share * F.coalesce(F.lag(f"_y_{c}", j).over(valued), F.lit(0.0))
            share = share * F.coalesce(F.lag(p, j).over(valued), F.lit(0.0))
        carried[f"_c_{c}"] = F.when(has, total)
    ends = ends.withColumns(carried)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_own"), *[F.last(f"_c_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in means])
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_own")))
    started = lambda c: F.col(f"_x_{c}").isNotNull() | F.col(f"_k_{c}").isNotNull()
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.when(started(c), F.col(f"_y_{c}") + F.col(f"_p_{c}") * F.coalesce(f"_c_{c}", F.lit(0.0))).alias(c) for c in means])
