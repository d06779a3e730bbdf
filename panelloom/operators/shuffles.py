"""Shuffle tests of many columns at once: one set of dealt returns for all columns, as products of matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.panel import average_rank

#: Rows of a month that one task deals anew among themselves.
BLOCK_ROWS = 20_000
#: A column of ranks, or of dealt returns, whose spread is smaller is constant.
FLAT = 1e-6
#: Sums of a column over a month's rows, and of each deal.
SUMS = "factor string, k long, n double, x double, xx double, y binary, yy binary, xy binary"


def dealt(y: np.ndarray, sims: int, seed: list[int]) -> np.ndarray:
    """The values in place, and dealt anew `sims` times: (len(y), sims + 1)."""
    orders = np.random.default_rng(seed).permuted(np.tile(np.arange(len(y)), (sims, 1)), axis=1)
    return np.column_stack((y, y[orders.T])) if sims else y[:, None]


def block_sums(x: np.ndarray, y: np.ndarray, sims: int, seed: list[int]) -> dict[str, np.ndarray]:
    """Of each column: n, x, xx over the rows that have it; of each column and deal of y: y, yy, xy over the same rows."""
    y, has = dealt(y, sims, seed), ~np.isnan(x)
    m, z = has.astype(float), np.where(has, x, 0)
    return {"n": m.sum(axis=0), "x": z.sum(axis=0), "xx": (z * z).sum(axis=0), "y": m.T @ y, "yy": m.T @ (y * y), "xy": z.T @ y}


def month_sums(ranks: list[np.ndarray], y: np.ndarray, instrument: np.ndarray, block: np.ndarray, month: int, sims: int, seed: int = 27) -> dict[str, np.ndarray]:
    """`block_sums` of a whole month: columns of ranks, and the target's, which is NaN where there is none; blocks are dealt one after the other."""
    whole, there = None, ~np.isnan(y)
    for b in np.unique(block[there]).tolist():
        at = np.flatnonzero(there & (block == b))
        at = at[np.argsort(instrument[at], kind="stable")]
        now = block_sums(np.column_stack([r[at] for r in ranks]), y[at], sims, [seed, month, b])
        whole = now if whole is None else {c: whole[c] + now[c] for c in now}
    return whole


def _sums(names: list[str], sims: int, seed: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("instrument", ignore_index=True)
        month, block = int(g["_k"].iat[0]), int(g["_block"].iat[0])
        made = block_sums(g[names].to_numpy(float), g["_y"].to_numpy(float), sims, [seed, month, block])
        return pd.DataFrame({"factor": names, "k": month, **{c: list(v) if v.ndim == 1 else [b.tobytes() for b in v] for c, v in made.items()}})

    return run


def _tested(sims: int, least: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        # blocks of a month are added up; a factor has a row a month and block
        months, at = np.unique(g["k"].to_numpy(), return_inverse=True)
        add = lambda v: np.stack([v[at == i].sum(axis=0) for i in range(len(months))])
        n, x, xx = (add(g[c].to_numpy(float))[:, None] for c in ("n", "x", "xx"))
        y, yy, xy = (add(np.frombuffer(b"".join(g[c])).reshape(len(g), sims + 1)) for c in ("y", "yy", "xy"))
        with np.errstate(divide="ignore", invalid="ignore"):
            sx, sy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
            ic = (xy / n - x * y / n**2) / np.sqrt(sx * sy)
        ic = np.where((n >= least) & (sx > FLAT**2) & (sy > FLAT**2), ic, np.nan)
        ic = ic[~np.isnan(ic[:, 0])]
        if not len(ic):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("factor", str), ("n_months", "int64"), ("ic_mean", float), ("icir", float), ("p", float), ("p_icir", float))})
        mean = np.nanmean(ic, axis=0)
        ratio = mean / (np.nanstd(ic, axis=0) + 1e-9)
        large = lambda v: float((np.round(np.abs(v[1:]), 12) >= np.round(abs(v[0]), 12)).mean()) if sims else None
        return pd.DataFrame({"factor": [g["factor"].iat[0]], "n_months": [len(ic)], "ic_mean": [mean[0]], "icir": [ratio[0]], "p": [large(mean)], "p_icir": [large(ratio)]})

    return run


def block_of(largest: int) -> Column:
    """A row's block, by its instrument, where the largest month has so many rows."""
    return F.pmod(F.xxhash64("instrument"), F.lit(max(1, -(-largest // BLOCK_ROWS)))).cast("int")


def largest_month(rows: DataFrame) -> int:
    return rows.groupBy("month").count().agg(F.max("count").alias("n")).first()["n"] or 0


def shuffled_ic(ranks: DataFrame, names: list[str], target: str = "fwd_ret_1m", sims: int = 200, least: int = 20, seed: int = 27, largest: int | None = None) -> DataFrame:
    """factor, n_months, ic_mean, icir, p, p_icir of every column: two-sided shares of shuffles whose mean IC, or its ratio to their spread, is as large.

    ranks: month, instrument, target and the columns, as shares of their ranks in the month. The target's ranks in a month are dealt anew among its rows, `sims` times, the same
    way for all columns, so a month's correlations with all columns and shuffles are one product of matrices over the rows that
    have both. A month of more than BLOCK_ROWS rows is dealt within blocks of its rows, whose sums are added. Rows without a
    target go; a month with fewer than `least` values of a column, or constant ones, doesn't count for it. What a shuffle is depends on the
    seed, the month and the instruments, not on partitions. Ranks may bring the target's as `_y`, and `largest`, the most rows
    with a target that a month has, saves making them to be counted.
    """
    rows = ranks.filter(F.col(target).isNotNull())
    if largest is None:
        largest = largest_month(rows)
    if "_y" not in rows.columns:
        rows = rows.withColumn("_y", average_rank(F.col(target), "month") / F.count("*").over(Window.partitionBy("month")))
    rows = rows.withColumns({"_block": block_of(largest), "_k": F.year("month") * 12 + F.month("month")})
    return tested(rows.groupBy("month", "_block").applyInPandas(_sums(names, sims, seed), SUMS), sims, least)


def tested(sums: DataFrame, sims: int, least: int) -> DataFrame:
    """factor, n_months, ic_mean, icir, p, p_icir from the sums (SUMS) of months, or of blocks of months."""
    return sums.groupBy("factor").applyInPandas(_tested(sims, least), "factor string, n_months long, ic_mean double, icir double, p double, p_icir double")
