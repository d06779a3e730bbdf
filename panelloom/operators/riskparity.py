"""Weights by equal contributions to risk, a month's names at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.asof import interval_join


def denoised_covariance(cov: np.ndarray, share: float = 0.95) -> np.ndarray:
    """The leading components that hold a share of the variance, and the rest as each name's own variance."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share)) + 1, len(values))
    out = (vectors[:, :k] * values[:k]) @ vectors[:, :k].T
    np.fill_diagonal(out, np.diag(cov))
    return out


def equal_risk(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Long-only weights whose contributions to the variance are equal, by turns: each name's weight solves its own quadratic."""
    n = len(cov)
    own = np.clip(np.diag(cov), 1e-12, None)
    w = 1 / np.sqrt(own)
    for _ in range(rounds):
        before = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * own[i] / n)) / (2 * own[i])
        if np.abs(w - before).max() <= 1e-13 * w.max():
            break
    return w / w.sum()


def _histories(scored: DataFrame, daily: DataFrame, names: int, days: int) -> DataFrame:
    """month, instrument, date, r: the returns of the `days` days up to a month's end of its best scores, by an interval join."""
    best = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("score"), "instrument"))
    chosen = scored.filter("score is not null").withColumn("_k", best).filter(F.col("_k") <= names)
    chosen = chosen.select("month", "instrument", F.date_sub(F.last_day("month"), days - 1).alias("_from"), F.last_day("month").alias("_until"))
    rows = daily.filter("r is not null").select("instrument", "date", "r")
    return interval_join(rows, chosen, "instrument", "date", "_from", "_until", days).select("month", "instrument", "date", "r")


def _matrix(x: pd.DataFrame, least: int) -> pd.DataFrame:
    wide = x.pivot_table(index="date", columns="instrument", values="r")
    return wide.loc[:, wide.count() >= least].fillna(0.0)


def risk_parity(scored: DataFrame, daily: DataFrame, names: int = 20, days: int = 378, least: int = 60) -> DataFrame:
    """month, instrument, weight, vol, risk_share: equal-risk weights of a month's best scores, by returns of the days up to its end.

    Only the chosen names' returns meet (names times days a month), and each month is a task of its own.
    """

    def weigh(x: pd.DataFrame) -> pd.DataFrame:
        wide = _matrix(x, least)
        columns = ["month", "instrument", "weight", "vol", "risk_share"]
        if wide.shape[1] < 2:
            return pd.DataFrame(columns=columns)
        cov = denoised_covariance(np.cov(wide.to_numpy(), rowvar=False))
        w = equal_risk(cov)
        part = w * (cov @ w)
        return pd.DataFrame({"month": x["month"].iat[0], "instrument": wide.columns, "weight": w, "vol": np.sqrt(np.diag(cov)), "risk_share": part / part.sum()}, columns=columns)

    return _histories(scored, daily, names, days).groupBy("month").applyInPandas(weigh, f"month date, instrument {dict(scored.dtypes)['instrument']}, weight double, vol double, risk_share double")


def covariance_diagnostics(scored: DataFrame, daily: DataFrame, names: int = 20, days: int = 378, least: int = 60, share: float = 0.95) -> DataFrame:
    """month, n, raw_cond, clean_cond, k, explained, raw_change, clean_change of the months' covariances, raw and cleaned.

    cond is the largest eigenvalue over the smallest, k how many leading components hold `share` of the variance and explained
    what they hold; change is the size of the difference from the month before over that month's size, on the names that both
    have. A month is a task, and gives one row with its matrices (names by names), which meets the month before by a lag.
    """
    kind = dict(scored.dtypes)["instrument"]

    def one(x: pd.DataFrame) -> pd.DataFrame:
        wide = _matrix(x, least)
        columns = ["month", "n", "raw_cond", "clean_cond", "k", "explained", "names", "raw", "clean"]
        if wide.shape[1] < 2:
            return pd.DataFrame(columns=columns)
        raw = np.cov(wide.to_numpy(), rowvar=False)
        clean = denoised_covariance(raw, share)
        values = np.linalg.eigvalsh(raw)[::-1]
        held = np.cumsum(values) / max(values.sum(), 1e-300)
        k = min(int(np.searchsorted(held, share)) + 1, len(values))
        cond = lambda m: float(np.linalg.cond(m))
        return pd.DataFrame([(x["month"].iat[0], wide.shape[1], cond(raw), cond(clean), k, held[k - 1], list(wide.columns), raw.tobytes(), clean.tobytes())], columns=columns)

    def against(batches):
        for part in batches:
            for c in ("raw", "clean"):
                change = []
                for own, before, m, old in zip(part["names"], part["_names"], part[c], part[f"_{c}"]):
                    at = [] if before is None else [(i, list(before).index(x)) for i, x in enumerate(own) if x in set(before)]
                    if len(at) < 2:
                        change.append(np.nan)
                        continue
                    i, j = np.array(at).T
                    a, b = np.frombuffer(m).reshape(len(own), -1)[np.ix_(i, i)], np.frombuffer(old).reshape(len(before), -1)[np.ix_(j, j)]
                    change.append(float(np.linalg.norm(a - b) / (np.linalg.norm(b) + 1e-12)))
                part[f"{c}_change"] = change
            yield part[["month", "n", "raw_cond", "clean_cond", "k", "explained", "raw_change", "clean_change"]]

    rows = _histories(scored, daily, names, days).groupBy("month").applyInPandas(one, f"month date, n int, raw_cond double, clean_cond double, k int, explained double, names array<{kind}>, raw binary, clean binary")
    # one row a month
    order = Window.orderBy("month")
    rows = rows.withColumns({f"_{c}": F.lag(c).over(order) for c in ("names", "raw", "clean")})
    out = rows.mapInPandas(against, "month date, n int, raw_cond double, clean_cond double, k int, explained double, raw_change double, clean_change double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("raw_change", "clean_change")})


def daily_nav(weights: DataFrame, daily: DataFrame, drift: bool = True) -> DataFrame:
    """date, port_ret, nav, log_nav: a book's days from the weights (month, instrument, weight) of the month before.

    With drift, weights follow their returns within the month and are set anew at its start; else they are set anew every day. A
    name without a return on a day stands still. A month's weights meet that month's days alone (an equi-join by month and then by
    name and day); a name's growth within the month is a running product of its own rows. The chain of days is one row a date.
    """
    month = F.trunc("date", "month")
    held = weights.select(F.add_months("month", 1).alias("_m"), "instrument", "weight")
    days = daily.select("date").distinct().withColumn("_m", month)
    # as many rows as the book has names and days
    grid = days.join(held, "_m").join(daily.filter("r is not null").select("instrument", "date", "r"), ["instrument", "date"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    if not drift:
        ret = grid.groupBy("date").agg(F.sum(F.col("weight") * F.col("r")).alias("port_ret"))
    else:
        grown = F.product(1 + F.col("r")).over(Window.partitionBy("_m", "instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        level = grid.withColumn("_g", grown).groupBy("_m", "date").agg(F.sum(F.col("weight") * F.col("_g")).alias("_level"), F.sum("weight").alias("_whole"))
        before = F.coalesce(F.lag("_level").over(Window.partitionBy("_m").orderBy("date")), F.col("_whole"))
        ret = level.select("date", (F.col("_level") / before - 1).alias("port_ret"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ret.withColumns({"nav": F.product(1 + F.col("port_ret")).over(run), "log_nav": F.sum(F.log1p("port_ret")).over(run)})
