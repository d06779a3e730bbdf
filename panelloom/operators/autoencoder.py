"""An autoencoder whose gradients are made in tasks and added up by tree aggregation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: the unit that a round takes or leaves.
BLOCK = 256


@dataclass
class Coder:
    """Inputs -> hidden -> latent -> hidden -> inputs, with rectified hidden layers; inputs in units of their spread."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, hidden: int, latent: int, seed: int) -> Coder:
        rng, d = np.random.default_rng(seed), len(mean)
        sizes = [(d, hidden), (hidden, latent), (latent, hidden), (hidden, d)]
        return cls(mean, scale, [w for a, b in sizes for w in (rng.normal(size=(a, b)) * np.sqrt(2 / (a + b)), np.zeros(b))])

    def units(self, x: np.ndarray) -> np.ndarray:
        """Standard units; a missing value is the mean."""
        return np.nan_to_num((x - self.mean) / self.scale, nan=0.0, posinf=0.0, neginf=0.0)

    def layers(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, ab, b, bb, c, cb, d, db = self.weights
        first = np.maximum(u @ a + ab, 0)
        code = first @ b + bb
        second = np.maximum(code @ c + cb, 0)
        return first, code, second, second @ d + db

    def gradients(self, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Summed squared error of the reconstruction (in units, a mean over inputs) and its gradient by each weight."""
        u = self.units(x)
        _, _, b, _, c, _, d, _ = self.weights
        first, code, second, out = self.layers(u)
        off = (out - u) * (2 / u.shape[1])
        back2 = (off @ d.T) * (second > 0)
        mid = back2 @ c.T
        back1 = (mid @ b.T) * (first > 0)
        pairs = ((u, back1), (first, mid), (code, back2), (second, off))
        return float(((out - u) ** 2).mean(axis=1).sum()), [g for x, y in pairs for g in (x.T @ y, y.sum(axis=0))]


def _blocks(rows: DataFrame, column: str, width: int) -> RDD:
    """Rows in blocks of BLOCK as matrices, in a random order: dealt by a hash of the row, so a block has rows of all dates."""
    parts = rows.sparkSession.sparkContext.defaultParallelism

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array([np.asarray(v, float) for v in part["x"]]) if len(part) else np.empty((0, width))
            yield pd.DataFrame({"block": [x[i : i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]})

    good = rows.filter(F.size(column) == width).select(F.transform(column, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"))
    dealt = good.repartition(max(parts, rows.rdd.getNumPartitions()), F.xxhash64("x"))
    return dealt.mapInPandas(packed, "block binary").rdd.map(lambda r: np.frombuffer(r["block"]).reshape(-1, width))


def _sums(parts: RDD, seq, zero):
    add = lambda a, b: b if a is None else a if b is None else tuple(x + y if not isinstance(x, list) else [p + q for p, q in zip(x, y)] for x, y in zip(a, b))
    return parts.treeAggregate(zero, lambda s, x: add(s, seq(x)), add)


def fit_autoencoder(rows: DataFrame, column: str, latent: int = 12, hidden: int = 128, rounds: int = 200, batch_rows: int = 4096, rate: float = 3e-3, seed: int = 42) -> Coder | None:
    """Learn to rebuild a column of arrays of one width from `latent` numbers; None if there are no rows.

    Rows are packed into blocks once and kept by the executors (lost ones are made anew). A round takes each block with a chance that
    gives about batch_rows rows, whatever their number; tasks make and add the gradients of their blocks, and these are added in
    a tree, so the driver gets one gradient, as large as the weights, and takes a step. Arrays of another width than the most
    frequent are left out; missing elements count as their mean.
    """
    widths = rows.filter(F.size(column) > 0).groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return None
    width, sc = widths["w"], rows.sparkSession.sparkContext
    blocks = _blocks(rows, column, width).persist(StorageLevel.MEMORY_AND_DISK)

    def moments(x):
        has = np.isfinite(x)
        v = np.where(has, x, 0)
        return len(x), has.sum(axis=0), v.sum(axis=0), (v * v).sum(axis=0)

    n, has, s, ss = _sums(blocks, moments, None)
    mean = s / np.maximum(has, 1)
    spread = np.sqrt(np.maximum(ss / np.maximum(has, 1) - mean * mean, 0))
    coder = Coder.fresh(mean, np.where(spread > 1e-12, spread, 1), hidden, latent, seed)
    share = min(1.0, batch_rows / n)
    first, second = [np.zeros_like(w) for w in coder.weights], [np.zeros_like(w) for w in coder.weights]
    for k in range(1, rounds + 1):
        sent = sc.broadcast(coder)

        def one(x, k=k, sent=sent):
            if share < 1 and zlib.crc32(x[:1].tobytes(), k * 7919 + seed) >= share * 2**32:
                return None
            loss, grads = sent.value.gradients(x)
            return len(x), loss, grads

        found = _sums(blocks, one, None)
        sent.unpersist()
        if found is None:
            continue
        count, _, grads = found
        step = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
        for w, g, m, v in zip(coder.weights, grads, first, second):
            g = g / count
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    blocks.unpersist()
    return coder


def encode(rows: DataFrame, column: str, coder: Coder, keys: list[str], prefix: str = "cand_ae_latent_") -> DataFrame:
    """keys, the latent numbers and error, the mean squared error of the rebuilt inputs in units of their spread; other widths get none."""
    latent, width = coder.weights[2].shape[1], len(coder.mean)
    names = [f"{prefix}{i}" for i in range(latent)]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array([np.asarray(v, float) for v in part["_x"]]).reshape(-1, width)
            u = coder.units(x)
            _, code, _, out = coder.layers(u)
            yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(code, columns=names), pd.DataFrame({"error": ((out - u) ** 2).mean(axis=1)})], axis=1)

    good = rows.filter(F.size(column) == width).select(*keys, F.transform(column, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("_x"))
    return good.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} double" for c in names], "error double"]))


def windows(daily: DataFrame, columns: list[str], n: int) -> DataFrame:
    """daily with x: the last n rows of each column, one after the other; null where there are fewer. One exchange, as for any frame."""
    from panelloom.functions.frames import last_rows

    parts = [F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))).over(last_rows(n)) for c in columns]
    return daily.withColumn("x", F.concat(*parts)).withColumn("x", F.when(F.size("x") == n * len(columns), F.col("x")))
