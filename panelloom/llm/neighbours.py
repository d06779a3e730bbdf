"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a rotated query's components, and standard deviations of the error bounds of codes and of query rounding.
QUERY_BITS, CODE_SIGMAS, ROUND_SIGMAS = 4, 3.0, 3.0
#: Rows of a block of candidates and of queries: a task compares one of each.
CANDIDATES, QUERIES = 8192, 16384
#: Cells of directions: one for so many rows, but at most so many; a cell's centre is fitted on so many sampled rows. Larger cells have more blocks.
CELL_ROWS, MOST_CELLS, SAMPLED = 8192, 1024, 32
#: Cells that a query searches first, for the score that other cells must be able to reach, and the slack of angles in radians.
FIRST, SLACK = 2, 1e-6


@cache
def rotation(dim: int, seed: int = 6) -> np.ndarray:
    """A random rotation of vectors padded with zeros to a multiple of 64 components."""
    padded = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(padded, padded)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one and the lengths; squares neither overflow nor vanish, as the largest component is taken out first."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return x / length, (largest * length)[:, 0]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (n, words), correction factors and norms of vectors x (n, dim).

    The factor is the inner product of a rotated unit vector with its code, a vector of +-1/sqrt(D).
    """
    unit, norm = _unit(x)
    z = unit @ rotation(x.shape[1]).T
    code = np.packbits(z > 0, axis=1, bitorder="little").view(np.uint64)
    return code, np.abs(z).sum(axis=1) / np.sqrt(z.shape[1]), norm


class Query:
    """A query of length one, rotated and rounded to QUERY_BITS a component, as one bit plane for each bit, and its norm."""

    def __init__(self, q: np.ndarray):
        unit, norm = _unit(q[None, :])
        v = rotation(len(q)) @ unit[0]
        self.dim, self.norm = len(v), float(norm[0])
        self.low = float(v.min())
        self.step = float(v.max() - self.low) / ((1 << QUERY_BITS) - 1) or 1.0
        level = np.rint((v - self.low) / self.step).astype(np.uint8)
        rounded = self.low + self.step * level
        self.total = float(rounded.sum())
        self.rounding = ROUND_SIGMAS * float(np.linalg.norm(v - rounded)) / np.sqrt(self.dim)
        self.planes = [np.packbits(level >> b & 1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)]

    def bounds(self, code: np.ndarray, factor: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products with the coded vectors, from their bits, factors and norms.

        Where a product of norms is out of range the bounds are infinite, so such a vector is always reranked.
        """
        count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        with_bit = sum((1 << b) * count(code & plane) for b, plane in enumerate(self.planes))
        signed = 2 * (self.step * with_bit + self.low * count(code)) - self.total
        estimate = signed / np.sqrt(self.dim) / factor
        off = np.sqrt(np.maximum(1 / factor**2 - 1, 0)) * CODE_SIGMAS / np.sqrt(max(self.dim - 1, 1)) + self.rounding / factor
        with np.errstate(over="ignore", invalid="ignore"):
            size = norm * self.norm
            low, high = size * (estimate - off), size * (estimate + off)
        usable = np.isfinite(low) & np.isfinite(high) & (size > np.finfo(float).tiny)
        return np.where(usable, low, -np.inf), np.where(usable, high, np.inf)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """Directions (cells, dim) of length one around which the rows of x lie, by k-means on the sphere."""
    x, rng = _unit(x)[0], np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        # a cell without rows, or whose rows cancel, stays where it was
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    return centres


def _codes(centres: np.ndarray):
    """Rows of the index: the vector's bytes, its code with factor and norm, its cell and the cosine to that cell's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch)
                code, factor, norm = encode(x)
                cosine = _unit(x)[0] @ centres.T
                cell = cosine.argmax(axis=1)
                columns = {
                    "vec_id": batch.column("vec_id"), "vector": pa.array([r.tobytes() for r in x]), "code": pa.array([r.tobytes() for r in code]), "factor": pa.array(factor), "norm": pa.array(norm),
                    "cell": pa.array(cell.astype(np.int32)), "cosine": pa.array(cosine[np.arange(len(x)), cell]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def reach(q: np.ndarray, centres: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Upper bounds (queries, cells) of the inner products of queries with any row of a cell.

    cells has each cell's least cosine to its centre, least and largest norm. A row is at most the cell's widest angle from
    the centre, so the angle between query and row is at least what is left of that between query and centre.
    """
    unit, norm = _unit(q)
    apart = np.arccos(np.clip(unit @ centres.T, -1, 1)) - np.arccos(np.clip(cells[:, 0], -1, 1)) - SLACK
    best = np.cos(np.maximum(apart, 0))
    with np.errstate(over="ignore", invalid="ignore"):
        bound = norm[:, None] * np.where(best > 0, cells[:, 2], cells[:, 1]) * best
        bound += np.abs(bound) * 1e-9
    return np.where(np.isnan(bound), np.inf, bound)


def _routes(centres: np.ndarray, cells: np.ndarray, first: bool):
    """Rows of queries for each cell that they search: the FIRST with the highest bounds, or else those others that reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bound = reach(_matrix(batch.column("vector").to_pylist(), np.float64), centres, cells)
                order = np.argsort(-bound, axis=1, kind="stable")
                wanted = np.zeros(bound.shape, bool)
                np.put_along_axis(wanted, order[:, :FIRST], True, axis=1)
                floor = np.array(batch.column("floor").to_pylist(), np.float64)
                if not first:
                    wanted = ~wanted & (bound >= floor[:, None])
                row, cell = np.nonzero(wanted & (cells[:, 3] > 0))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("vec_id", "vector", "floor")), pa.array(cell.astype(np.int32))], ["vec_id", "vector", "floor", "cell"])

    return run


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _search(k: int):
    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(found):
            # rows of one vec_id and vector are in one block, and count once
            queries, found = (t.drop_duplicates(["vec_id", "vector"]) if t["vec_id"].duplicated().any() else t for t in (queries, found))
            ids, x = found["vec_id"].to_numpy(), _matrix(found["vector"], np.float64)
            code, factor, norm = _matrix(found["code"], np.uint64), found["factor"].to_numpy(), found["norm"].to_numpy()
            for query_id, floor, q in zip(queries["vec_id"], queries["floor"], _matrix(queries["vector"], np.float64)):
                low, high = Query(q).bounds(code, factor, norm)
                other = ids != query_id
                low = np.where(other, low, -np.inf)
                # the k-th best lower bound, and the k-th best score so far: what can't reach them is not among the best k
                least = max(np.partition(low, -k)[-k] if len(low) > k else -np.inf, floor)
                at = np.flatnonzero((high >= least) & other)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.add.accumulate(x[at] * q, axis=1)[:, -1]  # component after component, as SQL adds
                best = np.lexsort((ids[at], -score))[:k]  # no number: last
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[at[best]].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})

    return run


def good_vectors(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and vector of the rows that take part, their number, and their number of components.

    Vectors take part if they are not null, not zero, hold no null or non-finite component and have the most frequent
    number of components (ties: the smaller), and have an id.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    x = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    good = good.filter(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (64, 0)
    return good.filter(F.size("vector") == dim), n, dim


def index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The written index of all vectors that take part (see `good_vectors`) and its cells' centres.

    The centres are fitted on a sample of SAMPLED rows a cell, at most 32,768, those with the least hashes of vec_id; every
    row is in the index, in the cell whose centre has the largest cosine with it.
    """
    good, n, dim = good_vectors(vectors)
    cells = min(MOST_CELLS, max(1, n // CELL_ROWS))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(cells * SAMPLED).select("vector").toPandas() if n else ()
    centres = fit_cells(np.stack(sample["vector"]).astype(np.float64), cells) if n else np.eye(1, dim)
    coded = good.mapInArrow(_codes(centres), "vec_id long, vector binary, code binary, factor double, norm double, cell int, cosine double")
    return materialize(coded, "index"), centres


def _meet(queries: DataFrame, coded: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best k rows of each block of a cell for each query that searches the cell.

    blocks has the cells' numbers of blocks of candidates; a cell's queries are dealt to blocks too, and each pair of
    blocks is a task, so neither a large cell nor one that all queries search is met whole.
    """
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    searched = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
    # a row a cell, of which there are MOST_CELLS at most
    sizes = F.broadcast(materialize(searched.join(F.broadcast(blocks), "cell"), "cells"))
    left = queries.join(sizes, "cell").withColumn("q", spread("qs")).withColumn("c", each("cs")).select("cell", "q", "c", "vec_id", "vector", "floor")
    right = coded.join(sizes, "cell").withColumn("c", spread("cs")).withColumn("q", each("qs")).select("cell", "q", "c", "vec_id", "vector", "code", "factor", "norm")
    pairs = left.groupBy("cell", "q", "c").cogroup(right.groupBy("cell", "q", "c"))
    return pairs.applyInPandas(_search(k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    number = F.when(~F.isnan("score"), F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(number.desc_nulls_last(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _floor(k: int) -> Column:
    """The k-th best score, if there are k and all are numbers; else minus infinity, which lets everything in."""
    known = F.count(F.when(~F.isnan("score"), 1)) == k
    return F.when(known, F.min("score")).otherwise(F.lit(float("-inf")))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k rows with the largest inner products with each query, the rows whose vec_id is divisible by `every`.

    Every row is in the index, in the cell of its direction. A query first searches the FIRST cells whose rows may have the
    largest inner products; its k-th best score there is the floor for the rest: it searches just those other cells
    whose angle and norms allow a product that reaches the floor. So cells are skipped only where no row of theirs can be among
    the k best; where vectors have no clusters, few can be skipped, and all rows are compared. Rows and queries of a cell
    are dealt to blocks by hash, and each pair of blocks is a task: it bounds all inner products from one-bit codes, keeps the
    candidates whose upper bound reaches the floor and the k-th best lower bound, and reranks those by the original vectors
    in double precision. The bounds are of CODE_SIGMAS standard deviations, so a neighbour is missed with small
    probability. Each pair of blocks brings k rows a query on.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and scores that are no number (infinities
    that cancel) come last. Vectors of any finite size take part: where bounds overflow, a candidate is reranked. A row is no neighbour of a query
    with its own vec_id; if a vec_id repeats as a query, each of its vectors counts once among that query's rows, and rows that
    repeat vec_id and vector count once. See `good_vectors` for what takes part; an empty table gives no rows, and other
    columns are ignored.
    """
    coded, centres = index(vectors)
    told = coded.groupBy("cell").agg(F.min("cosine").alias("cosine"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
    told = materialize(told.withColumn("cs", F.ceil(F.col("n") / CANDIDATES).cast("int")), "blocks")
    cells = np.zeros((len(centres), 4))
    for r in told.collect():  # MOST_CELLS rows at most
        cells[r["cell"]] = r["cosine"], r["low"], r["high"], r["n"]
    blocks, schema = told.select("cell", "cs"), "vec_id long, vector binary, floor double, cell int"

    asked = coded.filter(F.col("vec_id") % every == 0).select("vec_id", "vector")
    start = asked.withColumn("floor", F.lit(float("-inf"))).mapInArrow(_routes(centres, cells, True), schema)
    found = materialize(_best(_meet(materialize(start, "first-cells"), coded, blocks, k), k), "first-found")
    if len(centres) <= FIRST:
        return found.select("query_id", "rank", "vec_id", "score")
    floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(_floor(k).alias("floor"))
    # a query whose first cells hold no other row has no floor yet
    floored = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = materialize(floored.mapInArrow(_routes(centres, cells, False), schema), "other-cells")
    more = _meet(rest, coded, blocks, k)
    both = found.drop("rank").unionByName(more).dropDuplicates(["query_id", "vec_id", "score"])
    return _best(both, k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 20, k: int = 20) -> str:
    """DuckDB SQL of the exact neighbours; the approximate search finds the same rows, but for what its bounds miss."""
    return f"""
with v as (select vec_id::bigint as vec_id, embedding::double[] as x from embeddings where vec_id is not null and len(embedding) > 0),
g as (select * from v where len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
d as (select distinct * from g where len(x) = (select len(x) from g group by len(x) order by count(*) desc, len(x) limit 1)),
p as (select distinct a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.x, b.x) as score from d a join d b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by case when not isnan(score) then score end desc nulls last, vec_id) as rank from p) where rank <= {k}"""
