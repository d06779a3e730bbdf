"""Hard negatives: rows of other labels just below a positive, found by cover trees over norm-augmented vectors."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block of candidates and of anchors: a task searches one block's tree for another block's anchors.
CANDIDATES, ANCHORS = 8192, 4096
#: Points of a node that is not divided any more.
LEAF = 16
#: Points whose distances to a node's other points are made at once.
SIDE_BY_SIDE = 256
#: Share of a bound's size that rounding may take (a distance near zero has half the digits): bounds are wider by it.
SLACK = 1e-5
#: Children of a node that are put in order at first.
AHEAD = 64


class CoverTree:
    """A cover tree over vectors x, each with a component more that makes all as long as the longest.

    So the distance to a query (whose added component is 0) falls as the inner product grows: d**2 = |q|**2 + M**2 - 2 q.x.
    Below a node of covering radius r are centres more than r/2 apart that cover its points within r/2, the node's own centre
    first; a node of LEAF points or fewer, or of equal points, is a leaf. Nodes keep the largest distance to their points,
    which is at most r. Children and the points below a node stand together, level after level.
    """

    def __init__(self, x: np.ndarray):
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max())
        if not np.isfinite(self.top):
            raise ArithmeticError("a vector's squared length does not fit into a double")
        whole = np.column_stack([x, np.sqrt(np.maximum(self.top - norms, 0))])
        self.order = np.arange(len(x))
        centre, radius, first, last, child, childs = [0], [], [0], [len(x)], [], []
        far = [np.sqrt(self._apart(whole[:1], whole)[0])]
        cover = [float(far[0].max())]
        k = 0
        while k < len(centre):
            i, j, d = first[k], last[k], far[k]
            far[k] = None
            radius.append(float(d.max()))
            child.append(len(centre))
            if j - i > LEAF and radius[k] > 0:
                r, place = min(cover[k], radius[k]) / 2, i
                for c, points, own in self._covers(whole, self.order[i:j].copy(), int(d.argmin()), r):
                    self.order[place : place + len(points)] = points
                    centre.append(int(c))
                    first.append(place)
                    place += len(points)
                    last.append(place)
                    far.append(own)
                    cover.append(r)
            childs.append(len(centre))
            k += 1
        self.centres = x[centre]
        self.radius, self.first, self.last = np.array(radius), np.array(first), np.array(last)
        self.child, self.childs = np.array(child), np.array(childs)
        self.leaf = self.child == self.childs

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of augmented vectors; what rounding leaves of none is none."""
        d = 2 * (self.top - a @ b.T)
        return np.where(d <= 1e-12 * self.top, 0, d)

    def _covers(self, whole: np.ndarray, at: np.ndarray, own: int, r: float):
        """(centre, points, distances) of centres over r apart that cover the points `at` within r: the node's own, then the first not covered yet."""
        rows, left = whole[at], np.ones(len(at), bool)
        todo = np.concatenate(([own], np.delete(np.arange(len(at)), own)))
        while len(todo):
            some = todo[:SIDE_BY_SIDE]
            apart = self._apart(rows[some], rows)
            for c, d in zip(some, apart):
                if left[c]:
                    near = left & (d <= r * r)
                    near[c] = True
                    left &= ~near
                    yield at[c], at[near], np.sqrt(d[near])
            todo = todo[left[todo]]

    def bounds(self, q: np.ndarray, size: float, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of q, of squared length `size`, with any point below the nodes from a to b."""
        inner, both = self.centres[a:b] @ q, size + self.top
        d, r = np.sqrt(np.maximum(both - 2 * inner, 0)), self.radius[a:b]
        low, high = (both - (d + r) ** 2) / 2, (both - np.maximum(d - r, 0) ** 2) / 2
        off = SLACK * (both + 1)
        return low - off, high + off


class Block:
    """Candidates of a task: vec_id, label and whole-numbered vectors, under a cover tree in whose order they stand."""

    def __init__(self, rows: pd.DataFrame, dim: int):
        x = _vectors(rows["vector"], dim)
        self.tree = CoverTree(x)
        at = self.tree.order
        self.x, self.ids, self.labels = x[at], rows["vec_id"].to_numpy()[at], rows["label"].to_numpy()[at]
        self.reach = float(np.abs(x).max(initial=0))

    def scores(self, q: np.ndarray, i: int, j: int) -> np.ndarray:
        """Exact inner products: in double precision where every partial sum is a whole number below 2**53, else in whole numbers."""
        most = self.reach * float(np.abs(q).sum())
        if most < 2.0**53:
            return (self.x[i:j] @ q).astype(np.int64)
        own = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.x[i:j]]
        if any(abs(s) >= 1 << 63 for s in own):
            raise ArithmeticError("an inner product does not fit into a long")
        return np.array(own, np.int64)

    def best(self, q: np.ndarray, k: int, wanted, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """The k wanted rows of largest score from low to high, as (-score, vec_id), best first; ties by vec_id.

        Nodes are taken by falling upper bounds; those that lie outside the window, or can't reach the k-th best found, are
        skipped with all below them. wanted tells which of the rows from i to j count. Rows of a leaf are verified exactly.
        """
        tree, size = self.tree, float(q @ q)
        found: list[tuple[int, int]] = []
        least = -np.inf if low is None else float(low)
        most = np.inf if high is None else float(high)

        # the nodes of a run fall by upper bound; the heap has the next node of each run
        heap: list[tuple[float, int]] = []
        runs: list[list[np.ndarray]] = []

        def worth(a: int, b: int) -> None:
            below, above = tree.bounds(q, size, a, b)
            at = np.flatnonzero((above >= max(least, -found[k - 1][0] if len(found) >= k else -np.inf)) & (below <= most))
            if len(at):
                runs.append([at + a, np.minimum(above[at], most)])
                onward(len(runs) - 1)

        def onward(run: int) -> None:
            """Put the first AHEAD of what is left of a run in order, the largest last, and its next node on the heap."""
            if len(runs[run]) == 2:
                nodes, above = runs[run]
                cut = max(len(nodes) - AHEAD, 0)
                part = np.argpartition(above, cut) if cut else np.arange(len(nodes))
                ahead = part[cut:][np.argsort(above[part[cut:]], kind="stable")]
                runs[run] = [nodes[part[:cut]], above[part[:cut]], nodes[ahead].tolist(), above[ahead].tolist()]
            heappush(heap, (-runs[run][3][-1], run))

        worth(0, 1)
        while heap:
            above, run = heappop(heap)
            if len(found) >= k and -above < -found[k - 1][0]:
                break
            n = runs[run][2].pop()
            runs[run][3].pop()
            if runs[run][2]:
                onward(run)
            elif len(runs[run][0]):
                runs[run] = runs[run][:2]
                onward(run)
            if not tree.leaf[n]:
                worth(tree.child[n], tree.childs[n])
                continue
            i, j = tree.first[n], tree.last[n]
            s = self.scores(q, i, j)
            good = wanted(i, j)
            if low is not None:
                good = good & (s >= low)
            if high is not None:
                good = good & (s <= high)
            at = np.flatnonzero(good)
            if len(at) > k:
                at = at[np.lexsort((self.ids[i:j][at], -s[at]))[:k]]
            found = sorted(found + [(-int(s[m]), int(self.ids[i + m])) for m in at])[:k]
        return found


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of doubles, shorter ones with zeros after their end."""
    out = np.zeros((len(column), dim))
    for i, b in enumerate(column):
        v = np.frombuffer(b, np.float64)
        out[i, : len(v)] = v
    return out


def _longest(*columns: pd.Series) -> int:
    return max([1, *(len(b) // 8 for c in columns for b in c)])


def _positives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            dim = _longest(anchors["vector"], rows["vector"])
            block = Block(rows, dim)
            for key, own, label, q in zip(anchors["akey"], anchors["vec_id"], anchors["label"], _vectors(anchors["vector"], dim)):
                wanted = lambda i, j: (block.labels[i:j] == label) & (block.ids[i:j] != own)  # noqa: B023, E731
                out += [(key, own, i, -s) for s, i in block.best(q, k, wanted)]
        return pd.DataFrame(out, columns=["akey", "anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, least: int, most: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            dim = _longest(anchors["vector"], rows["vector"])
            block = Block(rows, dim)
            for key, own, label, q, found in zip(anchors["akey"], anchors["vec_id"], anchors["label"], _vectors(anchors["vector"], dim), anchors["positives"]):
                wanted = lambda i, j: block.labels[i:j] != label  # noqa: B023, E731
                known: dict[int, list] = {}
                for p in found:
                    score = int(p["positive_score"])
                    low, high = -(-least * score // 100), most * score // 100
                    if low <= high and score not in known:
                        known[score] = block.best(q, k, wanted, low, high)
                    out += [(key, own, int(p["positive_id"]), score, i, -s) for s, i in known.get(score, ())]
        return pd.DataFrame(out, columns=["akey", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def whole_vectors(vectors: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and vector (bytes of doubles, each floor(scale * x)) of the rows that take part.

    A null label, id or vector, or a null or non-finite component, keeps a row out. Where relabel_every divides vec_id, the label
    becomes the next one of `labels`. Equal rows are one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(F.forall("x", finite))
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "x").dropDuplicates(["vec_id", "label", "x"])

    def packed(batches):
        for part in batches:
            yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "vector": [np.floor(scale * np.asarray(v, np.float64)).tobytes() for v in part["x"]]})

    return rows.mapInPandas(packed, "vec_id long, label long, vector binary")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives, the first rows of other labels with a score near below the positive's.

    Anchors are the rows whose vec_id `every` divides; scores are whole-numbered inner products with the anchor of what
    `whole_vectors` gives; higher scores come first, ties by smaller vec_id. Positives are the first `positives` other rows of the
    anchor's label, negatives the first `negatives` of other labels with least * positive_score <= 100 * negative_score <= most *
    positive_score: none below a positive of negative score. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Rows and anchors are dealt to blocks by hash, and each pair of blocks is a task, which builds the cover tree of its
    candidates and searches it for each anchor: once for positives, and when these are known over all blocks, for each
    positive's window. A task brings back that many rows an anchor or positive at most, and these are ranked by anchor, so neither
    a label nor a vector shared by many rows gathers them. Nothing is approximate.

    A row of the anchor's own vec_id is no positive of it; a vec_id with several labels or vectors is as many anchors. Shorter
    vectors count as zeros beyond their end. An empty table gives no rows, and other columns are ignored. A score beyond a long,
    or a squared length beyond a double, is an error.
    """
    rows = materialize(whole_vectors(vectors, scale).withColumn("akey", F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b":"), "vector"))), "whole-vectors")
    told = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("a")).first()
    blocks, anchor_blocks = max(1, -(-told["n"] // CANDIDATES)), max(1, -(-told["a"] // ANCHORS))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "akey"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "label", "vector", spread(blocks).alias("c")).withColumn("a", each(anchor_blocks)).groupBy("a", "c")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    in_blocks = lambda df: df.withColumn("a", spread(anchor_blocks)).withColumn("c", each(blocks)).groupBy("a", "c")
    own = ["anchor_id", "akey"]

    found = in_blocks(anchors).cogroup(candidates).applyInPandas(_positives(positives), "akey string, anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("place", place).filter(F.col("place") <= positives)
    found = found.groupBy(*own).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = materialize(anchors.join(found.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "akey"]), "positives")

    schema = "akey string, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = in_blocks(found).cogroup(candidates).applyInPandas(_negatives(negatives, least, most), schema)
    # positives that repeat a vec_id stay apart by their score
    rank = F.row_number().over(Window.partitionBy(*own, "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    met = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The same by comparing every anchor with every row."""
    return """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
m as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank, negative_id, positive_score, negative_score
from m qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 3"""
