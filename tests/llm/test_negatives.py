import numpy as np
import pytest

from panelloom.llm import negatives
from panelloom.llm.negatives import CoverTree, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, akey string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


def brute(rows):
    good = {(i, label, tuple(v)) for i, v, label in rows if None not in (i, v, label) and None not in v and np.isfinite(v).all()}
    good = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for i, label, v in good]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a, label, q in good:
        if a % 50 == 0:
            scored = sorted((-dot(q, v), i, other) for i, other, v in good)
            for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
                found = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("dim", [3, 24])
def test_against_all_pairs(spark, monkeypatch, dim):
    monkeypatch.setattr(negatives, "CANDIDATES", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(8, dim))
    rows = [(i, (rng.uniform(0.2, 2) * (centres[i % 8] + rng.normal(size=dim) * 0.5)).tolist(), int(rng.integers(0, 10))) for i in range(700)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(200)]  # one vector of many rows: ties
    rows += rows[:20]
    want = brute(rows)
    assert len(want) > 100 and got(hard_negatives(table(spark, rows))) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 3), (100, [1.0, 2.0], 4), (1, [1.0, 2.0], 4), (2, None, 4), (3, [None, 1.0], 4), (4, [float("nan"), 1.0], 4), (5, [float("inf"), 1.0], 4), (6, [1.0, 1.0], None)]
    rows += [(8, [0.5, 1.0, 7.0], 5), (9, [0.7], 6), (10, [], 4), (None, [1.0, 1.9], 4), (11, [0.9, 1.9], 2), (12, [-1.0, -2.0], 4), (50, [-1e4, 1e6], 4), (13, [1.0, -1e6], 4)]
    want = brute([x for x in rows if x[0] is not None])
    assert want and got(hard_negatives(table(spark, rows))) == want
    assert hard_negatives(table(spark, rows).limit(0)).count() == 0
    # products past 2**53 are whole numbers still, and past a long an error
    large = [(50, [1e6 + 1 / 256, 3e5], 1), (51, [1e6, 3e5 - 5 / 256], 1), (52, [6e5 + 3 / 256, 1e5], 2), (53, [7e5, 1e5 + 1 / 256], 3)]
    assert got(hard_negatives(table(spark, large))) == brute(large) != []
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives(table(spark, [(50, [1e9], 1), (51, [1e9], 1)])).collect()


def test_tree_bounds_and_cover():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(900, 6)) * rng.uniform(0.1, 3, (900, 1)))
    x[300:500] = x[7]
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(900))
    for q in np.floor(256 * rng.normal(size=(5, 6))):
        low, high = tree.bounds(q, float(q @ q), 0, len(tree.radius))
        for n in range(len(tree.radius)):
            inner = x[tree.order[tree.first[n] : tree.last[n]]] @ q
            assert low[n] <= inner.min() and inner.max() <= high[n]
            a, b = tree.child[n], tree.childs[n]
            if a < b:
                assert sum(tree.last[a:b] - tree.first[a:b]) == tree.last[n] - tree.first[n]
                assert (tree.radius[a:b] <= tree.radius[n] / 2 + 1e-6).all()


def test_nodes_are_skipped(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.05))
    import pandas as pd

    block = negatives.Block(pd.DataFrame({"vec_id": np.arange(3000), "label": 0, "vector": [v.tobytes() for v in x]}), 8)
    seen = []
    monkeypatch.setattr(negatives.Block, "scores", lambda self, q, i, j, f=negatives.Block.scores: seen.append(j - i) or f(self, q, i, j))
    best = block.best(x[5], 4, lambda i, j: np.ones(j - i, bool))
    assert best == sorted((-int(s), i) for i, s in enumerate(x @ x[5]))[:4]
    assert sum(seen) < 600
