import numpy as np
import pytest

from panelloom.llm import neighbours
from panelloom.llm.neighbours import Query, _unit, encode, fit_cells, nearest, reach, rotation

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, every, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    sizes = [len(v) for _, v in good]
    dim = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    good = [(i, v) for i, v in good if len(v) == dim]
    return {i: sorted((-float(v @ q), j) for j, v in good if j != i)[:k] for i, q in good if i % every == 0}


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else list(v), None, 0.0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("dim", [64, 20, 130])
def test_recall(spark, monkeypatch, dim):
    monkeypatch.setattr(neighbours, "CANDIDATES", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(20, dim))
    rows = [(i, (centres[i % 20] + rng.normal(size=dim) * 0.7).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(50)]  # exact copies: ties
    got: dict[int, list] = {}
    for r in nearest(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    hit = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        hit += len({j for _, j in best} & {j for _, j, _ in mine})
    assert hit / (20 * len(want)) >= 0.99


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 64)) * rng.uniform(0.1, 5, (5000, 1))
    inside = 0
    for q in rng.normal(size=(20, 64)):
        low, high = Query(q).bounds(*encode(x))
        inside += ((low <= x @ q) & (x @ q <= high)).mean() / 20
    assert inside > 0.995
    assert np.allclose(rotation(64) @ rotation(64).T, np.eye(64))


def test_cells_bound_their_rows_and_clusters_are_skipped():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(16, 64))
    x = (middle[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 64)) * 0.1) * rng.uniform(0.5, 2, (4000, 1))
    centres = fit_cells(x[:1000], 16)
    unit, norm = _unit(x)
    cosine = unit @ centres.T
    own = cosine.argmax(axis=1)
    held = [np.flatnonzero(own == c) for c in range(len(centres))]
    held = [h if len(h) else np.array([0]) for h in held]
    cells = np.array([[cosine[h, c].min(), norm[h].min(), norm[h].max(), len(h)] for c, h in enumerate(held)])
    q = x[::40]
    bound, exact = reach(q, centres, cells), q @ x.T
    for c in np.unique(own):
        assert (exact[:, own == c] <= bound[:, [c]]).all()
    floor = np.sort(exact, axis=1)[:, -21]
    assert (bound >= floor[:, None]).mean() < 0.5  # most cells can't hold a neighbour


def test_repeated_rows_count_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 8)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    got = lambda rows: sorted(map(tuple, nearest(table(spark, rows), k=5).collect()))
    assert got(rows + rows[:30] * 4) == got(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [3.0, -1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (8, [5.0, 5.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table(spark, rows)).collect())
    assert got == [(0, 1, 8, 15.0), (0, 2, 1, 5.0), (0, 3, 20, 1.0), (20, 1, 8, 10.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert nearest(table(spark, rows).limit(0)).count() == 0


def test_sizes_out_of_range_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    rows += [(1001 + i, (rng.normal(size=64) * 10.0 ** rng.choice([-200, 200, 300])).tolist()) for i in range(25)]
    wide = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in nearest(wide).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    with np.errstate(over="ignore"):
        want = brute(rows, 20, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len(got[q] & {j for _, j in best}) for q, best in want.items()) / (20 * len(want)) >= 0.99


def test_oracle_is_the_exact_search(spark, monkeypatch):
    import duckdb
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "CELL_ROWS", 30)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300, rows[40][1]), (301, rows[40][1]), (40, rows[40][1]), (320, None), (340, [0.0] * 16), (360, [float("nan")] * 16), (380, [1.0, None]), (None, rows[1][1])]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    want = sorted(con.execute(neighbours.oracle()).fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table(spark, rows)).collect())
    assert got == want  # scores to the last bit: both add component after component
