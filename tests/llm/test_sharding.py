import random
import zlib

from panelloom.llm import sharding
from panelloom.llm.sharding import shard_by_bytes, sort_keys, splitters

SCHEMA = "doc_id long, text string, size long, shard string"


def corpus(seed, n=600):
    rng = random.Random(seed)
    hot = "hot " * 50
    rows = [(i, rng.choice([hot, hot, "x" * rng.randrange(400), f"text {i} " * rng.randrange(60)]) if rng.random() < 0.9 else None) for i in range(n)]
    return rows + [(None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (9999, "é" * 3000)]


def check(rows, out, shards):
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in out)
    for s in range(shards):
        mine = sorted(r.slot for r in out if r.shard == s)
        assert mine == list(range(len(mine)))
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(shards)]
    largest, mean = max(r.size for r in out), sum(sizes) / shards
    assert max(abs(x - mean) for x in sizes) <= largest + 0.05 * mean
    # equal texts stand in one run of shards: only those at its ends hold others
    for crc in {r.text_crc32 for r in out}:
        held = sorted({r.shard for r in out if r.text_crc32 == crc})
        assert held == list(range(held[0], held[-1] + 1))


def test_sizes_slots_and_groups(spark):
    for seed, shards in ((1, 24), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, -1, "clash") for d, t in rows], SCHEMA).repartition(3)
        check(rows, shard_by_bytes(df, shards).collect(), shards)


def test_one_text_and_one_row_repeated_are_still_cut(spark):
    rows = [(i, "same text") for i in range(400)]
    check(rows, shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 8)
    rows = [(7, "same row")] * 400
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert max(sum(r.shard == s for r in out) for s in range(4)) < 200


def test_groups_stay_whole_where_their_edge_is_near(spark):
    # 4,000 groups of 10 equal texts: each is far below a fiftieth of a shard, so none is cut
    rows = [(i, f"group {i % 4000}") for i in range(40_000)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6, piece_rows=700).collect()
    check_slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(6)}
    assert all(x == list(range(len(x))) for x in check_slots.values())
    held: dict[int, set] = {}
    for r in out:
        held.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in held.values())
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(6)]
    assert max(sizes) <= 1.05 * min(sizes)


def test_splitters_meet_the_tolerance(spark):
    keys = sort_keys(spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")).cache()
    rows = sorted((r.k1, r.k2, r.size) for r in keys.collect())
    total = sum(r[2] for r in rows)
    cuts = splitters(keys, 10, 30)
    assert len(cuts) == 9
    for i, cut in enumerate(cuts, 1):
        below = sum(s for a, b, s in rows if (a, b) < cut)
        assert abs(below - total * i / 10) <= 30


def test_few_rows_and_none(spark):
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = shard_by_bytes(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].slot == 0 and one[0].size == 8


def test_edges():
    assert sharding._edge(0, 0, 0, 0) == (-(1 << 63), -(1 << 63))
    assert sharding._edge(0, 0, 0, 1 << sharding.FIRST_BITS) is None
