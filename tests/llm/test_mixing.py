import random
import time
from collections import Counter

import pytest

from panelloom.llm.mixing import mix_order, pfair_period, quantise

SCHEMA = "doc_id long, text string, source string, slot string"


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    return [(i, f"t{i}", rng.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(n)] + [(1, "t1", "a"), (None, None, "b")]


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 3, "b": 5, "c": 2}, {f"s{i}": i % 4 + 1 for i in range(30)}, {"x": 97, "y": 2, "z": 1}])
def test_every_block_in_its_window_and_lags_under_one(units):
    plan = pfair_period(units)
    period = sum(units.values())
    assert [p[3] for p in plan] == list(range(period))
    done = Counter()
    for source, nth, u, slot, release, deadline in plan:
        assert release <= slot < deadline and nth == done[source] and u == units[source]
        done[source] += 1
        assert all(abs(done[s] - (slot + 1) * units[s] / period) < 1 for s in units)
    assert done == Counter(units)


def test_units_add_up_and_leave_none_out():
    units = quantise({"a": 1.0, "b": 1e-9, "c": 2.5}, 100)
    assert sum(units.values()) == 100 and units["b"] == 1 and units["c"] > units["a"]


@pytest.mark.parametrize("weights", [None, {"hot": 1, "a": 2, "b": 1, "c": 1, "": 1}])
def test_prefixes_follow_the_weights(spark, weights):
    rows = corpus()
    out = mix_order(spark.createDataFrame([(d, t, s, "clash") for d, t, s in rows], SCHEMA).repartition(3), weights, block_rows=4, rows_per_part=100).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.source)) for r in out) == sorted((str(d), str(t), str(s)) for d, t, s in rows)
    sizes = Counter(s or "" for _, _, s in rows)
    target = weights or {s: (n / len(rows)) ** 0.5 for s, n in sizes.items()}
    whole = sum(target.values())
    blocks = sorted({(r.slot, r.mix_source, r.block, r.in_mix) for r in out})
    assert len({b[0] for b in blocks}) == len(blocks)
    done = Counter()
    for k, (slot, source, block, in_mix) in enumerate(blocks):
        assert block == done[source]
        done[source] += 1
        if in_mix:
            assert slot == k and all(abs(done[s] - (k + 1) * target[s] / whole) < 1.1 for s in target)
    assert any(not b[3] for b in blocks) and any(b[3] for b in blocks)
    for source, n in sizes.items():
        mine = sorted((r.block, r.in_block) for r in out if r.mix_source == source)
        assert mine == [(i // 4, i % 4) for i in range(n)]
    assert all(r.release <= r.slot < r.deadline for r in out)


def test_empty_table_and_missing_weight(spark):
    assert mix_order(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mix_order(spark.createDataFrame([(1, "x", "a", None)], SCHEMA), {"b": 1.0})


def test_input_columns_stay_whatever_their_names(spark):
    names = ["nth", "slot_in_period", "_key", "_part", "row", "key", "part", "more", "units", "turn", "index", "at", "start", "n", "a.b"]
    rows = [(i, f"s{i % 3}", *[1000 * i + k for k in range(len(names))]) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"`{n}` long" for n in names))
    out = mix_order(table, block_rows=4, rows_per_part=20)
    assert out.columns[: len(names) + 2] == table.columns
    assert sorted(tuple(r)[: len(names) + 2] for r in out.collect()) == sorted(rows)


def test_equal_rows_and_null_ids_are_numbered_in_pieces(spark):
    rows = [(7, "same", "hot")] * 900 + [(None, f"t{i}", "hot") for i in range(300)] + [(i, "x", "cold") for i in range(200)]
    out = mix_order(spark.createDataFrame([(d, t, s, "") for d, t, s in rows], SCHEMA).repartition(3), block_rows=4, rows_per_part=20).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((d, t) for d, t, _ in rows)
    for source, n in (("hot", 1200), ("cold", 200)):
        assert sorted((r.block, r.in_block) for r in out if r.mix_source == source) == [(i // 4, i % 4) for i in range(n)]


def plain_schedule(units, blocks):
    """Slot of every block, by looking at all released blocks of all sources in each slot; no period, no heap."""
    period, done, slots, t = sum(units.values()), dict.fromkeys(units, 0), {}, 0
    while len(slots) < sum(blocks.values()):
        ready = []
        for s, u in units.items():
            i = done[s]
            if i * period // u <= t:
                ready.append((-(-(i + 1) * period // u), s))
        if ready:
            s = min(ready)[1]
            if done[s] < blocks[s]:
                slots[s, done[s]] = t
            done[s] += 1
        t += 1
    return slots


def test_slots_are_those_of_a_plain_scheduler(spark):
    rows = corpus(900, seed=5)
    weights = {"hot": 5.0, "a": 3.0, "b": 2.0, "c": 1.5, "": 0.5}
    out = mix_order(spark.createDataFrame([(d, t, s, "") for d, t, s in rows], SCHEMA), weights, block_rows=4, period=240).collect()
    units = quantise(weights, 240)
    want = plain_schedule(units, {s: -(-sum((x or "") == s for _, _, x in rows) // 4) for s in units})
    assert {((r.mix_source, r.block), r.slot) for r in out} == set(want.items())


def test_many_sources_are_quantised_at_once():
    weights = {f"s{i:06}": 1.0 if i else 1e6 for i in range(100_000)}
    began = time.time()
    units = quantise(weights, 400_000)
    assert time.time() - began < 10 and sum(units.values()) == 400_000 and min(units.values()) == 1
    # ties give from the greater name
    assert quantise({"a": 1.0, "b": 1.0, "c": 1e-9, "d": 1e-9}, 5) == {"a": 2, "b": 1, "c": 1, "d": 1}
