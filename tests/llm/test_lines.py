import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import lines
from panelloom.llm.lines import LineRuns, dedup_lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows, min_docs=10, least=1):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = "\n".join(x for x in own if held[key(x)] < min_docs)
        out.append((i, len(own), sum(held[key(x)] >= min_docs for x in own), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept, r.kept_sha256) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, 2, [0]) for i, t in rows], "doc_id long, text string, kept string, pos int, batch int, lines array<int>")


@pytest.mark.parametrize("min_docs,batches,fanout", [(10, 8, 4), (3, 5, 2), (2, 1, 2)])
def test_against_brute_force(spark, min_docs, batches, fanout):
    rng = np.random.default_rng(batches)
    words = ["Alpha", "beta ", "\tGAMMA", "É", "é", "  ", "", "x\r", "x", "same line\x0b", "Same Line"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(words, rng.integers(1, 30)))) for i in range(120)]
    rows += [(1000 + i, f"subscribe NOW\nown {i}\n\nsubscribe now \n") for i in range(60)]  # a third has one line
    rows += [(7, None), (8, ""), (None, "x\nx\ny"), (None, None), (7, rows[7][1]), rows[3], rows[3], (9, "\n".join(f"line {i % 90}" for i in range(20_000)))]
    assert got(dedup_lines(table(spark, rows), min_docs=min_docs, batches=batches, fanout=fanout, keep_text=True)) == brute(rows, min_docs)


def test_rest(spark, monkeypatch):
    rows = [(i, f"ab\nabc\nlong line {i % 3}") for i in range(30)]
    monkeypatch.setattr(lines, "HOT_SHARE", 0.5)  # common keys that aren't hot
    assert got(dedup_lines(table(spark, rows), least=3, keep_text=True)) == brute(rows, least=3)
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0
    assert dedup_lines(table(spark, rows)).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_levels(spark):
    """Batches that come one after the other: each brings its new lines alone, and runs are compacted."""
    keys = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    runs, seen = LineRuns(spark, common=1, fanout=3, buckets=4), set()
    for k in range(7):
        now = {(r.h1, r.h2) for r in keys(k * 10, k * 10 + 25).collect()}
        new = runs.add(keys(k * 10, k * 10 + 25).unionByName(keys(k * 10, k * 10 + 5)))
        if k % 3 != 2:  # else compacted
            assert {(r.h1, r.h2) for r in new.collect()} == now - seen
        seen |= now
    assert [len(level) for level in runs.levels] == [1, 2]
    assert {(r.h1, r.h2) for r in runs.totals().collect()} == seen and runs.totals().count() == len(seen)
    runs.drop()
