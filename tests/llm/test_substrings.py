import hashlib
import random
import re

import numpy as np
import pytest

from panelloom.llm.substrings import dedup_substrings, lengths
from panelloom.llm.words import Words, local_minima

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, anchors string"


def brute(rows, least=50):
    """Every window of every document against those of smaller ids, in plain Python."""
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - least + 1):
            if d is not None:
                k = tuple(w[i : i + least])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - least + 1):
            if d is not None and first[tuple(w[i : i + least])] < d:
                gone |= set(range(i, i + least))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)] + ["a", "b"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (50, 51, 70, 130, 49, 25)]
    rows = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 30, 49, 50, 80, 200]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((d * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000 + i, rows[rng.randrange(60)][1]) for i in range(30)]  # exact copies
    rows += [(5, "x " * 300), (7, "x " * 200), (11, None), (12, ""), (None, rows[3][1]), (14, " ".join(["y"] * 50)), (13, " ".join(["y"] * 50)), rows[9], rows[9]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "clash") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in dedup_substrings(df).collect()), key=str)
    assert got == brute(rows)


def test_kept_text_is_untouched_where_nothing_goes(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one  two\n{passage}"), (2, f"head  head\n{passage} tail"), (3, "short  text")]
    out = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert out[1].kept == rows[0][1] and out[3].kept == rows[2][1]
    assert out[2].kept == "head head tail" and out[2].n_removed == 60


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_hashes_tell_windows_apart():
    texts = [b"a b c d a b c", b"", b" b c d ", b"ab c"]
    w = Words(texts)
    assert [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)] == b" ".join(texts).split()
    h = w.windows(3)
    of = {}
    for i in np.flatnonzero(w.left >= 3):
        of.setdefault(b" ".join(bytes(w.data[s:e]) for s, e in zip(w.starts[i : i + 3], w.ends[i : i + 3])), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in of.values()) and len(set.union(*of.values())) == len(of)


def test_local_minima_meet_every_run():
    x = np.random.default_rng(3).integers(0, 50, 500).astype(np.uint64)
    at = local_minima(x, 26)
    for i in range(len(x) - 25):
        run = slice(i, i + 26)
        assert (at[run] & (x[run] == x[run].min())).any()


@pytest.mark.parametrize("least,shortest", [(50, 12), (50, 30), (7, 2), (40, 5)])
def test_any_length_and_number_of_levels(spark, least, shortest):
    levels = lengths(least, shortest)
    assert levels[-1] == least and all(a == (b + 1) // 2 for a, b in zip(levels, levels[1:]))
    rows = corpus(3)
    got = sorted((tuple(r) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), least, shortest=shortest).collect()), key=str)
    assert got == brute(rows, least)
