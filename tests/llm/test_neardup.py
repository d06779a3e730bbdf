import random
import re

import pytest

from panelloom.llm import neardup
from panelloom.llm.components import connected_components
from panelloom.llm.neardup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, sig string"


def shingles(text, size):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size):
    sets = [(d, shingles(t, size)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"Wort{i}ü" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 12, 60, 100, 150, 300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40)]
    for base in bases:
        texts += [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 14), vocabulary)) for _ in range(25)]
    chain = bases[4]
    for _ in range(12):  # each is near the one before, not those further off
        chain = edited(rng, chain, 3, vocabulary)
        texts.append(" ".join(chain))
    texts += ["", None, " \n", "one", "ONE", "two three", "a b c d", "A b  c\td", "x " * 500, "x " * 300] + texts[40:60]
    rng.shuffle(texts)
    return [(7 * i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[1]), (7, texts[1])]


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash", None) for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in near_duplicates(df, size=size).collect()), key=str) == brute(rows, size)


def test_copies_that_only_the_original_joins(spark, monkeypatch):
    """The original has the largest doc_id, its copies are under 0.8 to each other, and blocks are small."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(1000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, " ".join(edited(rng, base, 8, vocabulary))) for i in range(60)] + [(99, " ".join(base))]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()), key=str)
    assert got == brute(rows, 4)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(700, 700), (800, None), (900, 901), (901, 900), (900, 901)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 600)} | {900: 900, 901: 900}


def test_every_text_of_a_repeated_id_is_compared(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(1000)]
    a, b = ([rng.choice(vocabulary) for _ in range(120)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(edited(rng, a, 2, vocabulary))), (9, " ".join(edited(rng, b, 2, vocabulary)))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(2, 2), (5, 2), (9, 2)}
    assert len({(r.doc_id, r.d1, r.d2) for r in out}) == 4
