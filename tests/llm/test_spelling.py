import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelloom.llm import spelling
from panelloom.llm.spelling import near_words, spelling_variants

LOWER = {i: i + 32 for i in range(65, 91)}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, at_least=3):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= at_least}
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "f") for i, t in rows], "doc_id long, text string, n int, key string, form string")


@pytest.mark.parametrize("limits", [(100, 10_000), (3, 1000), (2, 6)])
def test_against_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(spelling.near_words, "__defaults__", limits)
    rng = np.random.default_rng(5)
    letters = list("abcà")
    base = ["".join(rng.choice(letters, rng.integers(4, 8))) for _ in range(150)] + ["prefix" + "".join(rng.choice(letters, 5)) for _ in range(60)] + ["x" * 9, "x" * 10, "Straße", "strasse"]
    share = rng.pareto(1, len(base)) + 0.1
    rows = [(int(i), " ".join(rng.choice(base, 150, p=share / share.sum()))) for i in range(60)]
    rows += [(None, "prefixaaaaa " * 97), (3, None), (4, ""), (5, "1 2 _ !"), rows[0], rows[0], (6, "É" * 3000 + " " + "é" * 3000), (7, ("y" * 5000 + ".") * 9), (8, "Wort9wort×÷wörter")]
    rows += [(100 + i, "Qwertyu qwertyui qwertyui qwertyui " + "qwertyuio " * 8) for i in range(6)]  # a form of a form
    want = brute(rows)
    assert len(want) > 100 and any(x[5] != (x[3] or x[0]) for x in want)
    assert got(spelling_variants(table(spark, rows))) == want


def test_pairs_of_a_shared_half_stay_linear(spark, monkeypatch):
    """Six hundred words share their first half: no key that is met has more chunks than the bound, and no pair is lost."""
    words = [f"shared{a}{b}{c}xyz" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefghij"]
    met = []
    real = spelling._met
    monkeypatch.setattr(spelling, "_met", lambda c, g: met.append((c.groupBy("key").count().agg({"count": "max"}).first()[0], c.filter("e - s > 1").groupBy("key").count().agg({"count": "max"}).first()[0])) or real(c, g))
    pairs = {tuple(sorted((r.a, r.b))) for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most_chunks=20).collect()}
    assert pairs == {tuple(sorted((a, b))) for a in words for b in words if one_apart(a, b)}
    assert len(met) > 1 and max(x for x, _ in met if x) <= 20


def test_empty(spark):
    assert got(spelling_variants(table(spark, []))) == []
    assert got(spelling_variants(table(spark, [(1, "abcdefgh abcdefgh")]))) == []
