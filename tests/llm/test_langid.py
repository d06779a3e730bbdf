import random
import zlib

import numpy as np
import pytest

from panelloom.llm import langid
from panelloom.llm.langid import Model, fit, gradients, identify, position_scores, train, windows_of

SYLLABLES = {"xa": ["ba", "do", "mi", "lu"], "yb": ["ñe", "ção", "éa", "ü"], "zc": ["kr", "szt", "pf", "wy"]}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang), lang) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    model = Model.fresh(["a", "b", "c"])
    for part in (model.inputs, model.states, model.outs):
        part[:] = [w.astype(float) for w in part]
    model.bias = model.bias.astype(float)
    x, y = rng.integers(1, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    x[5:, 2] = 0
    _, found = gradients(model, x, y)
    for w, g in zip(model.weights(), found):
        for i in zip(*(rng.integers(0, n, 12) for n in w.shape)):
            i = (i[0], int(x[i[1] % 5, i[1] % 2])) if w.shape[1] == 256 else i
            old = w[i]
            w[i] = old + 1e-4
            up = gradients(model, x, y)[0]
            w[i] = old - 1e-4
            down = gradients(model, x, y)[0]
            w[i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 1e-6


def test_padding_changes_nothing():
    model = Model.fresh(["a", "b"])
    x, counts = windows_of([b"abc", b"", b"q" * 65])
    assert counts.tolist() == [1, 0, 2] and x.shape == (langid.STEPS, 3)
    longer = np.concatenate((x, np.zeros((5, 3), np.uint8)))
    assert np.allclose(position_scores(model, x), position_scores(model, longer)[: langid.STEPS], atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    held = [(d, lang) for d, _, lang in corpus() if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in out.items() if r.held_out} == {d for d, _ in held}
    assert np.mean([out[d].lang_pred == lang for d, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus()
    wrong = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (train(spark.createDataFrame(x, schema)) for x in (rows, wrong))
    assert a.langs == b.langs and all(np.array_equal(x, y) for x, y in zip(a.weights(), b.weights()))


@pytest.fixture(scope="module")
def model():
    rows = corpus(2, 200)
    return fit([t.encode() for _, t, _ in rows], [lang for _, _, lang in rows], rounds=80)


def test_odd_texts(spark, model):
    rng = random.Random(7)
    mixed = sentence(rng, "xa", 60) + " " + sentence(rng, "zc", 60)
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (4, sentence(rng, "yb", 20_000)), (5, mixed), (5, mixed), (None, sentence(rng, "xa")), (6, "\0\0"), (7, "é")]
    df = spark.createDataFrame([(d, t, 0.5, "clash") for d, t in rows], "doc_id long, text string, score double, lang_pred string")
    out = identify(df, model, spans=True).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == [] for i in (1, 2, 3, 6))
    assert by[4].lang_pred == "yb" and by[None].lang_pred == "xa" and not by[None].held_out and by[7].lang_pred in model.langs
    size = len(mixed.encode())
    spans = by[5].spans
    assert spans[0].start == 0 and spans[-1].end == size and all(a.end == b.start for a, b in zip(spans, spans[1:]))
    half = sum(s.end - s.start for s in spans if s.lang == "xa") / size
    assert 0.3 < half < 0.7


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert train(df) is None
    assert [tuple(r) for r in identify(df, None).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    empty = df.limit(0)
    assert train(empty) is None and identify(empty, None, spans=True).count() == 0


def test_repeated_and_letterless_rows_hide_no_language(spark):
    """A language of one row repeated, and one of few texts among many rows of digits, are learned; a run without letters is moved."""
    rng = random.Random(3)
    learn = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, sentence(rng, "xa", 30), "xa") for i in learn[:300]] + [(learn[300], sentence(rng, "yb", 40), "yb")] * 5000
    rows += [(i, f"{i} 12 {i % 97}", "zc") for i in learn[400:20_400]] + [(i, "7 " * 9000 + sentence(rng, "zc", 30), "zc") for i in learn[21_000:21_010]]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert list(model.langs) == ["xa", "yb", "zc"]
