import random
import re

from panelloom.llm.licenses import TEMPLATES, collision, scan_licenses, spans, window_length

SCHEMA = "doc_id long, text string, template string, words string"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    want = set()
    for d, t in rows:
        if d is None:
            continue
        mine = set(shingles(t))
        for i, (_, _, text) in enumerate(templates):
            theirs = set(shingles(text))
            if theirs and 100 * len(theirs & mine) >= 80 * len(theirs):
                want.add((d, i, len(theirs), len(theirs & mine)))
    return want


def test_against_all_shingles(spark):
    rng = random.Random(1)
    vocabulary = ["lorem", "ipsum", "the", "license", "copy", "software", "été"]
    rows = []
    for d in range(250):
        filler = lambda: [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 400]))]
        w = filler()
        for _ in range(rng.choice([0, 1, 2])):
            t = rng.choice(TEMPLATES)[2].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = "changed"
            w += [x.upper() if rng.random() < 0.1 else x for x in t] + filler()
        rows.append((d, rng.choice([" ", "\n * "]).join(w)))
    rows += [(900, None), (901, ""), (902, "Released under the MIT License"), (903, "x " * 50_000 + "Released under the MIT License."), (None, "Released under the MIT License."), (902, "Released under the MIT License")]
    got = {(r.doc_id, r.template_id, r.n_shingles, r.n_found) for r in scan_licenses(spark.createDataFrame([(d, t, None, "clash") for d, t in rows], SCHEMA)).collect()}
    assert got == brute(rows, TEMPLATES) and len(got) > 100


def test_own_templates_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four")], "doc_id long, text string")
    templates = spark.createDataFrame([(7, "t", "ONE, two; three four five"), (8, "short", "one two"), (9, None, None)], "template_id long, template string, text string")
    assert [tuple(r) for r in scan_licenses(docs, templates).collect()] == [(1, 7, "t", 1, 1, 0, 1.0)]
    assert scan_licenses(docs.limit(0), templates).count() == 0 and scan_licenses(docs, templates.limit(0)).count() == 0


def test_bands_meet_nearly_always_and_windows_hold_every_run():
    assert all(collision(n) >= 0.9999 for n in range(1, 5000))
    for n in range(1, 400):
        size, step = spans(window_length(n))
        assert all(at % step + n <= size for at in range(3 * step))


def test_only_what_the_bands_retrieve_is_checked(spark):
    words = TEMPLATES[2][2].split()
    filler = " ".join(f"filler{i}" for i in range(300))
    halves = f"{' '.join(words[: len(words) // 2])} {filler} {' '.join(words[len(words) // 2 - 4 :])}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, halves)], "doc_id long, text string")
    # the second has all shingles, but no window with 80 % of them
    assert {d for d, _, _, _ in brute(docs.collect(), TEMPLATES[2:3])} == {1, 2}
    assert [(r.doc_id, r.template_id) for r in scan_licenses(docs).collect() if r.template_id == 2] == [(1, 2)]
