import hashlib
from collections import Counter
import unicodedata

import pytest
from pyspark.sql import functions as F

from panelloom.llm import fingerprints
from panelloom.llm.fingerprints import fingerprint, fingerprint_with_edits

SCHEMA = "doc_id long, text string, hash string, fingerprint string"


def same(text):
    return " ".join(unicodedata.normalize("NFC", text or "").casefold().split())


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        cut = len(t) // 3
        out[d] = (len(t), t[: len(t) - cut] + following[:cut], following, t)
    return out


def test_against_plain_python(spark):
    texts = ["Été  d'été\n", "été d'été", "ÉTÉ D’ÉTÉ", "Straße", "STRASSE", "", None, "  ", "a" * 5000, "日本語　テキスト", "日本語 テキスト", "x\U0001f600y\U0001f600z"]
    texts += [f"word{i % 40} " * (i % 7) for i in range(300)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, None, "clash") for d, t in rows], SCHEMA).repartition(5)
    want, out = brute(rows), {r.doc_id: r for r in fingerprint_with_edits(df).collect()}
    assert len(out) == len(rows)
    prints: dict[str, set] = {}
    for d, (n, edited, following, text) in want.items():
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(same(text) == same(edited)) and r.near_next == float(same(text) == same(following))
        prints.setdefault(r.fingerprint, set()).add(same(text))
        prints.setdefault(r.edited_fingerprint, set()).add(same(edited))
    assert all(len(v) == 1 for v in prints.values()) and len({min(v) for v in prints.values()}) == len(prints)


def test_next_across_ranges(spark):
    rows = [(i * i, f"text {i} " * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints._with_next(fingerprints.hashed(df), lambda rows: rows, ["next_text", "text"], rows_per_range=7)
    want = brute(rows)
    assert {r.doc_id: (r.next_text, r.text) for r in out.collect()} == {d: (v[2], v[3]) for d, v in want.items()}


def test_null_ids_across_ranges(spark):
    rows = [(i * i if i % 10 else None, f"text {i} " * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints._with_next(fingerprints.hashed(df), lambda rows: rows, ["next_text", "text"], rows_per_range=7).collect()
    known, nulls = [r for r in rows if r[0] is not None], [t for d, t in rows if d is None]
    assert {(r.doc_id, r.text) for r in out} == set(rows) and len(out) == len(rows)
    want, following = brute(known), {r.text: r.next_text for r in out}
    for d, v in want.items():
        assert following[v[3]] == v[2] if d != 1 else following[v[3]] in nulls
    # the nulls come last, one after another, and then the greatest doc_id again
    assert sorted(following) == sorted(t for _, t in rows) and sorted(following.values()) == sorted(following)
    assert sum(following[t] in nulls for t in nulls) == len(nulls) - 1


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda text, lanes=2: F.substring(F.sha1(text), 1, 1))
    df = spark.createDataFrame([(i, f"t{i % 30}") for i in range(60)], "doc_id long, text string")
    out = fingerprint(df).collect()
    assert len({r.fingerprint for r in out}) == 30
    assert len({(r.doc_id % 30, r.fingerprint) for r in out}) == 30


def test_few_bits_still_find_all(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda text, lanes=2: F.substring(F.sha1(text), 1, 1))
    df = fingerprints.hashed(spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string"))
    twice = {r[0] for r in df.groupBy("hash").count().filter("count > 1").collect()}
    assert {r[0] for r in fingerprints.clashes(df, words=1).collect()} == twice


def test_nulls_repeats_single_and_empty(spark):
    one = fingerprint_with_edits(spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"Hello thHel").hexdigest() and one.near_next == 1.0
    rows = [(None, "a b"), (None, None), (4, "a b"), (4, "a b"), (9, "c")]
    out = fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and len({r.fingerprint for r in out}) == 3
    assert fingerprint_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("ways", [4, 64])
def test_ranges_keep_the_order_and_split_what_is_large(spark, ways):
    ids = [*range(500), *[10**15 + i for i in range(500)], *[7] * 400, *[None] * 400, -(2**62), 2**62, 10**12, 10**16, 10**18]
    rows = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string")
    out = fingerprints.in_ranges(rows, rows_per_range=20, ways=ways).withColumn("tie", F.xxhash64("text")).collect()
    by_part = sorted(out, key=lambda r: (tuple(r._part), r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert by_part == sorted(out, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    sizes = Counter(tuple(r._part) for r in out)
    assert max(n for (_, _, t), n in sizes.items() if not t) <= 40 and max(sizes.values()) <= 60 and len(sizes) > 60


def test_far_ids_leave_no_range_whole(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in [*range(20_000), 10**12, 10**18]], "doc_id long, text string")
    sizes = fingerprints.in_ranges(rows).groupBy("_part").count().agg({"count": "max"}).first()[0]
    assert sizes <= 4000
