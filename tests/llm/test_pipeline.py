import random

import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(s) for _ in range(3)) for _ in range(400)] for lang, s in {"aa": ["ba", "do", "mi"], "bb": ["ñe", "kr", "ü"]}.items()}
    rows = []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([20, 120, 300]))), lang, rng.choice(["s0", "s0", "s1", "s2"]), 0))
    passage = " ".join(rng.choice(words["aa"]) for _ in range(70))
    rows += [(300, "12 34 !!", None, "s1", 0), (301, None, None, "s1", 0), (302, "", "aa", None, 0)]
    rows += [(400 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(10)]  # exact copies
    rows += [(420, rows[0][1] + " " + "zz", rows[0][2], "s2", 0)] if len(rows[0][1].split()) > 50 else []
    rows += [(500 + i, " ".join(rng.choice(words["bb"]) for _ in range(200)) + "\n" + passage, "bb", "s0", 0) for i in range(3)]
    rows += [(600 + i, " ".join(rng.choice(words["aa"]) for _ in range(90)) + "\n" + passage, "aa", "s2", 0) for i in range(3)]
    return rows, passage


def test_stages_and_run(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    before = {r[0]: r for r in rows}
    assert set(before) - set(seen["language_id"]) == {300, 301, 302}
    near = seen["near_dedup"]
    assert set(seen["language_id"]) - set(near) >= set(range(400, 410)) and all(i in near for i in range(240)) and all(near[i].text == before[i][1] for i in near)
    cut = seen["substring_dedup"]
    assert set(cut) == set(near)
    assert passage in cut[500].text and all(passage not in cut[i].text for i in (501, 502, 600, 601, 602))
    assert all(cut[i].text == before[i][1] for i in range(240)) and all(len(r.text) == r.n_chars for r in cut.values())
    assert seen["mix_sources"] == cut
    whole = Tokenizer.from_file(pipeline.queries.tokenizer_path())
    pieces: dict[int, list] = {}
    for r in pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in pieces.items()} == {d: whole.encode(r.text, add_special_tokens=False).ids + [2] for d, r in cut.items()}


def test_leading_sequences_have_the_mixs_shares(spark):
    rows = [(i, "one two three four five six " * 40, "aa", "hot" if i % 10 else "rare", 0) for i in range(1500)]
    docs = pipeline.mix_sources(spark, spark.createDataFrame(rows, COLUMNS), "")
    out = pipeline.pack_sequences(spark, docs, "").select("source", "sequence_id", "length").collect()
    for n in (1, 4, 20):
        taken = {s: sum(r.length for r in out if r.source == s and r.sequence_id < n) for s in ("hot", "rare")}
        # a tenth of the rows, to the power 0.5: 1 to 3; rows alone would give 1 to 9
        assert abs(taken["rare"] - 4096 * n / 4) < 2 and sum(taken.values()) == 4096 * n, (n, taken)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_tells_rows_by_id_and_text(spark):
    rng = random.Random(9)
    text = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(80)) for _ in range(4)]
    rows = [(1, text[0], "aa", "s", 0), (2, text[0], "aa", "s", 0), (2, text[1], "aa", "s", 0), (3, text[2], "bb", "s", 0), (3, text[2], "aa", None, 0), (None, text[0], "aa", "s", 0), (4, "", "aa", "s", 0), (5, None, "aa", "s", 0)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], COLUMNS + ", d1 int")
    out = [tuple(r) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(map(str, out)) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]]))


def test_mixed_order_is_the_packed_one(spark, tmp_path):
    rows = [(i, f"text number {i} " * 30, "aa", "hot" if i % 5 else "rare", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, COLUMNS)
    place = {r.doc_id: r.slot * 100 + r.in_block for r in pipeline.mixing.mix_order(docs).collect()}
    pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    out = pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    for source in ("hot", "rare"):
        mine = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)) if r.source == source]
        order = list(dict.fromkeys(mine))
        assert order == sorted(order, key=place.get)
