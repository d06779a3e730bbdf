import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm.packing import encode, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, ids string, block string"
WEIRD = [
    "", " ", "Hello, World!!", "l'été d'Été; ÉTÉ?!", "don't can't I'M we'll they'VE 's", "été café́", "x\x1cy\x1f z", "a\xa0b c　d", "<|endoftext|> a<|startoftext|>b", "²½ 12a3 _x_ İstanbul ΣΑΣ ß",
    "日本語 テキスト", "a." * 50, "👩‍👩‍👧 ok", "Ærø Øl ÿ×÷", "x" * 300, "don't.", "\u0085a\u0085", "ẛ̣ Å",
]


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("byte_bpe_50k.json")])
def test_ids_are_the_tokenizers(path):
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = WEIRD + [" ".join(rng.choice(WEIRD).strip() for _ in range(6)) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), rng.randrange(160, 256), 32, 39])) for _ in range(60)) for _ in range(400)]
    for text in texts * 2:
        assert np.frombuffer(encode(path, text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def packed(spark, rows, size, **more):
    df = spark.createDataFrame([(d, t, s, None, "clash") for d, t, s in rows], SCHEMA).repartition(3)
    out = pack(df, PATH, size=size, with_ids=True, **more).collect()
    whole = Tokenizer.from_file(PATH)
    want = {d: whole.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in rows}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        docs[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length, r.source))
    assert {d: sum((ids for _, ids in sorted(p)), []) for d, p in docs.items()} == want
    for pieces in sequences.values():  # gapless from 0
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
    sizes = {s: sum(n for _, n, _ in p) for s, p in sequences.items()}
    assert all(n == size or n & (n - 1) == 0 for n in sizes.values()) and sorted(sizes) == list(range(len(sizes)))
    return sequences, sizes


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta,", "gamma.", "delta", "épsilon"]
    rows = []
    for i in range(200):
        source = rng.choice(["hot"] * 6 + ["b", "c", None])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))), source))
    return rows + [(1000, None, "b"), (1001, "lone", "tiny"), (1002, "x " * 3000, "c"), (1003, "", "tiny2")]


@pytest.mark.parametrize(("seed", "size"), [(1, 64), (2, 256)])
def test_every_id_once_and_shares_in_every_window(spark, seed, size):
    rows = corpus(seed)
    sequences, sizes = packed(spark, rows, size)
    per = defaultdict(int)
    for p in sequences.values():
        for _, n, s in p:
            per[s] += n
    total = sum(per.values())
    for source in ("hot", "b"):
        taken = 0
        for s in range(total // size):
            taken += sum(n for _, n, x in sequences[s] if x == source)
            assert abs(taken - (s + 1) * size * per[source] / total) < 1 + 4 * (source == "hot")  # small sources stand in the largest lane


def test_weights_hold_until_a_queue_runs_short(spark):
    rows = [(i, "one two three four " * 20, "ab"[i % 2]) for i in range(60)]
    sequences, _ = packed(spark, rows, 128, weights={"a": 3, "b": 1})
    taken = defaultdict(int)
    for s in range(25):
        for _, n, x in sequences[s]:
            taken[x] += n
        assert abs(taken["a"] - 96 * (s + 1)) < 1


def test_weights_go_on_without_the_queues_that_end():
    totals, size = {"a": 50_000, "b": 20_000, "c": 700, "d": 3}, 64
    lanes, windows = plan(totals, size, {"a": 2, "b": 1, "c": 1, "d": 0.001})
    per, seen = defaultdict(lambda: defaultdict(int)), set()
    for q, own in lanes.items():
        assert [lane.start for lane in own] == [0, *[lane.end for lane in own[:-1]]] and own[-1].end == totals[q]
        for lane in own:
            for token, n, w, offset in lane.cut(lane.shift, lane.shift + lane.end - lane.start, size):
                per[q][lane.first_window + w] += n
                places = {(lane.first_window + w, offset + i) for i in range(n)}
                assert not places & seen
                seen |= places
    assert len(seen) == sum(totals.values()) and windows == -(-len(seen) // size)
    assert all(abs(sum(per["c"][w] for w in range(k)) - 16 * k) < 2 for k in range(1, 40))
    # c has ended, a and b go on two to one, and not by what is left
    assert all(abs(sum(per["b"][w] for w in range(60, 60 + k)) - 64 / 3 * k) < 2 for k in range(1, 700))


def test_small_weights_have_their_share(spark):
    rows = [(i, "one two three four " * 20, "ab"[i % 2]) for i in range(60)] + [(100 + i, "five " * 9, f"s{i}") for i in range(20)]
    sequences, _ = packed(spark, rows, 128, weights={"a": 3, "b": 1} | {f"s{i}": 0.01 for i in range(20)})
    for n in (5, 15, 20):
        small = sum(m for s in range(n) for _, m, x in sequences[s] if x[0] == "s")
        assert abs(small - 128 * n * 0.2 / 4.2) < 2


def test_lanes_cover_every_token_once():
    rng = random.Random(4)
    for _ in range(200):
        totals = {f"q{i}": rng.choice([1, 2, 3, 50, 1000, 7777]) for i in range(rng.randrange(1, 9))}
        size = rng.choice([4, 16, 64])
        lanes, windows = plan(totals, size)
        whole, seen = sum(totals.values()), {}
        for q, own in lanes.items():
            covered = 0
            for lane in own:
                for token, n, w, offset in lane.cut(lane.shift, lane.shift + lane.end - lane.start, size):
                    covered += n
                    for i in range(n):
                        assert seen.setdefault((w, offset + i), q) == q and offset + n <= size
            assert covered == totals[q]
        assert len(seen) == whole and windows == -(-whole // size)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_table_written_in_an_order_is_packed_in_it(spark, tmp_path):
    rows = [(i, f"word{i} " * 30, "a") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/docs")
    out = pack(spark.read.parquet(f"{tmp_path}/docs"), PATH, size=64).collect()
    first = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        first.setdefault(r.doc_id, len(first))
    assert [d for d, _ in sorted(first.items(), key=lambda x: x[1])] == list(range(399, -1, -1))
