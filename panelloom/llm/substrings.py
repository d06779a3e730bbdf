"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty
from .words import Words, blocks, local_minima


def lengths(min_words: int, shortest: int = 12) -> list[int]:
    """Window lengths of the levels: each is half of the next, rounded up, from `shortest` words or a little more to min_words."""
    out = [min_words]
    while (half := (out[0] + 1) // 2) >= shortest:
        out.insert(0, half)
    return out if len(out) > 1 else [(min_words + 1) // 2, min_words]


def _marked(w: Words, words: np.ndarray, length: int, anchors: pa.ListArray) -> np.ndarray:
    """How many of the living windows that each row's anchors name stand before each word, in all texts; one more at the end."""
    mine = np.repeat(np.arange(len(w.counts)), np.diff(anchors.offsets.to_numpy()))
    found = _pairs_in(w.doc, w.windows(length, words=words), mine, anchors.flatten().to_numpy().view(np.uint64)) & (w.left >= length)
    return np.concatenate(([0], np.cumsum(found)))


def _anchors(length: int, least: int, before: int | None):
    """(text's hash, doc_id, anchor) of the windows of a level that are least among those of some whole window.

    Past the first level only windows inside a whole window that holds a living one of the level before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            w = Words(texts)
            words = w.hashes()
            h = w.windows(length, words=words)
            good = local_minima(h, least - length + 1) & (w.counts[w.doc] >= least) & (w.left >= length)
            if before:
                seen = _marked(w, words, before, batch.column("anchors"))
                at = np.arange(len(h))
                good &= seen[np.minimum(at + least - before + 1, len(h))] > seen[np.maximum(at - least + length, 0)]
            at = np.flatnonzero(good)
            doc, h = w.doc[at], h[at]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            own = batch.select(["d1", "doc_id"]).take(pa.array(doc[new]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(h[new].view(np.int64))], ["d1", "doc_id", "anchor"])

    return run


def _windows(half: int, least: int):
    """(k1, k2, doc_id, d1, pos) of the windows that hold one of the row's repeated anchors: 96 bits of hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            w = Words(texts)
            words = w.hashes()
            seen = _marked(w, words, half, batch.column("anchors"))
            # a window at i holds the anchors at i .. i + least - half
            to = np.minimum(np.arange(len(words)) + least - half + 1, len(words))
            at = np.flatnonzero((seen[to] > seen[:-1]) & (w.left >= least))
            k1, k2 = w.windows(least, 0, words)[at].view(np.int64), (w.windows(least, 1, words)[at] >> np.uint64(33)).astype(np.int32)
            own = batch.select(["doc_id", "d1"]).take(pa.array(w.doc[at]))
            pos = (at - w.first[w.doc[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), *own.columns, pa.array(pos)], ["k1", "k2", "doc_id", "d1", "pos"])

    return run


def _pairs_in(doc: np.ndarray, h: np.ndarray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether (doc, h) is one of the pairs (of, values); of is rising."""
    out = np.zeros(len(h), bool)
    for at in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
        if len(at):
            low, high = np.searchsorted(doc, [of[at[0]], of[at[0]] + 1])
            out[low:high] = np.isin(h[low:high], values[at])
    return out


def _results(least: int, keep_text: bool, with_marks: bool, carry: tuple[str, ...]):
    """The result rows: from whether the row is a copy (all its words go), or from the marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            removed, kept = [], []
            counts = []
            copies = [None] * len(texts) if with_marks else batch.column("copy").to_pylist()
            marks = batch.column("marks") if with_marks else None
            for i, text in enumerate(texts):
                words = text.split()  # of bytes: at \x20 and \x09-\x0D
                gone = 0
                if marks is not None and (m := marks[i].values) is not None and len(m):
                    at = np.asarray(m)
                    turn = np.zeros(len(words) + 1, np.int64)
                    np.add.at(turn, at, 1)
                    np.add.at(turn, at + least, -1)
                    stays = np.cumsum(turn[:-1]) == 0
                    gone = int(len(words) - stays.sum())
                    rest = [x for x, s in zip(words, stays) if s]
                elif copies[i] and len(words) >= least:
                    gone, rest = len(words), []
                else:
                    rest = words
                counts.append(len(words))
                removed.append(gone)
                kept.append((b" ".join(rest) if gone or not keep_text else text, rest))
            sha = [hashlib.sha256(k if not keep_text or g else b" ".join(r)).hexdigest() for (k, r), g in zip(kept, removed)]
            out = [*(batch.column(c) for c in ("doc_id", *carry)), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
            names = ["doc_id", *carry, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                out.append(pa.array([k for k, _ in kept], pa.binary()).cast(pa.string()))
                names.append("kept")
            if not with_marks:
                out += [batch.column("d1"), batch.column("anchors"), pa.array([t if a else None for t, a in zip(texts, batch.column("anchors").is_valid().to_pylist())], pa.binary()).cast(pa.string())]
                names += ["d1", "anchors", "text"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _living(anchors: DataFrame, name: str) -> DataFrame:
    """doc_id, d1 and anchors: the hashes among each text's windows that stand in two different texts."""
    found = anchors.groupBy("anchor").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter("a != b").select("anchor")
    found = materialize(found, f"repeated-{name}")
    return anchors.join(found, "anchor").groupBy("doc_id", "d1").agg(F.collect_set("anchor").alias("anchors"))


def dedup_substrings(docs: DataFrame, min_words: int = 50, keep_text: bool = False, carry: tuple[str, ...] = (), shortest: int = 12) -> DataFrame:
    """Remove each word covered by a window of `min_words` words that also starts in a document with a smaller doc_id.

    Level-wise doubling (`lengths`: 13, 25, 50 for 50 words). At the first length, of all windows those least among their
    neighbours are taken, so that each whole window holds one, and only those found in two different texts live on. At each
    next length only windows around a living one are formed, of these again those least among their neighbours, and only
    what is repeated lives on; at the last length all of them are formed and compared by the smallest doc_id that has them.
    The loop ends early where no candidates survive; windows longer than min_words cover no further word. Equal texts are
    recognised whole beforehand: all but the smallest doc_id of such a group lose all their words if they are as long as a
    window.

    Whole windows are equal if 95 bits of hash are: two different ones among N are taken for equal with a probability of
    N**2 / 2**96 at most, or 0.003 for the 1.5e13 windows of 100 TB. Shorter ones have 64 bits; a clash there only leaves a
    window in the race.

    Common passages are pre-aggregated (least and greatest doc_id of a hash), and the rows find them by a join whose
    large keys Spark splits. Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and,
    with keep_text, kept: the text as it was if nothing is removed, else the kept words joined by one space. Columns named
    in `carry` go along with their rows.

    A null text has no words. A row with a null doc_id keeps all its words and removes none. Rows that repeat a
    doc_id are judged each by its own text. A very long text is hashed in blocks, and is a row like others; an empty table
    gives no rows. Other columns are ignored.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    known = rows.filter("doc_id is not null")
    firsts = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    first, *later = lengths(min_words, shortest)[:-1]

    sampled = "d1 long, doc_id long, anchor long"
    anchors = known.select("doc_id", "text", "d1").mapInArrow(_anchors(first, min_words, None), sampled)
    state = materialize(firsts.join(_living(anchors, f"windows-{first}"), ["doc_id", "d1"], "left"), "first-texts")

    # an unmatched row has the text of a smaller doc_id
    joined = rows.join(state.withColumn("first", F.lit(True)), ["doc_id", "d1", "d2"], "left")
    joined = joined.select("doc_id", *carry, "text", "d1", "anchors", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("copy"))
    kept = ", kept string" if keep_text else ""
    kinds = "".join(f"`{c}` {kind}, " for c, kind in docs.select(*carry).dtypes)
    schema = f"doc_id long, {kinds}" + "n_words long, n_removed long, kept_sha256 string" + kept
    ready = materialize(joined.mapInArrow(_results(min_words, keep_text, False, carry), f"{schema}, d1 long, anchors array<long>, text string"), "ready-texts")
    discard(state)
    done, open_ = [ready.filter("anchors is null").drop("d1", "anchors", "text")], ready.filter("anchors is not null").drop("kept")

    before = first
    for length in later:
        again = open_.select("doc_id", "d1", "text", "anchors").mapInArrow(_anchors(length, min_words, before), sampled)
        living = materialize(_living(again, f"windows-{length}"), f"living-{length}")
        told = materialize(open_.drop("anchors").join(living, ["doc_id", "d1"], "left"), f"texts-{length}")
        untouched = told.filter("anchors is null")
        done.append((untouched.withColumn("kept", F.col("text")) if keep_text else untouched).drop("d1", "anchors", "text"))
        open_, before = told.filter("anchors is not null"), length
        discard(living)
        if open_.isEmpty():
            break

    windows = open_.select("doc_id", "d1", "text", "anchors").mapInArrow(_windows(before, min_words), "k1 long, k2 int, doc_id long, d1 long, pos int")
    repeated = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("k1", "k2", "least")
    repeated = materialize(repeated, f"repeated-windows-{min_words}")
    found = windows.join(repeated, ["k1", "k2"]).filter("doc_id > least").groupBy("doc_id", "d1").agg(F.collect_set("pos").alias("marks"))
    marked = open_.select("doc_id", *carry, "d1", "text").join(found, ["doc_id", "d1"], "left").select("doc_id", *carry, "text", "marks")
    out = marked.mapInArrow(_results(min_words, keep_text, True, carry), schema)
    for part in done:
        out = out.unionByName(part)
    return out
