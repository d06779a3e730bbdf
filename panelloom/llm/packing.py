"""Mixture-controlled packing: deficit round-robin over source queues, in closed form."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .words import slices

#: Letters of Latin-1 but for the ordinals and the micro sign, lower-cased; characters with which a text is encoded whole.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_ODD = re.compile("[\x1c-\x1f\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\u0100-\U0010ffff]")
#: What the tokenizer splits such a text into: runs of letters, digits, runs of other marks; whatever holds an apostrophe stays whole.
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_QUOTED_PARTS = re.compile(rf"\S*'\S*|{_PARTS.pattern}")
#: A worker keeps two generations of so many parts, about 30 MB; parts longer than LONGEST aren't kept.
GENERATION, LONGEST = 120_000, 40
#: Weights are kept to until the plan has so many lanes, which grow with the square of the number of queues.
MOST_LANES = 200_000
#: Normalisers and splits, as a tokenizer's file names them, under which words can be encoded one by one, lower-cased.
WORDWISE = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _is_wordwise(about: dict) -> bool:
    steps = [(about[part] or {}).get(many, []) for part, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    splits = [x["pattern"].get("Regex") for x in steps[1] if x["type"] == "Split"]
    found = [x["type"] for x in steps[0]], [x["type"] for x in steps[1]], "".join(s or "" for s in splits)
    return found == WORDWISE and about["model"]["type"] == "BPE"


class _Pieces(dict):
    """Ids of the parts of texts, as bytes: the newer generation of a cache; `old` is the one before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.letters = _byte_letters()
        about = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in about["added_tokens"]]
        #: Whether equal parts always have equal ids, lower-cased; else texts are encoded whole.
        self.wordwise = _is_wordwise(about)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if part.isalpha():
                coded = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                ids = array(self.code, [t.id for t in self.model.tokenize(coded)]).tobytes()
            else:
                ids = self.whole(part)
        if len(part) <= LONGEST:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def encode(path: str, text: str) -> bytes:
    """The tokenizer's ids for a whole text, without special tokens; equal words are encoded once where its file and the text allow that."""
    pieces = _pieces(path)
    if not pieces.wordwise or _ODD.search(text) or any(x in text for x in pieces.added):
        return pieces.whole(text)
    parts = _QUOTED_PARTS if "'" in text else _PARTS
    return b"".join(map(pieces.__getitem__, parts.findall(text.lower())))


def _tokens(path: str, end_id: int):
    """Ids of each row, and where they start among those of its source in its block: what a task reads of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _pieces(path).kind
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        seen: dict[tuple[str, str], int] = {}
        for batch in slices(batches, "text", 1 << 20):
            at, counts, ids = [], [], []
            for source, block, text in zip(*(batch.column(c).to_pylist() for c in ("source", "block", "text"))):
                x = encode(path, text) + end
                n = len(x) // width
                at.append(seen.get((source, block), 0))
                seen[source, block] = at[-1] + n
                counts.append(n)
                ids.append(x)
            own = [batch.column(c) for c in ("doc_id", "source", "block")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "block", "at", "n", "ids"])

    return run


@dataclass(frozen=True)
class Lane:
    """Tokens [start, end) of a queue, which in its phase are lane tokens from `shift` on.

    Of every x tokens of the phase's stream the lanes before take x * low // whole, and this lane the next ones up to
    x * high // whole: its quantum of each window is its share and the deficit carried from all windows before, in
    whole tokens, and lanes never owe or lead by one token or more. As this holds for any x, a task can begin at any
    window with the deficits that a run from the first window would bring.
    """

    start: int
    end: int
    shift: int
    low: int
    high: int
    whole: int
    length: int  # tokens of the phase
    first_window: int

    def before(self, x: int) -> int:
        """Lane tokens among the first x of the phase's stream."""
        return x * self.high // self.whole - x * self.low // self.whole

    def cut(self, a: int, b: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(token, length, window, offset) of the pieces of lane tokens [a, b)."""
        w = min(a * self.whole // ((self.high - self.low) * size), (self.length - 1) // size)
        while w and self.before(w * size) > a:
            w -= 1
        while self.before(min((w + 1) * size, self.length)) <= a:
            w += 1
        while a < b:
            x, y = w * size, min((w + 1) * size, self.length)
            mine = self.before(x)
            end = min(b, self.before(y))
            if end > a:
                others = y * self.low // self.whole - x * self.low // self.whole
                yield a, end - a, w, others + a - mine
            a, w = max(a, end), w + 1


def _dealt(tokens: int, units: dict[str, int]) -> dict[str, int]:
    """Whole tokens in proportion to the units, by largest remainders; ties to the smaller name."""
    whole = sum(units.values())
    out = {q: tokens * u // whole for q, u in units.items()}
    order = sorted(units, key=lambda q: (-(tokens * units[q] % whole), q))
    for q in order[: tokens - sum(out.values())]:
        out[q] += 1
    return out


def _phases(left: dict[str, int], units: dict[str, int], size: int) -> Iterator[tuple[int, dict[str, int]]]:
    """(windows, tokens of each queue): shares by the units of the queues that have tokens left, to the last whole window.

    A phase ends where a queue can't fill its quantum; in the next window it gives what it has, and then drops out.
    """
    left = dict(left)
    while sum(left.values()) >= size:
        whole = sum(units[q] for q in left)
        n = min(left[q] * whole // (units[q] * size) for q in left)
        given, room, open_ = {}, max(1, n) * size, dict.fromkeys(left)
        while short := [q for q in open_ if left[q] * whole < room * units[q]]:
            for q in short:
                given[q] = left[q]
                del open_[q]
            room, whole = max(1, n) * size - sum(given.values()), sum(units[q] for q in open_)
        given |= _dealt(room, {q: units[q] for q in open_})
        yield max(1, n), given
        left = {q: x - given[q] for q, x in left.items() if x > given[q]}


def plan(totals: dict[str, int], size: int, weights: dict[str, float] | None = None) -> tuple[dict[str, list[Lane]], int]:
    """Lanes of each queue, and how many windows there are.

    With weights, phases of whole windows have these shares among the queues that aren't at their end; each time that
    one is, the others go on in their proportions (for MOST_LANES lanes at most). Then, or from the start without
    weights, the shares are those of what is left, so that all queues end together. A queue that is left with less than
    a token in a window joins the largest one's lane.
    """
    lanes: dict[str, list[Lane]] = {q: [] for q in totals}
    done = dict.fromkeys(totals, 0)
    windows = made = 0
    if weights:
        known = {q: weights[q] for q in sorted(weights) if totals.get(q)}
        unit = {q: max(1, round(10**9 * w / sum(known.values()))) for q, w in known.items()}
        for n, given in _phases({q: totals[q] for q in unit}, unit, size):
            if made > MOST_LANES:
                break
            low = 0
            for q in sorted(given):
                if given[q]:
                    lanes[q].append(Lane(done[q], done[q] + given[q], 0, low, low + given[q], n * size, n * size, windows))
                    done[q], low, made = done[q] + given[q], low + given[q], made + 1
            windows += n
    left = {q: totals[q] - done[q] for q in totals if totals[q] > done[q]}
    whole = sum(left.values())
    if whole:
        largest = max(left, key=lambda q: (left[q], q))
        small = [q for q in sorted(left) if left[q] * size < whole and q != largest]
        low = 0
        for q in sorted(set(left) - set(small)):
            members = [q, *small] if q == largest else [q]
            high, shift = low + sum(left[m] for m in members), 0
            for m in members:
                lanes[m].append(Lane(done[m], totals[m], shift, low, high, whole, whole, windows))
                shift += left[m]
            low = high
    return lanes, windows + -(-whole // size)


def _cutter(lanes: dict[str, list[Lane]], size: int, kind: str, last_window: int, tail: int, with_ids: bool):
    # the last window's tokens are dealt to sequences at powers of two, which need no padding
    ends, steps = [], [1 << i for i in reversed(range(tail.bit_length())) if tail >> i & 1]
    for s in steps:
        ends.append((ends[-1] if ends else 0) + s)

    def split(length: int, window: int, offset: int) -> Iterator[tuple[int, int, int]]:
        if window != last_window or not tail:
            yield length, window, offset
            return
        begin = 0
        for i, end in enumerate(ends):
            if offset < end and length:
                n = min(length, end - offset)
                yield n, window + i, offset - begin
                offset, length = offset + n, length - n
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane_starts = {q: [lane.start for lane in own] for q, own in lanes.items()}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for batch in slices(batches, "ids", 1 << 20):
            out: list[list] = [[] for _ in names]
            parts: list[np.ndarray] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "pos", "n", "ids")]
            for doc_id, source, queue, pos, n, raw in zip(*columns):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for lane in lanes[queue][max(0, bisect_right(lane_starts[queue], pos) - 1) :]:
                    a, b = max(pos, lane.start), min(pos + n, lane.end)
                    if a >= b:
                        break
                    move = lane.shift - lane.start
                    for token, length, window, offset in lane.cut(a + move, b + move, size):
                        start = token - move - pos
                        for m, sequence, place in split(length, lane.first_window + window, offset):
                            piece = ids[start : start + m]
                            for column, value in zip(out, (doc_id, start, m, zlib.crc32(piece.tobytes()), n, sequence, place, source)):
                                column.append(value)
                            if with_ids:
                                parts.append(piece)
                            start += m
            arrays = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 7 + [pa.string()])]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(out[2]))).astype(np.int32)
                values = np.concatenate(parts) if parts else np.empty(0, "<u4")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, weights: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Cut all documents' ids into sequences of at most `size`, each filled from the sources in target proportions.

    A document is its ids and end_id. Each source is a queue (small ones that would have less than a token in a window
    are one queue together). Deficit round-robin: every window takes from each queue in turn its quantum, its target
    share of the window and the deficit carried on. Targets are `weights` (of sources; small weights are one queue
    together, sources without one come last), or the queues' shares of all tokens, with which every window mirrors the
    corpus; see `plan` for the end of a queue. The tokens before a row in its queue are
    summed by blocks (what a task reads of a file, in the files' order), so every task finds its rows' windows and deficits by arithmetic alone: the
    texts and ids are never shuffled for it, and no queue passes through one task. Only counts of the queues, at most
    size + 1, come to the driver. The last window is split at powers of two, so that nothing is padded.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, with_ids,
    ids. Null texts are empty, null sources are the source ''; null or repeated doc_ids are rows like others. An
    empty table gives no rows. A text of any length is one document, cut wherever its windows end. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_or_empty().alias("text"))
    # part files are named in the order of their rows, so a table that was written in an order is packed in it
    block = F.concat(F.input_file_name(), F.lit("|"), F.lpad(F.input_file_block_start().cast("string"), 16, "0"), F.lit("|"), F.lpad(F.spark_partition_id().cast("string"), 10, "0"))
    rows = rows.withColumn("block", block)
    tokens = materialize(rows.mapInArrow(_tokens(tokenizer, end_id), "doc_id long, source string, block string, at long, n long, ids binary"), "tokens")

    sums = materialize(tokens.groupBy("source", "block").agg(F.sum("n").alias("n")), "block-tokens")
    whole = sums.agg(F.sum("n")).first()[0] or 0
    large = sums.groupBy("source").agg(F.sum("n").alias("all")).filter(F.col("all") * size >= whole).select("source", F.lit(True).alias("large"))
    # queue names: '=' and the source, or '' for all small sources together, '+' for those of small weights
    queue = F.when(F.col("large"), F.concat(F.lit("="), "source")).otherwise(F.lit(""))
    queued, named = sums.join(large, "source", "left"), None
    if weights:
        given = tokens.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, weight double")
        own = F.col("weight") * size >= sum(w for w in weights.values() if w > 0)
        queue = F.when(own, F.concat(F.lit("="), "source")).when(~own, "+").otherwise(queue)
        queued = queued.join(given, "source", "left")
        present = queued.filter("weight is not null").select(queue.alias("queue"), "source", "weight").distinct()
        named = {r["queue"]: r["w"] for r in present.groupBy("queue").agg(F.sum("weight").alias("w")).collect()}
    queued = queued.withColumn("queue", queue)
    before = Window.partitionBy("queue").orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(queued.select("source", "block", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "queue-starts")
    totals = {r["queue"]: r["n"] for r in starts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    lanes, windows = plan(totals, size, named)
    kind = _pieces(tokenizer).kind
    placed = tokens.join(starts.drop("n"), ["source", "block"]).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("pos"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<int>" * with_ids
    return placed.mapInArrow(_cutter(lanes, size, kind, windows - 1, whole % size, with_ids), schema)
