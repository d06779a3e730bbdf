"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import blocks

#: Bytes of a window (states start at zero at both ends of each), units a direction, windows run side by side.
STEPS, UNITS, WIDTH = 64, 8, 4096
UNKNOWN = "und"


@dataclass
class Model:
    """Weights of both directions: bytes to gates (3H, 256), state to gates (3H, H), state to classes (L, H)."""

    langs: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    outs: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        model = cls(langs, [normal(3 * UNITS, 256) for _ in "fb"], [normal(3 * UNITS, UNITS) for _ in "fb"], [normal(len(langs), UNITS) for _ in "fb"], np.zeros((len(langs), 1), np.float32))
        for x in model.inputs:
            x[: 2 * UNITS] += 0.5
        model.settle()
        return model

    def settle(self) -> None:
        """A padding byte leaves a zero state at zero."""
        for x in self.inputs:
            x[2 * UNITS :, 0] = 0

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.outs, self.bias]


def _step(gates: np.ndarray, state: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a direction: gates are clipped to 0..1, the candidate is x / (1 + |x|)."""
    h = UNITS
    both = gates[: 2 * h]
    both += u[: 2 * h]
    np.clip(both, 0, 1, out=both)
    raw = u[2 * h :] * both[h:]
    raw += gates[2 * h :]
    new = raw / (np.abs(raw) + np.float32(1))
    out = state - new
    out *= both[:h]
    out += new
    return out, new, raw


def position_scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (T, L, B) of every position of windows x (T, B), from what stands before and after it."""
    steps, width = x.shape
    scores = np.empty((steps, len(model.langs), width), np.float32)
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        state, u = np.zeros((UNITS, width), np.float32), np.empty((3 * UNITS, width), np.float32)
        for t in order:
            np.matmul(model.states[d], state, out=u)
            state, _, _ = _step(np.take(model.inputs[d], x[t], axis=1), state, u)
            if d:
                scores[t] += model.outs[d] @ state
            else:
                scores[t] = model.outs[d] @ state
    scores += model.bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of windows x (T, B) of classes y (B,), and its gradients through time."""
    steps, width = x.shape
    h = UNITS
    kept: list[list[tuple]] = [[], []]
    states: list[list[np.ndarray]] = [[None] * steps, [None] * steps]
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        state = np.zeros((h, width), np.float32)
        for t in order:
            u = model.states[d] @ state
            gates = model.inputs[d][:, x[t]]
            open_ = gates[: 2 * h] + u[: 2 * h]
            open_ = (open_ > 0) & (open_ < 1)
            after, new, raw = _step(gates, state, u)
            kept[d].append((t, state, u, gates[: 2 * h], open_, new, raw))
            state = states[d][t] = after
    mask = (x != 0).astype(np.float32)
    scores = np.stack([sum(model.outs[d] @ states[d][t] for d in (0, 1)) + model.bias for t in range(steps)])
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    total = mask.sum()
    loss = float(-(np.log(p[:, y, np.arange(width)] + 1e-9) * mask).sum() / total)
    p[:, y, np.arange(width)] -= 1
    p *= (mask / total)[:, None, :]
    d_in, d_state = [np.zeros_like(w) for w in model.inputs], [np.zeros_like(w) for w in model.states]
    d_out = [sum(p[t] @ states[d][t].T for t in range(steps)) for d in (0, 1)]
    for d in (0, 1):
        back = np.zeros((h, width), np.float32)
        d_gates = np.empty((steps, 3 * h, width), np.float32)
        for t, state, u, both, open_, new, raw in reversed(kept[d]):
            back = back + model.outs[d].T @ p[t]
            z, r = both[:h], both[h:]
            d_raw = back * (1 - z) / (np.abs(raw) + 1) ** 2
            g = d_gates[t]
            g[:h] = back * (state - new)
            g[h : 2 * h] = d_raw * u[2 * h :]
            g[: 2 * h] *= open_
            g[2 * h :] = d_raw
            du = np.concatenate((g[: 2 * h], d_raw * r))
            d_state[d] += du @ state.T
            back = back * z + model.states[d].T @ du
        for i in range(3 * h):
            d_in[d][i] = np.bincount(x.ravel(), d_gates[:, i].ravel(), 256)
    return loss, [*d_in, *d_state, *d_out, p.sum(axis=(0, 2))[:, None]]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in windows of STEPS bytes, the last padded with zeros (T, B), and how many windows each text has."""
    counts = np.array([-(-len(t) // STEPS) for t in texts])
    data = b"".join(t.ljust(n * STEPS, b"\0") for t, n in zip(texts, counts.tolist()))
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, STEPS).T), counts


def fit(texts: list[bytes], labels: list[str], rounds: int = 160, width: int = 256, seed: int = 3) -> Model | None:
    """Train on windows drawn evenly from the languages, by Adam on the gradients through time."""
    langs = sorted(set(labels))
    if not langs:
        return None
    model = Model.fresh(langs, seed)
    if len(langs) == 1:
        return model
    rng = np.random.default_rng(seed)
    x, counts = windows_of(texts)
    y = np.repeat([langs.index(label) for label in labels], counts)
    by_lang = [np.flatnonzero((y == i) & (x != 0).any(axis=0)) for i in range(len(langs))]
    first, second = [np.zeros_like(w) for w in model.weights()], [np.zeros_like(w) for w in model.weights()]
    for k in range(1, rounds + 1):
        at = np.concatenate([rng.choice(own, -(-width // len(langs))) for own in by_lang if len(own)])
        _, grads = gradients(model, x[:, at], y[at])
        scale = min(1, 1 / (1e-9 + float(np.sqrt(sum((g**2).sum() for g in grads)))))
        rate = 0.03 * (1 - k / (rounds + 1))
        for w, g, m, v in zip(model.weights(), grads, first, second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model.settle()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = 200, chars: int = 4096) -> Model | None:
    """Fit a model on a bounded sample of the labelled documents that are not held out.

    The bounds are parameters: docs_per_lang documents of each language, those with the smallest hash of doc_id and text,
    and a run of `chars` code points of each, from a place given by that hash. Every language with a labelled text is
    learned, so the model and the counts by language are all that grows with their number. A hash below a threshold from
    the language's count of different rows with letters picks about three times those wanted (all, where there are fewer), so a
    hot language brings no more rows than others; repeated rows count once, and texts without letters not at all. Only text and
    lang are used.
    """
    letter = r"\p{L}"
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(letter))
    known = known.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.lit(33), F.col("text")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("_key").alias("n")).collect()}
    if not counts:
        return None
    key = F.col("_key")
    part = F.shiftrightunsigned(key, 33) / float(1 << 31)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * docs_per_lang / max(n, 1)))]), F.col("lang"))
    span = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    piece = F.col("text").substr((F.pmod(key, span) + 1).cast("int"), F.lit(chars))
    # where the run has no letter, that from the text's first letter
    piece = F.when(piece.rlike(letter), piece).otherwise(F.col("text").substr(F.regexp_instr("text", F.lit(letter)), F.lit(chars)))
    rows = known.filter(part < share).select("lang", key.alias("key"), piece.alias("text"))
    rows = rows.groupBy("lang", "key").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    taken = rows.withColumn("place", place).filter(F.col("place") <= docs_per_lang).collect()
    pairs = sorted((r["lang"], r["place"], r["text"].encode()) for r in taken)
    return fit([t for _, _, t in pairs], [lang for lang, _, _ in pairs]) if pairs else None


def _label(model: Model, spans: bool, kept: list[str]):
    langs = np.array(model.langs)

    def scored(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list]]:
        x, counts = windows_of(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        pooled, best = np.zeros((len(texts), len(langs))), []
        for i in range(0, x.shape[1], WIDTH):
            part = x[:, i : i + WIDTH]
            p = position_scores(model, part)
            if spans:
                best.append(p.argmax(axis=1).T)
            p *= (part != 0)[:, None, :]
            np.add.at(pooled, owner[i : i + WIDTH], p.sum(axis=0).T)
        total = pooled.sum(axis=1, keepdims=True)
        # a text of padding bytes alone has no position to pool
        pooled = np.where(total > 0, pooled / np.maximum(total, 1e-12), 1 / len(langs))
        return pooled, np.concatenate(best) if best else None, np.cumsum(counts) - counts

    def runs(labels: np.ndarray, n: int) -> list[dict]:
        labels = labels.ravel()[:n]
        turn = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [n]))
        return [{"start": int(a), "end": int(b), "lang": model.langs[labels[a]]} for a, b in zip(turn, turn[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=1 << 20):
            pooled, best, first = scored(texts)
            pred, score = langs[pooled.argmax(axis=1)].tolist(), pooled.max(axis=1).tolist()
            letters = batch.column("_letters").to_pylist()
            keep = [c for c in batch.schema.names if c in kept]
            out = [*(batch.column(c) for c in keep), pa.array([p if has else UNKNOWN for p, has in zip(pred, letters)]), pa.array([s if has else 0.0 for s, has in zip(score, letters)], pa.float64())]
            names = [*keep, "lang_pred", "score"]
            if spans:
                found = [runs(best[f : f - (-len(t) // STEPS)], len(t)) if t and has else [] for f, t, has in zip(first, texts, letters)]
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def identify(docs: DataFrame, model: Model | None, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text: doc_id, columns to carry, held_out, lang_pred, score and, with spans, spans.

    Every byte position gets class probabilities from the states before and after it in its window; a document's are
    their mean, lang_pred the largest (ties: the smaller name) and score its probability. spans are the runs of
    byte positions with the same most likely language. A null text or one without letters is `und` with score 0, as
    all are if there was nothing to learn from. Rows are independent: repeated rows and null doc_ids stay rows, an
    empty table gives none, and columns other than doc_id and text are ignored; `carry` names columns that go along. A very
    long text is cut into windows like any other, a megabyte of texts or one text at once.
    """
    kept = ["doc_id", *carry, "held_out"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    rows = docs.select("doc_id", *carry, held_out().alias("held_out"), *(["text"] if "text" not in carry else []), letters)
    if model is None:
        out = rows.select(*kept).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
        return out.withColumn("spans", F.expr("cast(array() as array<struct<start: long, end: long, lang: string>>)")) if spans else out
    more = ", spans array<struct<start: long, end: long, lang: string>>" if spans else ""
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*kept).dtypes)
    return rows.mapInArrow(_label(model, spans, kept), f"{kinds}, lang_pred string, score double{more}")
