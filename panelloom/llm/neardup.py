"""MinHash near-dedup: banded signatures, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .components import connected_components
from .words import Words, blocks, mix, slices

#: 32 bands of 4 minima: a pair at 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
LANES = BANDS * ROWS
#: Pairs go on to their full sets if this share of the signature agrees: six standard deviations under 0.8.
MARGIN = 0.8 - 6 * (0.8 * 0.2 / LANES) ** 0.5
#: Documents of a block, two of which are compared with each other in one task, and shingles compared at once in it.
BLOCK_ROWS, COLUMNS = 256, 4096
UPPER = "".join(map(chr, range(65, 91)))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles as 64-bit hashes, text after text and rising in each, and where each text's begin."""
    w = Words(texts, fold=True)
    words = w.hashes()
    at = np.flatnonzero(w.left >= size)
    docs, hashes = [w.doc[at]], [w.windows(size, words=words)[at]]
    for n in range(1, size):
        if len(short := np.flatnonzero(w.counts == n)):
            docs.append(short)
            hashes.append(w.windows(n, words=words)[w.first[short]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def minima(h: np.ndarray, starts: np.ndarray, seed: int = 2) -> np.ndarray:
    """LANES universal hash minima (uint32) of each set that has members; multiply-shift, by odd random multipliers."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
    out = np.empty((len(starts), LANES), np.uint32)
    for k in range(LANES):
        out[:, k] = np.minimum.reduceat((h * a[k] + b[k]) >> np.uint64(32), starts)
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            h, first = shingle_sets(texts, size)
            counts = np.diff(first)
            full = np.flatnonzero(counts)
            low = minima(h, first[full]) if len(full) else np.empty((0, LANES), np.uint32)
            keys = np.full((len(full), BANDS), 0, np.uint64)
            for j in range(ROWS):
                keys = mix(keys ^ low[:, j::ROWS].astype(np.uint64)) + np.arange(BANDS, dtype=np.uint64)
            keys = keys.view(np.int64)
            bands, sigs = [None] * len(texts), [None] * len(texts)
            for n, i in enumerate(full):
                bands[i], sigs[i] = keys[n], low[n].astype(np.uint8).tobytes()
            own = [batch.column(c) for c in ("doc_id", "d1", "d2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "n_shingles", "sig", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            h, first = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h[i:j].tobytes() for i, j in zip(first, first[1:])])], ["doc_id", "set"])

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LANES) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= MARGIN))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a", 1 << 20):
            good = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int(np.isin(x, y, assume_unique=True).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _rivals(x: pd.DataFrame) -> np.ndarray:
    """Which pairs of a task's rows are in different components, are to meet here, and may be linked by their signatures."""
    comp, own = x["component"].to_numpy(), x["own"].to_numpy()
    sig = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(-1, LANES)
    open_ = comp[:, None] != comp[None, :]
    if x["left"].iat[0] != x["right"].iat[0]:
        open_ &= own[:, None] != own[None, :]
    for i in np.flatnonzero(open_.any(axis=1)):
        at = np.flatnonzero(open_[i])
        open_[i, at] = (sig[at] == sig[i]).mean(axis=1) >= MARGIN
    return open_


def _needed(x: pd.DataFrame) -> pd.DataFrame:
    return x.loc[_rivals(x).any(axis=1), ["lead", "left", "right", "doc_id", "component", "own", "sig"]]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles of one set alone are left out; the rest are columns of 0 and 1."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    row, column = row[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        out += part @ part.T
    return out


def _across(percent: int):
    """Links of a task's rows between different components: enough of them to join what belongs together."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("doc_id", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in x["set"]]
        sizes, common = np.array([len(s) for s in sets]), _common(sets)
        linked = _rivals(x) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
        comp, ids = x["component"].to_numpy().copy(), x["doc_id"].to_numpy()
        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(linked))):
            if comp[i] != comp[j]:
                a.append(ids[i])
                b.append(ids[j])
                comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"a": a, "b": b}, dtype=np.int64)

    return run


def _sets_of(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of the wanted doc_ids, from their whole texts; a doc_id of several texts gives a set for each."""
    wanted = wanted.distinct().join(nodes.select("doc_id", "d1", "d2"), "doc_id")
    found = texts.join(wanted, ["doc_id", "d1", "d2"]).select("doc_id", "text").mapInArrow(_sets(size), "doc_id long, set binary")
    return materialize(found, "sets")


def _to_leads(texts: DataFrame, nodes: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between buckets' members and their smallest doc_id, confirmed on signatures, then on full sets."""
    pairs = members.filter("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    sig = nodes.select("doc_id", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"doc_id": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"doc_id": "b", "sig": "sig_b"}), "b")
    likely = materialize(joined.mapInArrow(_agree, "a long, b long").distinct(), "likely-pairs")
    sets = _sets_of(texts, nodes, likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))), size)
    both = likely.join(sets.withColumnsRenamed({"doc_id": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "set": "set_b"}), "b")
    return materialize(both.mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")


def _between_members(texts: DataFrame, nodes: DataFrame, members: DataFrame, components: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between buckets' members that the links to their leads leave in different components.

    Buckets with the same lead are taken together, each document once. Documents outside the lead's component are dealt
    to blocks, and these meet each other and the blocks of those inside, each pair of blocks in a task of its own: the
    rows grow with the number inside times the blocks outside. Tasks return links, never pairs that are none.
    """
    labelled = members.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    leads = members.select("lead").distinct().join(components.withColumnRenamed("node", "lead"), "lead", "left").select("lead", F.coalesce("component", "lead").alias("home"))
    labelled = materialize(labelled.join(materialize(leads, "homes"), "lead").withColumn("out", F.col("component") != F.col("home")), "labelled")
    blocks_of = lambda n: F.ceil(F.sum(n) / BLOCK_ROWS).cast("int")
    counts = labelled.groupBy("lead").agg(blocks_of(F.col("out").cast("int")).alias("outs"), blocks_of((~F.col("out")).cast("int")).alias("ins"))
    # one document outside, and inside none but the lead: they have met
    counts = counts.filter("outs > 0").join(labelled.groupBy("lead").agg(F.count("*").alias("n")).filter("n > 2"), "lead").drop("n")
    block = labelled.join(materialize(counts, "blocks"), "lead")
    own = F.when(F.col("out"), F.pmod(F.xxhash64("doc_id"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("doc_id"), F.greatest("ins", F.lit(1)))).cast("int")
    others = F.when(F.col("out"), F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") - 1))
    block = block.withColumn("own", own).withColumn("other", F.explode(others))
    block = block.select("lead", "doc_id", "component", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    # a doc_id of several texts is one row for each of them, of the same component
    block = block.join(nodes.select("doc_id", "sig"), "doc_id")
    schema = "lead long, left int, right int, doc_id long, component long, own int, sig binary"
    needed = materialize(block.groupBy("lead", "left", "right").applyInPandas(_needed, schema), "rivals")
    sets = _sets_of(texts, nodes, needed.select("doc_id"), size)
    met = needed.join(sets, "doc_id").groupBy("lead", "left", "right").applyInPandas(_across(percent), "a long, b long")
    return materialize(met.distinct(), "links")


def with_digests(rows: DataFrame) -> DataFrame:
    """Adds d1 and d2, two hashes of the text with A-Z lower-cased; null: empty."""
    folded = F.translate(text_or_empty(), UPPER, UPPER.lower())
    return rows.withColumns({"d1": F.xxhash64(folded), "d2": F.xxhash64(F.lit(1), folded)})


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, with_text: bool = False) -> DataFrame:
    """Group documents whose sets of `size`-word shingles have 100 * intersection >= percent * union.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`. A text with fewer words than `size` is one shingle; one
    without words has none and is linked with nothing. Equal texts are one node. Each node's signature has LANES
    universal hash minima; a band of them is a bucket's key. Links are sought between a bucket's members and its smallest
    doc_id, confirmed on the signatures and then on full sets; then between all members that this leaves in different
    components, in blocks of BLOCK_ROWS by BLOCK_ROWS, again on signatures and full sets. So a group that is joined
    through its first document costs as many pairs as it has members, and no bucket meets in one task.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id = component_id); with_text
    adds d1 and d2, two hashes of the folded text. Rows that repeat a doc_id are one document to the components. A row with a
    null doc_id is linked with nothing: its component_id is null and kept is true. Null texts are empty, very long ones
    are hashed whole, in a block of their own; an empty table gives no rows. Other columns are ignored.
    """
    folded = F.translate(F.col("text"), UPPER, UPPER.lower())
    rows = with_digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).withColumn("text", folded)
    table = materialize(rows.mapInArrow(_signatures(size), "doc_id long, d1 long, d2 long, n_shingles long, sig binary, bands array<long>"), "signatures")

    firsts = table.filter("doc_id is not null and n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialize(firsts, "first-texts")
    nodes = materialize(table.join(firsts, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"]), "nodes")

    banded = nodes.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("most"))
    buckets = materialize(buckets.filter("lead < most").select("key", "lead"), "buckets")
    members = materialize(banded.join(buckets, "key").select("lead", "doc_id").distinct(), "members")

    edges = _to_leads(rows, nodes, members, size, percent)
    components = materialize(connected_components(edges), "components")
    more = _between_members(rows, nodes, members, components, size, percent)
    if not more.isEmpty():
        components = materialize(connected_components(edges.unionByName(more)), "components")

    # copies take the component of the first of them; a doc_id of several texts brings their components together
    named = firsts.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("d1", "d2", F.coalesce("component", "doc_id").alias("component"))
    out = table.join(materialize(named, "classes"), ["d1", "d2"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == found, F.lit(True))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), kept.alias("kept"), *(["d1", "d2"] if with_text else []))
