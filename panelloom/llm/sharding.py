"""Sharding by histogram sort, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

_SIGN = -(1 << 63)
FIRST_BITS, NEXT_BITS = 12, 8


@dataclass(frozen=True)
class _Open:
    """An interval of keys that share their first `depth` of 128 bits and hold the boundary for some targets."""

    depth: int
    head: int
    tail: int
    below: int


def sort_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (k1, k2).

    k1 is a hash of the text, so equal texts stand together; k2 holds 48 bits of doc_id's hash and 16 of the row's
    number, so a group of copies, or one row repeated, can still be cut anywhere. A null text counts as empty.
    """
    text = text_or_empty()
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(0xFFFF)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64("doc_id").bitwiseAND(~0xFFFF).bitwiseOR(row).alias("k2"),
    )


def _bits(column: str, n: int):
    """The first n bits of a signed key, in its order."""
    if n == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(_SIGN)), 64 - n)


def _digit_bits(depth: int) -> int:
    width = FIRST_BITS if depth in (0, 64) else NEXT_BITS
    return min(width, 64 - depth % 64)


def _histogram(keys: DataFrame, depth: int, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], list]:
    """Exact bytes of every digit below the wanted prefixes, counted in one pass over all partitions."""
    head, tail = _bits("k1", min(depth, 64)), _bits("k2", max(depth - 64, 0))
    width = _digit_bits(depth)
    digit = (_bits("k1", depth + width) if depth < 64 else _bits("k2", depth - 64 + width)).bitwiseAND((1 << width) - 1)
    rows = keys.select("size", "k1", head.alias("head"), tail.alias("tail"), digit.alias("digit"))
    if depth:
        signed = [h - (1 << 64) if h >= 1 << 63 else h for h in sorted({h for h, _ in wanted})]
        rows = rows.filter(F.col("head").isin(signed))
    if depth > 64:
        rows = rows.filter(F.col("tail").isin(sorted({t for _, t in wanted})))
    found: dict[tuple[int, int], list] = {w: [] for w in wanted}
    counted = rows.groupBy("head", "tail", "digit").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("k1").alias("least"), F.max("k1").alias("most")
    )
    for r in counted.collect():
        if (at := (r["head"] % (1 << 64), r["tail"])) in found:
            found[at].append(r)
    return {k: sorted(v, key=lambda r: r["digit"]) for k, v in found.items()}


def _edge(depth: int, head: int, tail: int, digit: int) -> tuple[int, int] | None:
    """The smallest key of a bin as signed numbers, or None past the last."""
    width = _digit_bits(depth)
    whole = ((head << tail_bits(depth)) | tail) if depth > 64 else head
    value = ((whole << width) + digit) << (128 - depth - width)
    if value >= 1 << 128:
        return None
    return (value >> 64) + _SIGN, (value & ((1 << 64) - 1)) + _SIGN


def tail_bits(depth: int) -> int:
    return max(depth - 64, 0)


def splitters(keys: DataFrame, parts: int, tolerance: float, whole_groups: float = 0.0) -> list[tuple[int, int]]:
    """Keys that cut all bytes into `parts` ranges, each cut within `tolerance` bytes of its target if rows allow.

    Every round counts the bytes below the candidate boundaries of all unsettled intervals, then goes on inside the
    bin that holds a target. A bin of equal texts is not cut if one of its ends is within `whole_groups` bytes of the
    target. A round brings at most parts * 2**NEXT_BITS counters to the driver, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total or parts < 2:
        return []
    pending = {i: _Open(0, 0, 0, 0) for i in range(1, parts)}
    chosen: dict[int, tuple[int, int] | None] = {}
    while pending:
        later: dict[int, _Open] = {}
        for depth in sorted({x.depth for x in pending.values()}):
            mine = {i: x for i, x in pending.items() if x.depth == depth}
            bins = _histogram(keys, depth, {(x.head, x.tail) for x in mine.values()})
            width = _digit_bits(depth)
            for i, x in mine.items():
                target, low = total * i / parts, x.below
                for r in bins[x.head, x.tail]:
                    high = low + r["bytes"]
                    if high >= target:
                        break
                    low = high
                near_low = target - low <= high - target
                of_one_text = depth < 64 and r["least"] == r["most"]
                allowed = max(tolerance, whole_groups) if of_one_text else tolerance
                if min(target - low, high - target) <= allowed or r["n"] == 1 or depth + width == 128:
                    chosen[i] = _edge(depth, x.head, x.tail, r["digit"] + (not near_low))
                elif of_one_text:
                    later[i] = _Open(64, r["least"] - _SIGN, 0, low)
                elif depth < 64:
                    later[i] = _Open(depth + width, (x.head << width) | r["digit"], 0, low)
                else:
                    later[i] = _Open(depth + width, x.head, (x.tail << width) | r["digit"], low)
        pending = later
    return sorted(k for k in chosen.values() if k is not None)


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, whole_groups: float = 0.02, piece_rows: int = 100_000) -> DataFrame:
    """Put rows into shards of near-equal bytes; equal texts stand together.

    Histogram sort: `splitters` finds the boundaries of the shards by exact counts, then the rows are exchanged once. Both
    tolerances are shares of a shard's bytes: a boundary is within `tolerance` of its target, or, where it would cut a group
    of equal texts, at the group's edge if that is within `whole_groups`; only groups too large for that are cut, so they
    stand in a run of shards. A shard's rows are numbered in pieces of about piece_rows rows by a hash of the whole key, so
    pieces grow in number with the table and are even, whatever groups it has.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts are empty ones of size 8; null or repeated
    doc_ids and equal rows are placed like others; a text of any length is one row of its size; an empty table gives no
    rows. Other columns are ignored.
    """
    keys = materialize(sort_keys(docs), "shard-keys")
    told = keys.agg(F.sum("size"), F.count("*")).first()
    mean = (told[0] or 0) / shards
    cuts = splitters(keys, shards, tolerance * mean, whole_groups * mean)
    # cuts in rising order; two may be the same key, which leaves a shard between them empty
    bounds = F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2")) for a, b in cuts])
    shard = F.size(F.filter(bounds, lambda s: s <= F.struct("k1", "k2"))) if cuts else F.lit(0)
    pieces = max(1, -(-(told[1] or 0) // (shards * piece_rows)))
    placed = keys.withColumns({"shard": shard.cast("int"), "piece": F.pmod(F.xxhash64("k1", "k2"), F.lit(pieces)).cast("int")})
    counts = materialize(placed.groupBy("shard", "piece").agg(F.count("*").alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("k1", "k2")) - 1
    slots = placed.withColumn("at", at).join(starts, ["shard", "piece"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
