"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCHEMA = "mix_source string, nth int, units int, slot_in_period int, release int, deadline int"


def quantise(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source, at least one, by largest remainders; ties to the smaller name."""
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    units = {s: max(1, int(x)) for s, x in exact.items()}
    short = period - sum(units.values())
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in order[: max(short, 0)]:
        units[s] += 1
    if short < 0:
        # from the largest, ties from the greater name
        rank = {s: i for i, s in enumerate(sorted(units, reverse=True))}
        largest = [(-n, rank[s], s) for s, n in units.items()]
        heapq.heapify(largest)
        for _ in range(-short):
            n, i, s = largest[0]
            units[s] -= 1
            heapq.heapreplace(largest, (n + 1, i, s))
    return units


def pfair_period(units: dict[str, int]) -> list[tuple[str, int, int, int, int, int]]:
    """Earliest deadline first over one period of unit slots: (source, nth block, units, slot, release, deadline).

    Block i of a source with u of H slots is released at floor(i*H/u) and due by ceil((i+1)*H/u). The weights sum to
    one, so every block meets its deadline, each source is never a whole block ahead of or behind its share, and at
    the end of the period all are exactly even: the next period is the same again.
    """
    period = sum(units.values())
    releases: dict[int, list] = {}
    for s in sorted(units):
        for i in range(units[s]):
            release, due = i * period // units[s], -(-(i + 1) * period // units[s])
            releases.setdefault(release, []).append((due, s, i, release))
    ready, out = [], []
    for t in range(period):
        for x in releases.get(t, ()):
            heapq.heappush(ready, x)
        due, s, i, release = heapq.heappop(ready)
        assert t < due, "a deadline was missed"
        out.append((s, i, units[s], t, release, due))
    return out


def tempered(sizes: dict[str, int], temper: float = 0.5) -> dict[str, float]:
    """Target weights: each source's share of the rows to the power `temper`."""
    total = sum(sizes.values())
    return {s: (n / total) ** temper for s, n in sizes.items()}


def rows_of(docs: DataFrame) -> dict[str, int]:
    """Rows of each source; a null source is the source ''."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    return {r["mix_source"]: r["n"] for r in counts.collect()}


def mix_order(
    docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, block_rows: int = 16, period: int = 10_000, rows_per_part: int = 1000, most_sources: int = 100_000
) -> DataFrame:
    """Interleave the sources' blocks: every row of `docs` with mix_source, block, in_block, slot, release, deadline, in_mix.

    A source's rows, in an order of hashes, form blocks of `block_rows`; a block takes one slot. Targets are `weights`
    (of the sources present), or the shares of rows to the power `temper`. The schedule of one period of slots is made
    on the driver, whose size depends on `period` and the number of sources alone (more than most_sources are refused);
    rows find theirs by arithmetic and a join with it. Up to the slot where the first source runs out (in_mix) each source
    has had its weight to within one block in every prefix; the others then go on in their own slots, so no row is dropped.
    `slot` orders blocks, `in_block` the rows of one.

    A source, however large, is numbered in parts of about rows_per_part rows (of a millionth of the table, where that is
    more), by a hash of the whole row; equal rows, which share their hash, are dealt on by row number, from a written table.

    A null source is the source ''. Null or repeated doc_ids and equal rows are kept as rows of their own; texts of any
    length go along unread but for the hash. An empty table gives no rows. Input columns stay, whatever their names; only
    those called like an added column are replaced.
    """
    added = ["mix_source", "block", "in_block", "slot", "release", "deadline", "in_mix"]
    own = [c for c in docs.columns if c not in added]
    sizes = rows_of(docs)
    if not sizes:
        empty = [F.lit(None).cast(t).alias(c) for c, t in zip(added, ("string", "long", "int", "long", "long", "long", "boolean"))]
        return docs.select(*[F.col(f"`{c}`") for c in own], *empty).limit(0)
    if len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    wanted = {s: weights.get(s, 0.0) for s in sizes} if weights else tempered(sizes, temper)
    if not all(w > 0 for w in wanted.values()):
        raise ValueError("every source present needs a weight above 0")
    units = quantise(wanted, max(period, 4 * len(sizes)))
    schedule = pfair_period(units)
    length = len(schedule)
    slots: dict[str, list[int]] = {}
    for s, _, _, t, _, _ in schedule:
        slots.setdefault(s, []).append(t)
    # the slot in which a source with that many blocks would have its next one: no mix past the first of these
    ends = [(nb // units[s]) * length + slots[s][nb % units[s]] for s, n in sizes.items() for nb in [-(-n // block_rows)]]
    plan = docs.sparkSession.createDataFrame(schedule, SCHEMA)

    # the input is one column, so no name of its can clash with those below
    total, kinds = sum(sizes.values()), dict(docs.dtypes)
    spread = min(1_000_000, max(1, -(-total // rows_per_part)))
    key = F.xxhash64(F.lit(10), *[F.col(f"`{c}`") for c in own if "map<" not in kinds[c]])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), key.alias("key"))
    rows = rows.withColumns({"part": F.shiftrightunsigned("key", 40) % F.lit(spread), "more": F.lit(0)})
    counts = materialize(rows.groupBy("mix_source", "part", "more").agg(F.count("*").alias("n")), "mix-counts")
    hot = counts.filter(F.col("n") > 16 * -(-total // spread)).select("mix_source", "part", F.ceil(F.col("n") / (total / spread)).alias("pieces"))
    if not hot.isEmpty():
        numbered = materialize(rows.drop("more").withColumn("number", F.monotonically_increasing_id()), "mix-rows")
        # at most spread / 16 rows
        rows = numbered.join(F.broadcast(hot), ["mix_source", "part"], "left")
        rows = rows.withColumn("more", F.coalesce(F.pmod(F.xxhash64("number"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces", "number")
        counts = materialize(rows.groupBy("mix_source", "part", "more").agg(F.count("*").alias("n")), "mix-counts")

    before = Window.partitionBy("mix_source").orderBy("part", "more").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_source", "part", "more", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("mix_source", "part", "more").orderBy("key")) - 1
    placed = rows.withColumn("at", at).join(starts, ["mix_source", "part", "more"]).withColumn("index", (F.col("start") + F.col("at")).cast("long"))
    placed = placed.join(F.broadcast(docs.sparkSession.createDataFrame(list(units.items()), "mix_source string, units int")), "mix_source")
    placed = placed.withColumn("block", F.floor(F.col("index") / block_rows)).withColumn("in_block", (F.col("index") % block_rows).cast("int"))
    placed = placed.withColumn("nth", (F.col("block") % F.col("units")).cast("int")).withColumn("turn", F.floor(F.col("block") / F.col("units")) * length)
    placed = placed.join(F.broadcast(plan.drop("units")), ["mix_source", "nth"])
    slot = F.col("turn") + F.col("slot_in_period")
    return placed.select(
        "row.*", "mix_source", "block", "in_block", slot.alias("slot"), (F.col("turn") + F.col("release")).alias("release"), (F.col("turn") + F.col("deadline")).alias("deadline"), (slot < min(ends)).alias("in_mix"),
    )
