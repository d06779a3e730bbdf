"""All statistics that a catalogue of many columns needs, by one visit to a month's rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import crosssection as cs, shuffles, wide

_IC = "factor string, at int, month date, ic double"
_KINDS = {"ic": _IC, "tile": wide._TILE, "sums": shuffles.SUMS}
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "date": pa.date32(), "binary": pa.binary()}


def _struct(kind: str) -> pa.StructType:
    return pa.struct([(name, _TYPES[of]) for name, of in (field.split() for field in _KINDS[kind].split(", "))])


def _as_rows(kind: str, columns: dict) -> pa.Table:
    """A row for each of a kind's, the other kinds null."""
    made = pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in _struct(kind)], fields=list(_struct(kind)))
    return pa.table({k: made if k == kind else pa.nulls(len(made), _struct(k)) for k in _KINDS})


def month_catalogue(rows: DataFrame, columns: list[str], targets: dict[str, int], sims: int, least: int = 20, target: str = "fwd_ret_1m", largest: int | None = None) -> DataFrame:
    """ic, tile, sums: one of them in a row. A month's rows cross the network once, as they are; its ranks never do.

    ic: the rank correlation of a column with each of the targets (numbered `at`). tile: sums of products of ranks of all pairs of
    columns (`correlations`). sums: those of the ranks with the target's, in place and dealt anew `sims` times (`shuffles.tested`).
    A task holds a month's cross-section and its ranks; products take blocks of rows.
    """
    largest = shuffles.largest_month(rows.filter(F.col(target).isNotNull())) if largest is None else largest
    ics = cs._target_ics(columns, targets, least)

    def run(table: pa.Table) -> pa.Table:
        month = table.column("month")[0].as_py()
        told = ics(table).to_pydict()
        parts = [_as_rows("ic", told | {"month": [month] * len(told["ic"])})]
        ranks, number = [cs.percent_rank(table, c) for c in columns], month.year * 12 + month.month
        blocks = (np.column_stack([r[a : a + wide.BLOCK] for r in ranks]) for a in range(0, table.num_rows, wide.BLOCK))
        parts.append(_as_rows("tile", wide._gram_tiles(blocks, len(columns), number).to_pydict()))
        sums = shuffles.month_sums(ranks, cs.percent_rank(table, target), table.column("instrument").to_numpy(), table.column("_block").to_numpy(), number, sims)
        if sums is not None:
            parts.append(_as_rows("sums", {"factor": columns, "k": [number] * len(columns)} | {c: v if v.ndim == 1 else [b.tobytes() for b in v] for c, v in sums.items()}))
        return pa.concat_tables(parts)

    kept = wide.with_any(rows, columns).withColumn("_block", shuffles.block_of(largest))
    schema = ", ".join(f"{k} struct<{of.replace(' ', ': ').replace(',: ', ', ')}>" for k, of in _KINDS.items())
    return cs.by_month(kept, list(dict.fromkeys([target, *targets, *columns])), "instrument", "_block").applyInArrow(run, schema)


def of_kind(told: DataFrame, kind: str) -> DataFrame:
    return told.filter(F.col(kind).isNotNull()).select(f"{kind}.*")


def correlations(told: DataFrame, columns: list[str], least: int, flat: float = 0.0) -> DataFrame:
    """a, b, n, rho of every pair of the columns' ranks, over the rows that have both (`wide.rank_correlations`)."""
    return wide._pairs_of(of_kind(told, "tile"), columns, least, flat)
