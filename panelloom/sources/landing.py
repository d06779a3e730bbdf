"""Landed files: wide price blocks, membership lists, nested filing facts, snapshots, and the sinks of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.asof import keep_last

#: The parts of a filings document that are read.
FACTS = "struct<cik: long, facts: map<string, map<string, struct<units: map<string, array<struct<`end`: string, start: string, val: double, filed: string, form: string>>>>>>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def wide_block(block: DataFrame, field: str, date: str = "date") -> DataFrame:
    """A date-by-instrument block in long form: date, instrument, and the field; negative numbers are missing."""
    names = [c for c in block.columns if c != date]
    quoted = [F.col(f"`{c}`") for c in names]
    long = block.select(F.col(date).cast("date").alias("date"), *[q.cast("double").alias(c) for q, c in zip(quoted, names)]).unpivot("date", quoted, "instrument", field)
    return long.withColumn(field, F.when(F.col(field) >= 0, F.col(field))).dropna(subset=[field])


def ohlc(blocks: dict[str, DataFrame]) -> DataFrame:
    """Blocks by field, outer-joined on date and instrument."""
    parts = [wide_block(b, f) for f, b in blocks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["date", "instrument"], "full_outer")
    return out


def membership(rows: DataFrame) -> DataFrame:
    """date, instrument from comma lists of tickers; a -YYYYMM suffix goes, and exchange suffixes too."""
    names = rows.select(F.col("date").cast("date").alias("date"), F.explode(F.split("tickers", ",")).alias("t"))
    name = F.upper(F.trim(F.regexp_replace("t", r"-\d{6}$", "")))
    return names.select("date", name.alias("instrument")).filter("instrument != ''").distinct()


def base_ticker(c: str) -> Column:
    """A ticker without its exchange suffix."""
    return F.upper(F.trim(F.regexp_replace(c, r"\.[A-Z]{1,3}$", "")))


def facts(documents: DataFrame, tags: list[str], units: tuple[str, ...] = ("USD", "USD/shares"), forms: tuple[str, ...] = ("10-K", "10-Q"), flow: bool = False) -> DataFrame:
    """cik, tag, end, filed, val from filing documents (column `json`): the first tag present, the last filing of each period.

    With flow, only periods of 80 to 100 days.
    """
    parsed = documents.select(F.from_json("json", FACTS).alias("d")).select("d.cik", F.col("d.facts").getItem("us-gaap").alias("tags"))
    found = parsed.select("cik", F.posexplode(F.array(*map(F.lit, tags))).alias("order", "tag"), "tags").withColumn("fact", F.col("tags")[F.col("tag")]).filter("fact is not null")
    first = keep_last(found.drop("tags").withColumn("_o", -F.col("order")), ["cik"], ["_o"]).drop("_o")
    rows = first.select("cik", "tag", F.explode(F.col("fact.units")).alias("unit", "values")).filter(F.col("unit").isin(*units)).select("cik", "tag", F.explode("values").alias("v")).select("cik", "tag", "v.*").filter(F.col("form").isin(*forms))
    rows = rows.select("cik", "tag", F.to_date("end").alias("end"), F.to_date("start").alias("start"), F.to_date("filed").alias("filed"), "val")
    if flow:
        rows = rows.filter(F.datediff("end", "start").between(80, 100))
    return keep_last(rows, ["cik", "tag", "end"], ["filed", "val"]).select("cik", "tag", "end", "filed", "val")


def filing_index(landed: DataFrame, forms: list[str], since: str) -> DataFrame:
    """instrument, form, filed of an index landed as JSON with parallel arrays (form, filingDate), of some forms since a day."""
    parsed = landed.select("instrument", F.from_json("json", "form array<string>, filingDate array<string>").alias("j"))
    rows = parsed.select("instrument", F.explode(F.arrays_zip("j.form", "j.filingDate")).alias("x"))
    rows = rows.select("instrument", F.col("x.form").alias("form"), F.to_date("x.filingDate").alias("filed"))
    return rows.filter(F.col("form").isin(*forms) & (F.col("filed") >= F.lit(since).cast("date")))


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by year, so that date ranges prune files."""
    panel.withColumn("year", F.year("month")).write.mode("overwrite").partitionBy("year").parquet(path)


def write_report(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header, for people and spreadsheets."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_fold(scores: DataFrame, path: str, fold: str) -> None:
    """One fold's scores, in a partition of its own, so that a run that stops keeps what it has done and repeats replace it."""
    scores.withColumn("fold", F.lit(fold)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def merge_snapshot(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], out: str) -> None:
    """The table at `path` with new rows, the last of each key, written to `out`: readers of the old one aren't disturbed."""
    keep_last(spark.read.parquet(path).unionByName(new, allowMissingColumns=True), keys, order).write.parquet(out)


def gap_fill(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those new rows whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
