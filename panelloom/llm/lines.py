"""Line dedup by levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
UPPER = "".join(map(chr, range(65, 91)))
HASH = ("h1", "h2")
#: Lines of a batch for each bucket of a run.
LINES_PER_BUCKET = 1_000_000
#: A key with this share of all lines or more is joined by broadcast: as many keys at most as one over it.
HOT_SHARE = 1 / 4096


def line_keys(lines: Column) -> Column:
    """Each line without `[\\x20\\x09-\\x0D]` at its ends; lines whose A-Z are to be lower-cased come so."""
    return F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))


class LineRuns:
    """Sorted runs of line hashes in levels: (h1, h2, docs), docs being the documents of a run's batches that hold the line.

    A run is a bucketed table in the shared folder, sorted by hash in each bucket, so a batch of as many buckets is merged
    with it without moving the run. `add` takes a batch's keys, merge-anti-joins them with those that the runs know to be
    common (in `common` documents or more of a run), which need no more counting, and adds the rest as a run of level 0.
    Where a level has `fanout` runs, they are compacted to one of the next level, so there are few runs, and a key is written as often
    as there are levels. With common=1, every line seen before is taken out of the batch: `add` returns the new ones.
    """

    def __init__(self, spark: SparkSession, common: int = 10, fanout: int = 2, buckets: int = 32):
        self.spark, self.common, self.fanout, self.buckets = spark, common, fanout, buckets
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out._written_at, out._name = path, name
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        # as plain files: Spark 4.1 takes a union of bucketed tables for dealt by bucket even where it reads them otherwise
        rows = self.spark.read.schema(runs[0].schema).parquet(*[run._written_at for run in runs])
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Count a batch's keys (h1, h2, a row for each document with the line); the run of those not common before."""
        batch = keys.groupBy(*HASH).agg(F.count("*").alias("docs")).repartition(self.buckets, *HASH)
        for run in self.runs():
            # an outer join, as Spark would move an anti-join below the count, where a frequent line's rows would meet in one task
            known = run.filter(F.col("docs") >= self.common).select(*HASH, F.lit(True).alias("known")).hint("merge")
            batch = batch.join(known, list(HASH), "left").filter("known is null").drop("known")
        run = self._write(batch)
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return run
            full, self.levels[level] = self.levels[level], []
            run = self._write(self._merged(full))
            self.drop(full)
            level += 1

    def totals(self) -> DataFrame:
        """Every key of the runs with its documents, counted until it was known to be common."""
        return self._merged(self.runs())

    def drop(self, runs: list[DataFrame] | None = None) -> None:
        for run in self.runs() if runs is None else runs:
            self.spark.sql(f"drop table if exists {run._name}")
            discard(run)


def _told(docs: DataFrame) -> DataFrame:
    """doc_id, the text, and two hashes of it: what tells a row; equal rows share it and their result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), F.col("text"))})


def _occurrences(rows: DataFrame, batches: int, least: int) -> DataFrame:
    """A row for each line with a key of `least` code points: batch, doc_id, d1, d2, pos, h1, h2, first (of equal ones in its document).

    A document's lines are sorted by hash within its row, so that equal ones are neighbours.
    """
    keys = line_keys(F.split(F.translate("text", UPPER, UPPER.lower()), "\n"))
    rows = rows.select("doc_id", "d1", "d2", F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"), (F.char_length(k) >= least).alias("ok"))).alias("lines"))
    rows = rows.withColumn("lines", F.sort_array(F.filter("lines", lambda x: x["ok"])))
    before = F.concat(F.expr("array(cast(null as bigint))"), F.col("lines.h1")), F.concat(F.expr("array(cast(null as bigint))"), F.col("lines.h2"))
    rows = rows.select("doc_id", "d1", "d2", F.explode(F.arrays_zip(F.col("lines"), before[0].alias("p1"), before[1].alias("p2"))).alias("x")).filter("x.lines is not null")
    first = ~(F.col("x.lines.h1").eqNullSafe(F.col("x.p1")) & F.col("x.lines.h2").eqNullSafe(F.col("x.p2")))
    batch = F.pmod(F.xxhash64(F.lit(12), "d1", "doc_id"), F.lit(batches)).cast("int")
    return rows.select(batch.alias("batch"), "doc_id", "d1", "d2", F.col("x.lines.pos").alias("pos"), F.col("x.lines.h1").alias("h1"), F.col("x.lines.h2").alias("h2"), first.alias("first"))


def _dropped(lines: DataFrame, totals: DataFrame, n: int, min_docs: int) -> DataFrame:
    """The lines whose key is in min_docs documents. Keys of many lines are joined by broadcast, so none gathers its lines in a task."""
    common = materialize(totals.filter(F.col("docs") >= min_docs), "common-lines")
    hot = common.filter(F.col("docs") >= max(1.0, n * HOT_SHARE)).select(*HASH, F.lit(True).alias("hot"))
    rows = lines.join(F.broadcast(hot), list(HASH), "left")
    rest = rows.filter("hot is null").join(common.filter(F.col("docs") < max(1.0, n * HOT_SHARE)).select(*HASH), list(HASH))
    own = ["doc_id", "d1", "d2", "pos"]
    return rows.filter("hot").select(*own).unionByName(rest.select(*own))


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = 4, fanout: int = 2, keep_text: bool = False) -> DataFrame:
    """Drop the lines that stand in min_docs documents or more, in all of them: doc_id, n_lines, n_dropped, kept_sha256 and, with keep_text, kept.

    A line ends at \\n; a null or empty text is one empty line. A line's key is the line without `[\\x20\\x09-\\x0D]` at its
    ends, A-Z lower-cased; lines with keys of fewer than `least` code points stay. Keys are told by 128 bits of xxhash (at
    10**12 different lines two would share them with probability 2e-15). Each document is of one of `batches` batches, by hash;
    these go through the levelled runs of LineRuns one after the other, and the sums over the runs left tell which are common. The lines
    of a key that was common early are not counted again, but dropped like all.

    A row is a document, whether or not its doc_id is null or repeated, and of equal rows each counts. Kept lines are joined by
    \\n. Very long texts and very many lines of one document are sorted within its row. An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = _told(docs)
    staged = new_path(spark, "lines")
    _occurrences(rows, batches, least).write.partitionBy("batch").option("compression", "zstd").parquet(staged)
    lines = spark.read.schema("doc_id long, d1 long, d2 long, pos int, h1 long, h2 long, first boolean, batch int").parquet(staged)
    n = lines.count()
    # with as many buckets as a shuffle has partitions, a batch is exchanged once for its counts and its run
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (batches * LINES_PER_BUCKET)))
    runs = LineRuns(spark, min_docs, fanout, buckets)
    for b in range(batches):
        runs.add(lines.filter((F.col("batch") == b) & F.col("first")).select(*HASH))
    gone = _dropped(lines.drop("batch", "first"), runs.totals(), n, min_docs)
    # the places of equal rows are the same
    gone = materialize(gone.groupBy("doc_id", "d1", "d2").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "dropped-lines")
    runs.drop()
    told = rows.join(gone.withColumnRenamed("doc_id", "_id"), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["d1"] == gone["d1"]) & (rows["d2"] == gone["d2"]), "left")
    # a run of kept lines before each dropped one; what comes after the last has no mark
    gaps = F.zip_with("gone", F.concat(F.array(F.lit(-1)), F.slice("gone", F.lit(1), F.greatest(F.size("gone") - 1, F.lit(0)))), lambda x, y: x - y - 1)
    marks = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    lines = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), marks.alias("kept")), lambda x: F.coalesce(x["kept"], F.lit(True)))
    # only texts that lose a line are taken apart
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    told = told.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if keep_text else []))


def oracle(min_docs: int = 10) -> str:
    """DuckDB SQL for dedup_lines over documents."""
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as x, unnest(range(len(lines))) as i from d),
k as (select *, translate(trim(x, {space}), '{UPPER}', '{UPPER.lower()}') as key from l),
c as (select key from k where key <> '' group by key having count(distinct r) >= {min_docs}),
m as (select k.*, c.key is not null as gone from k left join c using (key))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by r"""
