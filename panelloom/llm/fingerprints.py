"""Document fingerprints: a canonical exact digest, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty


#: The result columns beside doc_id.
RESULTS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def canonical(text: Column) -> Column:
    """Canonical composition (NFC), full case folding, and every run of white space as one space, none at the ends; null: empty."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def wide_hash(text: Column, lanes: int = 2) -> Column:
    """64 bits of xxhash from each lane's own seed, as lowercase hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), text)), 16, "0") for i in range(lanes)]))


def _digests(told):
    """Adds the result columns to rows with text, hash, next_text and next_hash.

    A canonical form is a column before it is hashed, so that it is made once, not once for each lane.
    """

    def add(rows: DataFrame) -> DataFrame:
        n = F.char_length("text")
        kept = F.col("text").substr(F.lit(1), (n - F.floor(n / 3)).cast("int"))
        rows = rows.withColumn("_edited", F.concat(kept, F.col("next_text").substr(F.lit(1), F.floor(n / 3).cast("int"))))
        rows = rows.withColumn("_canon", canonical(F.col("_edited"))).withColumn("_edited_hash", wide_hash(F.col("_canon")))
        rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("_edited", 256)})
        for name, hash_, text in (("fingerprint", "hash", "text"), ("edited_fingerprint", "_edited_hash", "_edited"), ("_next", "next_hash", "next_text")):
            rows = told(rows, name, hash_, text)
        same = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), canonical(F.col("text")) == F.col("_canon")).otherwise(False)
        return rows.withColumns({"near_edited": same.cast("double"), "near_next": (F.col("fingerprint") == F.col("_next")).cast("double")})

    return add


def in_ranges(rows: DataFrame, rows_per_range: int = 2000, most_ranges: int = 200_000, ways: int = 64) -> DataFrame:
    """Adds _part, whose order is that of the rows: by falling doc_id, nulls last, equal ones by a hash of their text.

    Ids are cut at their quantiles, by at most `ways` at a time: the table's into coarse ranges, each of these by its own, and so
    on, in as many rounds as give a range about its share of rows, wherever the ids lie. The cuts are a table of a row for each range
    of the round before (4,096 rows at 200,000 ranges). An id, or null, with more rows than a share is left out of the quantiles; a
    range is cut before and after it, and its own rows are cut by the hash. Past most_ranges ranges they grow with the table, to 50,000 rows at 10**10.
    """
    n = rows.count()
    share = max(rows_per_range, -(-n // most_ranges))
    left = max(1, -(-n // share))
    # ids of more rows than a share: no more of them than ranges
    hot = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(F.col("doc_id").alias("_id"), F.ceil(F.col("_n") / share).alias("_pieces"))
    hot = materialize(hot, "repeated-ids")
    rows = rows.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    rows = rows.withColumn("_b", F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long")))
    while left > 1:
        k = min(ways, left)
        left = -(-left // k)
        cuts = rows.filter("doc_id is not null and _pieces is null").groupBy("_b").agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(1000, 16 * ways)).alias("_cuts"))
        # at most one row for each range so far
        rows = rows.join(F.broadcast(materialize(cuts, "range-cuts")), "_b", "left")
        above = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c > F.col("doc_id")))).otherwise(0)
        rows = rows.withColumn("_b", F.col("_b") * k + above).drop("_cuts")
    rows = rows.withColumn("_b", F.coalesce("_b", F.lit(1 << 40)))
    if hot.isEmpty():
        return rows.withColumn("_part", F.struct("_b", F.lit(0).cast("long").alias("_s"), F.lit(0).cast("long").alias("_t"))).drop("_b", "_pieces")
    within = materialize(rows.filter("_pieces is not null").groupBy("_b").agg(F.collect_set("doc_id").alias("_hot")), "repeated-ids")
    rows = rows.join(F.broadcast(within), "_b", "left")
    # before, at and after each repeated id
    side = F.when(F.col("_hot").isNull(), 0).otherwise(2 * F.size(F.filter("_hot", lambda h: h > F.col("doc_id"))) + F.col("_pieces").isNotNull().cast("int"))
    by_hash = F.coalesce(F.floor((F.xxhash64("text") / float(1 << 64) + 0.5) * F.col("_pieces")), F.lit(0))
    return rows.withColumn("_part", F.struct("_b", side.cast("long").alias("_s"), by_hash.cast("long").alias("_t"))).drop("_b", "_hot", "_pieces")


def _with_next(rows: DataFrame, add, columns: list[str], rows_per_range: int = 2000) -> DataFrame:
    """doc_id and `columns` of each row, which `add` makes of doc_id, text, hash, next_text and next_hash.

    The next row is that of the next smaller doc_id; after the last comes the first. Rows are exchanged once, into
    ranges of doc_id that grow in number with the table; only the first text of each range goes to the range before.
    Null doc_ids come last; equal ones are ordered by a hash of their text.
    """
    within = Window.partitionBy("_part").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    lead = F.lead(F.struct("text", "hash")).over(within)
    rows = in_ranges(rows, rows_per_range)
    rows = rows.select("*", lead.alias("_lead"), (F.row_number().over(within) == 1).alias("_first"))
    rows = rows.withColumns({"next_text": F.col("_lead.text"), "next_hash": F.col("_lead.hash"), "_last": F.col("_lead").isNull()})
    # a range's first and last rows keep their texts, to be joined with their neighbours'
    own = F.when(F.col("_first") | F.col("_last"), F.struct("text", "hash")).alias("_own")
    done = materialize(add(rows).select("doc_id", *columns, "_part", "_first", "_last", own), "next-docs")
    heads = done.filter("_first").select("_part", F.col("_own").alias("_head"))
    # which range follows which: three integers a range
    present = heads.select("_part").withColumn("_of", F.lead("_part").over(Window.orderBy("_part")))
    start = heads.agg(F.min("_part")).first()[0] or (0, 0, 0)
    start = F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(start, ("_b", "_s", "_t"))])
    follows = present.select("_part", F.coalesce("_of", start).alias("_of"))
    nexts = follows.join(heads.withColumnRenamed("_part", "_of"), "_of").select("_part", "_head")
    ends = done.filter("_last").select("doc_id", "_own.text", "_own.hash", "_part").join(nexts, "_part")
    ends = add(ends.withColumns({"next_text": F.col("_head.text"), "next_hash": F.col("_head.hash")})).select("doc_id", *columns)
    return done.filter("not _last").drop("_part", "_first", "_last", "_own").unionByName(ends)


def _picked(rows: DataFrame, by: str, keys: DataFrame, words: int) -> DataFrame:
    """rows whose column `by`, a hash of 64 bits, is among the keys' (or shares its bit with one of them).

    The keys are 64 bits for each of `words` values: a broadcast of at most that many rows, whatever their number, and no key
    meets its rows in one task.
    """
    word, bit = F.pmod(F.col(by), F.lit(words)), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({by}, 32), 64) as int))")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word").filter(bit.bitwiseAND(F.col("_bits")) != 0).drop("_word", "_bits")


def clashes(rows: DataFrame, lanes: int = 2, words: int = 1 << 17) -> DataFrame:
    """Hashes whose bucket holds different canonical bytes. rows: text, hash.

    Only texts whose hash occurs twice are compared. They are picked by their hashes, and then by hashes of the raw text, so no
    other canonical form is made for it; both picks let a few more texts through, never less. The least and greatest canonical
    text of a bucket are compared byte by byte; partial aggregation keeps both, so that a bucket of copies costs two texts a
    task.
    """
    told = materialize(rows.select(F.xxhash64("hash").alias("_key"), "hash", F.xxhash64("text").alias("_raw")), "canonical-hashes")
    again = told.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("hash").alias("_key"))
    raw = _picked(told, "_key", again, words).select("_raw")
    picked = _picked(rows.select("text", F.xxhash64("text").alias("_raw")), "_raw", raw, words)
    picked = picked.withColumn("canon", canonical(F.col("text"))).select("canon", wide_hash(F.col("canon"), lanes).alias("hash"))
    bounds = picked.groupBy("hash").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return bounds.filter("least != most").select("hash")


def hashed(docs: DataFrame, lanes: int = 2) -> DataFrame:
    """doc_id, text (null: empty) and the wide hash of its canonical form."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("_own", canonical(F.col("text"))).withColumn("hash", wide_hash(F.col("_own"), lanes)).drop("_own")


def _told_apart(rows: DataFrame, lanes: int = 2):
    """A function that adds a fingerprint to rows: the hash, and 512 bits of SHA-2 where the hash stands for several texts."""
    found = materialize(clashes(rows, lanes), "clashes")
    if found.isEmpty():
        return lambda df, name, hash_, text: df.withColumn(name, F.col(hash_))
    marked = found.select(F.col("hash").alias("_hash"), F.lit(True).alias("_clash"))

    def add(df: DataFrame, name: str, hash_: str, text: str) -> DataFrame:
        both = df.join(marked, F.col(hash_) == F.col("_hash"), "left")
        return both.withColumn(name, F.when(F.col("_clash"), F.concat(hash_, F.sha2(canonical(F.col(text)), 512))).otherwise(F.col(hash_))).drop("_hash", "_clash")

    return add


def fingerprint(docs: DataFrame, lanes: int = 2) -> DataFrame:
    """Each row's doc_id and fingerprint. Equal fingerprints have equal canonical bytes, and the other way round."""
    rows = hashed(docs, lanes)
    return _told_apart(rows, lanes)(rows, "fingerprint", "hash", "text").select("doc_id", "fingerprint")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how like they are.

    The edited text has the last floor(n_chars/3) code points replaced by the first as many of the next document. The
    likeness of two fingerprints is 1.0 if they are equal, else 0.0: this digest tells equal canonical texts only.

    A null text counts as empty. Rows with equal or null doc_id are kept as rows. A single row is its own next one.
    An empty table gives no rows; other columns are ignored. Texts that differ only in case, white space or the
    composition of accents share a fingerprint. A very long text is one value, hashed whole.
    """
    rows = hashed(docs)
    return _with_next(rows, _digests(_told_apart(rows)), RESULTS)
