"""Spelling variants: words one edit apart, found by asymmetric q-chunks, each grouped under its most frequent form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

#: A maximal run of letters once A-Z are lower-cased.
RUN = r"[a-zÀ-ÿ]+"
UPPER = "".join(map(chr, range(65, 91)))
#: A key with more chunks or grams than these is split by the halves of what it leaves open.
MOST_CHUNKS, MOST_GRAMS = 100, 10_000


def spoken_words(docs: DataFrame, one_in: int = 97) -> DataFrame:
    """Each run of letters of every whole text as a row: word, with A-Z lower-cased, some with one letter left out.

    A run loses the letter at h modulo its length (from 0) where `one_in` divides h, the crc32 of `<doc_id>:<run>`. Null
    texts have no runs, and where doc_id is null no run loses a letter.
    """
    folded = F.translate(text_or_empty(), UPPER, UPPER.lower())
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(folded, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def _halves(start: Column, end: Column) -> Column:
    """The open segments left when the first or the second of two disjoint chunks of [start, end) is held fast."""
    middle = start + F.floor((end - start) / 2).cast("int")
    segment = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    return F.array(segment(middle, end), segment(start, middle))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of what stands outside the open segment [s, e) of a word of `of` letters, seen from both ends of the word."""
    after = F.col("of") - F.col("e")
    fixed = (F.col("word").substr(F.lit(1), F.col("s")), F.col("word").substr(F.char_length("word") - after + 1, after))
    return rows.withColumn("key", F.xxhash64("of", "s", "e", *fixed))


def _opened(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    rows = rows.withColumn("seg", F.explode(_halves(start, end)))
    return _keyed(rows.select("word", "n", "of", F.col("seg.s").alias("s"), F.col("seg.e").alias("e")))


def _met(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs of different words that share a key and are one edit apart, each word with its n; a pair may come twice."""
    a, b = (x.select("key", F.col("word").alias(w), F.col("n").alias(f"n_{w}")) for x, w in ((chunks, "a"), (grams, "b")))
    # of words of equal length, the smaller brings the chunks
    once = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    return a.join(b, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).drop("key")


def near_words(words: DataFrame, most_chunks: int = MOST_CHUNKS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """All pairs (a, b, with n_a, n_b) of words that one inserted, deleted or replaced letter turns into each other, each once.

    words: word (distinct) and n. Of a pair the shorter word, or of equally long ones the smaller, brings two disjoint
    chunks, its halves; the other brings its positional grams. One edit preserves a chunk: with a replaced letter a half
    stands in the other word at the same place, with an inserted one the first half does, or the second stands one place
    on. So of all positional grams only those at shift 0, and at shift one for the second half of a shorter word, can meet
    a chunk, and only these are exchanged. What meets is verified by its edit distance.

    A half shared by many words (more than most_chunks chunks, or most_grams grams) doesn't meet as such: the edit lies in
    the other half, which has two chunks of its own, so these words meet under both halves of it, and so on. An open
    segment of one letter is the end of it: no more words than letters share what is around it. So the pairs compared are at
    most most_chunks (or the alphabet) for each gram, whatever words share, and none is lost.
    """
    size = F.char_length("word")
    least = words.agg(F.min(size)).first()[0] or 0
    chunks = _opened(words.withColumn("of", size), F.lit(0), F.col("of"))
    grams = words.withColumn("of", F.explode(F.array(size, size - 1))).filter(F.col("of") >= least)
    grams = _opened(grams, F.lit(0), F.col("of"))
    found, tables = None, []
    while True:
        tables += [chunks := materialize(chunks, "chunks"), grams := materialize(grams, "grams")]
        sides = chunks.select("key", (F.col("e") - F.col("s")).alias("open"), F.lit(1).alias("c"), F.lit(0).alias("g"))
        sides = sides.unionByName(grams.select("key", (F.col("e") - F.col("s")).alias("open"), F.lit(0).alias("c"), F.lit(1).alias("g")))
        many = sides.groupBy("key").agg(F.max("open").alias("open"), F.sum("c").alias("c"), F.sum("g").alias("g"))
        many = many.filter(F.col("open") > 1).filter((F.col("c") > most_chunks) | (F.col("c") > 0) & (F.col("g") > most_grams)).select("key")
        tables.append(many := materialize(many, "shared-halves"))
        last = many.isEmpty()
        met = _met(chunks, grams) if last else _met(chunks.join(many, "key", "left_anti"), grams.join(many, "key", "left_anti"))
        found = met if found is None else found.unionByName(met)
        if last:
            break
        chunks, grams = (_opened(x.join(many, "key", "left_semi"), F.col("s"), F.col("e")) for x in (chunks, grams))
    pairs = materialize(found.distinct(), "near-words")
    discard(*tables)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's way along forms, which pointer doubling halves every round.

    Each step at least doubles n, so there are no circles, and as many rounds as log2(log2(largest n)) do.
    """
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = at.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        before, at = at, materialize(moved, "roots")
        discard(before)
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 5, at_least: int = 3, ratio: int = 2, one_in: int = 97) -> DataFrame:
    """Group the words of a corpus by spelling: word, n, n_near, form, form_n, root.

    Words are those of `spoken_words` over all whole texts with `shortest` letters or more and `at_least` occurrences (n).
    n_near counts the words one edit apart. A word's form is the most frequent of them (ties: the first in code-point order),
    if it is at least `ratio` times as frequent, else null; root is where forms lead in the end, the word itself if nowhere.

    Occurrences are counted with partial aggregation, so a very frequent word is one row a task. Rows that repeat a doc_id
    or are equal count each. Null texts and texts without letters have no words, an empty table none. Very long texts are
    read whole, very long runs are words like others. Other columns are ignored.
    """
    counted = spoken_words(docs, one_in).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(counted.filter(F.col("n") >= at_least), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    told = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    told = told.select("word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    told = materialize(told, "forms")
    told = told.join(_roots(told.filter("form is not null")), "word", "left")
    out = words.join(told, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def oracle() -> str:
    """The same by brute force for DuckDB: crc32 bit by bit, every pair of words of like length."""
    # DuckDB's distance is one of bytes: letters beyond ASCII become single bytes that no word has
    wide = "".join(map(chr, range(0xC0, 0x100)))
    spare = "".join(c for c in map(chr, range(33, 127)) if c != "'" and not c.islower())[: len(wide)]
    byte = "list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, {0}::bigint)"
    return f"""
with recursive step as (select list({byte.format("i")} order by i) as t from range(256) r(i)),
run as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]+')) as w from documents),
one as (select doc_id, w, count(*) as k from run where length(w) >= 5 group by all),
crc as (select doc_id, w, k, xor(4294967295, list_reduce(list_transform(range(1, octet_length(b) + 1), lambda i: (('0x' || substr(hex(b), 2 * i - 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint)) as h from (select *, encode(doc_id || ':' || w) as b from one), step),
word as (select case when h % 97 = 0 then w[: h % length(w)] || w[h % length(w) + 2 :] else w end as word, sum(k)::bigint as n from crc group by 1 having sum(k) >= 3),
v as (select *, translate(word, '{wide}', '{spare}') as x from word where length(word) >= 5),
near as (select a.word, a.n, b.word as near, b.n as near_n from v a join v b on abs(length(a.word) - length(b.word)) <= 1 and levenshtein(a.x, b.x) = 1),
best as (select word, count(*) as n_near, first(near order by near_n desc, encode(near)) as form, max(near_n) as form_n, max(near_n) >= 2 * any_value(n) as taken from near group by word),
told as (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when taken then form end as form, case when taken then form_n end as form_n from v left join best using (word)),
way as (select word, word as root from told union all select way.word, t.form from way join told t on t.word = way.root where t.form is not null)
select told.*, root from told join (select way.word, way.root from way join told t on t.word = way.root where t.form is null) using (word)"""
