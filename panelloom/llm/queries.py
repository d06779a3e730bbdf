"""The registered queries of the corpus operators, over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import archive, common, fingerprints, langid, licenses, lines, mixing, neardup, negatives, neighbours, packing, sharding, spelling, substrings


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(common.read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.read(spark, sf_dir, "documents"), size=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(common.read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), tokenizer_path())


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.read(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/panelloom/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive.write_archive(common.read(spark, sf_dir, "pages"), path)
    records = archive.read_archive(spark, path, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(common.read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_order(docs).drop("mix_source")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.read(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(common.read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(common.read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_near_dedup, op3_language_id, op4_sharding, op5_packing, op6_nearest, op7_warc, op8_licenses, op9_fingerprints, op10_mixing,
        op11_spelling, op12_line_dedup, op13_hard_negatives,
    )
}
_UPPER = "".join(map(chr, range(65, 91)))
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op6_nearest": neighbours.oracle(),
    "op8_licenses": licenses.oracle(),
    "op11_spelling": spelling.oracle(),
    "op12_line_dedup": lines.oracle(),
    "op13_hard_negatives": negatives.oracle(),
    # every window of every document against the first document that has it
    "op1_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) as s from (select *, unnest(range(1, len(w) - 48)) as i from d)),
hit as (select doc_id, i from (select *, min(doc_id) over (partition by s) as least from win) where least < doc_id),
gone as (select distinct doc_id, i + k as i from hit cross join (select unnest(range(50)) as k)),
word as (select doc_id, i, w[i] as x from (select *, unnest(range(1, len(w) + 1)) as i from d)),
kept as (select doc_id, count(*) filter (where g.i is not null) as n_removed, string_agg(x, ' ' order by word.i) filter (where g.i is null) as t from word left join gone g using (doc_id, i) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    # all pairs that share a shingle, and all that can be reached
    "op2_near_dedup": f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORDS}) as w from documents),
sh as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as s from (select *, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
link as (select a.doc_id as a, b.doc_id as b from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(b) as component_id, d.doc_id = min(b) as kept from d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""",
    "op7_warc": f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as best from pages),
g as (select *, list_transform(range(8), lambda i: ('0x' || h[5 * i + 1 : 5 * i + 5])::int) as v from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: ('{archive.BASE32}')[((v[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1]), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to, true as verified from g""",
}
