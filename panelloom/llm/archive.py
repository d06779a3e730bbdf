"""A content-addressed WARC archive."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

CRLF = "\r\n"
#: The alphabet of base 32 (RFC 4648) and the revisit profile of WARC 1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex_digest: Column) -> Column:
    """40 hex digits as 32 base-32 letters: every 5 digits are 20 bits, or 4 letters."""
    letters = []
    for i in range(8):
        group = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(group, shift).bitwiseAND(31) + 1
            letters.append(F.lit(BASE32).substr(at, F.lit(1)))
    return F.concat(*letters)


def digest_of(payload: Column) -> Column:
    """The address of a payload: SHA-256 and length, in hex."""
    return F.concat(F.sha2(payload, 256), F.lit("-"), F.octet_length(payload))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads as zlib streams, so that exchanges and files carry less."""
    for batch in slices(batches, "payload", 1 << 20):
        packed = pa.array([zlib.compress(x, 1) for x in batch.column("payload").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("digest"), packed], ["digest", "packed"])


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `pages` (page_id, url, html) as two tables under `path`: payloads and headers.

    payloads has the bytes of each distinct payload once, as a zlib stream, under its digest. headers has each record's exact
    WARC header block and the digest. Of records with equal payloads of at least `revisit_from` bytes, that with the largest
    page_id is a response and the others are revisits; all smaller ones are responses.

    A null html is an empty payload, a null url an empty target. Rows with a null page_id are records too: a revisit if
    their payload has a response with an id. Repeated rows of the largest page_id are all responses. Payloads of any length
    are one value each; an empty table gives empty tables, and other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", digest_of(F.col("payload")))
    # copies are pre-aggregated to a small row each: the digest and its response
    kept = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    kept.write.parquet(f"{path}/responses")
    kept = pages.sparkSession.read.schema(kept.schema).parquet(f"{path}/responses")
    # a payload is exchanged once, packed: each task brings one copy of those it holds
    stored = rows.select("digest", "payload").mapInArrow(_packed, "digest string, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    stored.write.option("compression", "none").parquet(f"{path}/payloads")

    light = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"), base32_of_sha1(F.sha1("payload")).alias("sha1"))
    told = light.join(kept, "digest")
    revisit = (F.col("length") >= revisit_from) & F.coalesce(F.col("page_id") != F.col("response_id"), F.col("response_id").isNotNull())
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    one_line = F.regexp_replace("url", r"[\r\n]", "")
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Target-URI", one_line),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("response_id"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("length")).cast("string")),
        F.lit(CRLF),
    )
    told.select(header.cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("_header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def _rebuilt(payload: bool):
    """Unpack each record's payload, and say whether it has its address, its header's digest and its header's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 20):
            sizes, good, bodies = [], [], []
            for packed, digest, sha1, kind, length in zip(*(batch.column(c).to_pylist() for c in ("packed", "digest", "_sha1", "record_type", "content_length"))):
                try:
                    body = None if packed is None else zlib.decompress(packed)
                except zlib.error:
                    body = None
                bodies.append(body)
                sizes.append(None if body is None else len(body))
                intact = body is not None and f"{hashlib.sha256(body).hexdigest()}-{len(body)}" == digest
                good.append(intact and hashlib.sha1(body).hexdigest() == sha1 and (kind == "revisit" or length == len(body)))
            keep = [c for c in batch.schema.names if c not in ("packed", "_sha1")]
            out, names = [batch.column(c) for c in keep], [*keep, "payload_bytes", "verified"]
            out += [pa.array(sizes, pa.int64()), pa.array(good, pa.bool_())]
            if payload:
                out.append(pa.array(bodies, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def sha1_of_base32(letters: Column) -> Column:
    """32 base-32 letters as 40 hex digits, by way of their bits."""
    bits = F.transform(F.split(letters, ""), lambda c: F.lpad(F.conv((F.instr(F.lit(BASE32), c) - 1).cast("string"), 10, 2), 5, "0"))
    whole = F.array_join(bits, "")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lpad(F.conv(F.substring(whole, i * 16 + 1, F.lit(16)), 2, 16), 4, "0")), ""))


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Reconstruct the records: header fields parsed from the stored blocks, joined with the payloads by digest.

    Every record's payload is unpacked and hashed again, and must have its address, its header's payload digest and, for a
    response, its header's length; a record whose payload is missing or altered has verified = false. With payload=False all
    that is done, but the result doesn't carry the bytes on.
    """
    heads = spark.read.parquet(f"{path}/headers").withColumn("_header", F.decode("header", "UTF-8"))
    ids = {n: F.regexp_extract(_field(f), r"<urn:page:(\d+|-\d+)>", 1) for n, f in (("page_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"))}
    heads = heads.select(
        "digest", "header", *[F.nullif(v, F.lit("")).cast("long").alias(k) for k, v in ids.items()], _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"sha1:(\w+)", 1).alias("payload_digest"), _field("Content-Length").cast("long").alias("content_length"),
    )
    whole = heads.join(spark.read.parquet(f"{path}/payloads"), "digest", "left").withColumn("_sha1", sha1_of_base32(F.col("payload_digest")))
    kinds = ", ".join(f"{c} {kind}" for c, kind in whole.drop("packed", "_sha1").dtypes)
    return whole.mapInArrow(_rebuilt(payload), f"{kinds}, payload_bytes long, verified boolean" + ", payload binary" * payload)


def write_warc_files(spark: SparkSession, path: str, out: str) -> None:
    """Write the archive's records as plain WARC files. A record ends with two line ends, here the lines' separator."""
    records = read_archive(spark, path)
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat(F.decode("header", "UTF-8"), block).alias("value")).write.option("lineSep", CRLF * 2).text(out)
