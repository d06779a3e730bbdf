import base64
import hashlib
import re
import zlib

from panelloom.llm.archive import read_archive, write_archive, write_warc_files

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def pages():
    rows = [(i, f"http://e.org/{i}", f"<p>page {i % 30}</p>\r\n\r\nWARC/1.1\r\né") for i in range(100)]
    return rows + [(200, None, None), (201, "u", ""), (202, "bad\r\nurl", "x" * 100_000), (None, "n", "<p>page 1</p>\r\n\r\nWARC/1.1\r\né"), (None, "n", "alone"), (300, "twice", "same"), (300, "twice", "same")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)


def want(rows, least):
    out = []
    groups: dict[str, list] = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(p)
    for p, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        revisit = len(data) >= least and bool(ids) and p != max(ids)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    for least in (0, 20):
        rows, path = pages(), f"{tmp_path}/{least}"
        write_archive(table(spark, rows), path, revisit_from=least)
        back = read_archive(spark, path).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == want(rows, least)
        assert sorted((str(r.page_id), bytes(r.payload)) for r in back) == sorted((str(p), (h or "").encode()) for p, _, h in rows)
        assert all(r.verified for r in back)
        stored = [r.digest for r in spark.read.parquet(f"{path}/payloads").collect()]
        assert len(stored) == len(set(stored)) == len({h or "" for _, _, h in rows})


def test_altered_payload_is_noticed(spark, tmp_path):
    write_archive(table(spark, pages()), f"{tmp_path}/a")
    payloads = spark.read.parquet(f"{tmp_path}/a/payloads").collect()
    # one altered, one no stream at all, one missing
    broken = [(r.digest, bytearray(zlib.compress(b"other")) if i == 0 else bytearray(b"??") if i == 2 else r.packed) for i, r in enumerate(payloads) if i != 1]
    spark.createDataFrame(broken, "digest string, packed binary").coalesce(1).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    lost = {p.digest for p in payloads[:3]}
    assert {r.digest for r in read_archive(spark, f"{tmp_path}/b").filter("not verified").collect()} == lost


def test_plain_warc_files(spark, tmp_path):
    rows = pages()
    write_archive(table(spark, rows), f"{tmp_path}/a")
    write_warc_files(spark, f"{tmp_path}/a", f"{tmp_path}/warc")
    found = 0
    for part in (tmp_path / "warc").glob("part-*"):
        data = part.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            data, found = rest[n + 4 :], found + 1
    assert found == len(rows)


def test_empty_table(spark, tmp_path):
    write_archive(table(spark, pages()).limit(0), f"{tmp_path}/e")
    assert read_archive(spark, f"{tmp_path}/e").count() == 0
