import base64
import hashlib

from pyspark.sql import functions as F

from gridweave.llm import warc
from gridweave.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest string, payload string, keeper string, salt string"
PAGES = [(1, "http://a/", "same"), (2, "http://b/é x", "same"), (3, None, "other é 😀"), (4, "u", None), (5, "u", ""), (6, "u", "same"), (None, "n", "same"), (7, "u", "x" * 300_000), (8, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (9, "u%20v", "9")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA)


def expected(rows):
    keep = {}
    for i, _, t in rows:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if i is None else i)
    out = {}
    for i, _, t in rows:
        b = (t or "").encode()
        first = (-1 if i is None else i) == keep[t or ""]
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else keep[t or ""])
    return out


def read(spark, path, payload=True):
    number = lambda c: F.expr(f"cast(nullif(substr({c}, 10), '') AS bigint)")
    df = warc.read_archive(spark, path, payload)
    return {r["i"]: r for r in df.select("*", number("record_id").alias("i"), number("refers_to").alias("ref")).collect()}


def test_round_trip(spark):
    for compression in ("none", "gzip"):
        path = scratch(spark, "warc-test")
        warc.write_archive(pages(spark), path, compression)
        got = read(spark, path)
        want = expected(PAGES)
        assert {i: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["ref"]) for i, r in got.items()} == want
        for i, u, t in PAGES:
            assert got[i]["payload"] == (None if want[i][2] == "revisit" else bytearray((t or "").encode()))
        assert got[1]["target_uri"] == "http://a/" and got[3]["target_uri"] is None and got[9]["target_uri"] == "u%20v"
        assert got[2]["target_uri"] == "http://b/%C3%A9%20x"


def test_many_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    path = scratch(spark, "warc-test")
    warc.write_archive(pages(spark), path)
    assert {i: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["ref"]) for i, r in read(spark, path).items()} == expected(PAGES)


def test_least_bytes(spark):
    out = warc.page_records(pages(spark), least_bytes=5).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in out} == {"response": len(PAGES)}


def test_predicates_reach_the_reader(spark):
    path = scratch(spark, "warc-test")
    warc.write_archive(pages(spark), path, "none")
    df = warc.read_archive(spark, path)
    assert df.where("record_type = 'revisit'").count() == 4
    assert df.where(F.col("record_type").isin("revisit", "response")).count() == len(PAGES)
    assert df.where("record_id = 'urn:page:3' AND record_type = 'response'").count() == 1
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(reader.equal) == 1 and len(left) == 1
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0] for r in rows} == {"revisit"} and len(rows) == 4


def test_unwanted_payloads_are_not_read(spark, tmp_path):
    """Of a record that no one wants only the headers are read: the file is told to move past the rest."""
    data = warc.encode("response", "urn:page:1", "u", "1970-01-01T00:00:00Z", "D", None, b"x" * 1_000_000) + warc.encode("revisit", "urn:page:2", "u", "1970-01-01T00:00:00Z", "D", "urn:page:1", b"")

    class Counting:
        def __init__(self):
            import io

            self.f, self.seen = io.BytesIO(data), 0

        def readline(self, *a):
            out = self.f.readline(*a)
            self.seen += len(out)
            return out

        def read(self, *a):
            out = self.f.read(*a)
            self.seen += len(out)
            return out

        def seek(self, *a):
            return self.f.seek(*a)

    f = Counting()
    rows = list(warc.records(f, True, lambda h: h["warc-type"] == "revisit", True))
    assert len(rows) == 1 and f.seen < 2000
    f = Counting()
    assert [r[7] for r in warc.records(f, True, lambda h: True, False)] == [1_000_000, 0] and f.seen < 2000


def test_files_are_planned_and_rolled(spark):
    path = scratch(spark, "warc-test")
    warc.register(spark)
    warc.page_records(pages(spark)).coalesce(1).write.format("warc").mode("append").option("filebytes", "1000").save(path)
    n = len(warc.WarcReader({"path": path}).partitions()[0].paths)
    assert n > 1 and len(warc.WarcReader({"path": path, "partitionbytes": "1"}).partitions()) == n
    assert len(read(spark, path)) == len(PAGES)


def test_empty(spark):
    path = scratch(spark, "warc-test")
    warc.write_archive(pages(spark, []), path)
    assert warc.read_archive(spark, path).count() == 0
