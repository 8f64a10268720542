"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans partitions over files, takes record types and header equalities as pushed
filters, parses a record's headers before anything else, and seeks past payloads that no one wants: those of records
that a filter drops, and all of them where ``payload`` is ``false``. ``df.write.format("warc")`` writes files of bounded
size, whole or not at all. Paths are local or any that Arrow's filesystems open.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import BROADCAST_ROWS, materialize, scratch, table, text_of

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: What a reader returns; ``headers`` has every named field of the record, names in lower case.
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_length bigint, payload_bytes bigint, headers map<string,string>, payload binary"
#: What a writer takes, in this order; ``digest`` is bare upper-case base32.
WRITES = ("record_type", "record_id", "target_uri", "date", "digest", "refers_to", "payload")
NAMED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILE_BYTES = 128 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def encode(record_type: str, record_id: str, target_uri: str | None, date: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record. Characters that a URI can't have are percent-encoded. Its block is an HTTP response; a revisit has the response's head only, whose length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if target_uri:
        fields.append(("WARC-Target-URI", quote(target_uri, safe="!#$%&'()*+,/:;=?@[]~")))
    if record_type == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + END


class _Gzip(io.RawIOBase):
    """Members of a gzip file one after another as one stream."""

    def __init__(self, raw):
        self.raw, self.inner, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if self.inner.eof:
                self.rest, self.inner = self.inner.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return 0
            got = self.inner.decompress(data, len(out))
            while not got and not self.inner.eof and self.inner.unconsumed_tail:
                got = self.inner.decompress(self.inner.unconsumed_tail, len(out))
            self.rest = self.inner.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


def _skip(f, n: int, seeks: bool) -> None:
    if seeks:
        f.seek(n, 1)
        return
    while n > 0 and (got := f.read(min(n, 1 << 16))):
        n -= len(got)


def _head(f) -> dict[str, str] | None:
    """Fields up to the blank line, names in lower case; None at the end of the file. Continued lines are joined."""
    out: dict[str, str] = {}
    name, first = None, True
    while True:
        line = f.readline()
        if not line:
            return out or None
        line = line.rstrip(b"\r\n")
        if not line:
            if first:
                continue
            return out
        if first and line.startswith((b"WARC/", b"HTTP/")):
            first = False
            continue
        first = False
        if line[:1] in b" \t" and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().lower().decode("utf-8", "replace")
        out[name] = value.strip().decode("utf-8", "replace")


def records(f, seeks: bool, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive. ``wanted`` judges the headers before a block is read."""
    while (head := _head(f)) is not None:
        length = int(head.get("content-length") or 0)
        if not wanted(head):
            _skip(f, length, seeks)
            continue
        http = head.get("content-type", "").startswith("application/http")
        inner, size, data = {}, length, None
        if http:
            top, kept = b"", length
            while kept and not top.endswith(b"\r\n\r\n") and (line := f.readline(kept)):
                top, kept = top + line, kept - len(line)
            inner = _head(io.BytesIO(top)) or {}
            size, length = (int(inner["content-length"]) if "content-length" in inner else kept), kept
        if payload and head.get("warc-type") != "revisit":
            data = f.read(length)
        else:
            _skip(f, length, seeks)
        bare = lambda v: v[1:-1] if v and v.startswith("<") and v.endswith(">") else v
        yield (
            head.get("warc-type"), bare(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-date"),
            (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, bare(head.get("warc-refers-to")), int(head.get("content-length") or 0), size, head, data,
        )


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _field(head: dict[str, str], column: Sequence[str]) -> str | None:
    if column[0] == "headers":
        return head.get(column[1].lower()) if len(column) > 1 else None
    value = head.get(NAMED[column[0]])
    if column[0] in ("record_id", "refers_to"):
        return value[1:-1] if value and value[0] == "<" else value
    if column[0] == "payload_digest":
        return (value or "").removeprefix("sha1:") or None
    return value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.bytes = int(options.get("partitionbytes", FILE_BYTES))
        # Fields without a column are asked for by options ``header.<name>``, since Spark pushes no look-up in a map.
        self.equal: list[tuple[tuple[str, ...], frozenset]] = [(("headers", k[len("header.") :]), frozenset([v])) for k, v in options.items() if k.lower().startswith("header.")]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and (f.attribute[0] in NAMED):
                self.equal.append((tuple(f.attribute), frozenset([f.value])))
            elif isinstance(f, In) and (f.attribute[0] in NAMED):
                self.equal.append((tuple(f.attribute), frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files in order of name, small ones together up to ``partitionBytes``."""
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        groups: list[list[str]] = [[]]
        size = 0
        for x in sorted(found, key=lambda x: x.path):
            if x.type != pafs.FileType.File or not x.base_name.endswith((".warc", ".warc.gz")) or x.base_name.startswith(("_", ".")):
                continue
            if groups[-1] and size + x.size > self.bytes:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        wanted = lambda head: all(_field(head, column) in values for column, values in self.equal)
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                packed = path.endswith(".gz")
                f = io.BufferedReader(_Gzip(raw) if packed else raw, 1 << 16)
                yield from records(f, not packed, wanted, self.payload)


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[tuple[str, str], ...]


class WarcWriter(DataSourceWriter):
    """Each task writes files below ``_attempts`` under names of its own; only those of tasks that count are moved out."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.gzip = str(options.get("compression", "none")).lower() == "gzip"
        self.bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, rows: Iterator) -> Written:
        fs, root = opened(self.path)
        attempts = posixpath.join(root, "_attempts")
        fs.create_dir(attempts, recursive=True)
        done, out, size = [], None, 0
        try:
            for row in rows:
                if out is None or size > self.bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    done.append((posixpath.join(attempts, name), posixpath.join(root, name)))
                    out, size = fs.open_output_stream(done[-1][0], compression=None), 0
                data = encode(*[row[c] for c in WRITES[:-1]], bytes(row["payload"]))
                if self.gzip:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(done))

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for old, new in m.paths if m else ():
                fs.move(old, new)
        self._clean(fs, root)

    def abort(self, messages: list) -> None:
        self._clean(*opened(self.path))

    @staticmethod
    def _clean(fs: pafs.FileSystem, root: str) -> None:
        attempts = posixpath.join(root, "_attempts")
        if fs.get_file_info(attempts).type == pafs.FileType.Directory:
            fs.delete_dir(attempts)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# Fixed value: the base32 alphabet, by value of five bits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: str) -> F.Column:
    """Upper-case base32 of the SHA-1 of a binary column. Ten hex digits are eight groups of five bits.

    The hash is bound to a variable, because an expression inside a lambda is evaluated at each of its steps.
    """
    word = "cast(conv(substr(h, 1 + 10 * (k div 8), 10), 16, 10) AS bigint)"
    letter = f"substr('{BASE32}', 1 + cast(shiftright({word}, 35 - 5 * (k % 8)) & 31 AS int), 1)"
    return F.expr(f"element_at(transform(array(sha1({payload})), h -> array_join(transform(sequence(0, 31), k -> {letter}), '')), 1)")


def page_records(pages: DataFrame, least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """(WRITES) for each row of ``pages``: response, or revisit of the response with the same payload and the largest page_id.

    Payloads under ``least_bytes`` are all responses. Null html is empty; of rows that repeat the largest page_id with
    its payload each is a response; a null page_id is less than any other. The record id names the page. Payloads of any
    length are whole, an empty table gives no record, and other columns are ignored.
    Groups of equal payloads are found from digests alone; where there are too many to broadcast, large groups are
    dealt over ``salts`` tasks.
    """
    rows = pages.select("page_id", "url", F.encode(text_of("html"), "UTF-8").alias("payload")).withColumn("digest", base32_sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "warc-groups")
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        judged = rows.join(F.broadcast(groups), "digest", "left")
    else:
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        judged = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["digest", "salt"], "left")
    revisit = (F.octet_length("payload") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = F.coalesce(revisit, F.lit(False))
    return judged.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), "digest", F.when(revisit, urn("keeper")).alias("refers_to"), "payload",
    )


def write_archive(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    register(pages.sparkSession)
    page_records(pages, **options).write.format("warc").mode("append").option("compression", compression).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, headers: dict[str, str] | None = None) -> DataFrame:
    """Records below ``path`` (SCHEMA). ``headers`` are equalities on any fields, judged before a payload is read; filters on
    columns are pushed by themselves. Files are dealt so that every core has some, and 128 MB make a partition at most."""
    register(spark)
    fs, at = opened(path)
    info = fs.get_file_info(at)
    size = info.size if info.type == pafs.FileType.File else sum(x.size or 0 for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)))
    part = min(FILE_BYTES, max(1 << 20, size // (2 * spark.sparkContext.defaultParallelism)))
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", part)
    for k, v in (headers or {}).items():
        reader = reader.option(f"header.{k.lower()}", v)
    return reader.load(path)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Writes whole ``pages`` and reads the archives back. Length and digest are those of the payload read, or, for revisits,
    which have none, of their headers. page_records() says what null, empty and repeated rows give."""
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"cast(nullif(substr({c}, {len('urn:page:') + 1}), '') AS bigint)")
    held = F.col("payload").isNotNull()
    return read_archive(spark, path).where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(held, base32_sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
bits AS (SELECT *, CAST(CAST(unhex(d) AS BIT) AS VARCHAR) AS b, max(page_id) OVER (PARTITION BY d) AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(b[5*i+1] AS INT) + 8 * CAST(b[5*i+2] AS INT) + 4 * CAST(b[5*i+3] AS INT) + 2 * CAST(b[5*i+4] AS INT) + CAST(b[5*i+5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM bits
"""
