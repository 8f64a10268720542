"""Sharding by extendible hashing.

A document's hash is fixed by its id. A bucket is a prefix of that hash; it holds all documents that share the
prefix. The directory starts with the empty prefix, and only a bucket that is over the byte limit splits on one
more bit. The directory is built from sums over short prefixes (grains), some tens for a shard, never from rows
gathered in one place. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, small, table, text_of

BITS = 60
SHARD_BYTES = 16 << 20
#: Bits of a grain beyond those that an even split would need.
SPARE_BITS = 5
#: Rows of a table that are numbered together are dealt to pages in stretches of two to the power of this.
STRETCH_BITS = 14


def hash_of(doc_id: str = "doc_id") -> Column:
    """The first 60 bits of the MD5 of the id as text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _split(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of depth low..high for ``rows`` whose bucket of depth ``low`` is yet to be judged.

    Returns the leaves (depth, prefix, grain bits applied later) and the buckets that are over the limit at ``high``.
    """
    grains = rows.groupBy(F.shiftright("h", BITS - high).alias("grain")).agg(
        F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )
    grains = materialize(grains, "sharding-grains")
    levels = grains.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    prefix = F.expr(f"shiftright(grain, {high} - depth)")
    buckets = levels.groupBy("depth", prefix.alias("prefix")).agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    # A bucket of one hash value splits no further, whatever its size.
    buckets = buckets.withColumn("split", (F.col("shard_bytes") > limit) & (F.col("lo") < F.col("hi")))
    buckets = materialize(buckets, "sharding-buckets")
    parents = buckets.where("split").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    leaves = buckets.where(~F.col("split"))
    below = leaves.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left_semi").drop("up")
    leaves = below.unionByName(leaves.where(F.col("depth") == low))
    # The directory: each grain's entry names its leaf.
    entries = levels.withColumn("prefix", prefix).select("grain", "depth", "prefix").join(leaves, ["depth", "prefix"])
    return entries.select("grain", "depth", "prefix", "shard_bytes", "shard_docs"), buckets.where((F.col("depth") == high) & F.col("split")).select(F.col("prefix").alias("grain"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversized.

    ``shard_id`` is the bucket's prefix in bits ('' for a single shard). Rows with one id share all their bits: where
    they exceed the limit together, their bucket gets overflow pages and the id ends in '.' and the page. A shard is
    ``oversized`` only if it holds a single document over the limit. Null and empty text has 0 bytes, a long one all of its
    bytes; null ids have the hash of the empty text, so they repeat one id. Rows that are equal are told apart by their
    number in the table that the first step has written. An empty table has no shards; other columns are ignored.
    """
    rows = materialize(docs.select("doc_id", hash_of().alias("h"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")), "sharding-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS)
    parts, pending = [], rows
    while True:
        entries, over = _split(pending, low, high, limit)
        entries = materialize(entries, "sharding-directory")
        side, _ = small(entries)
        keyed = pending.withColumn("grain", F.shiftright("h", BITS - high))
        parts.append(keyed.join(side, "grain").drop("grain"))
        over = materialize(over, "sharding-over")
        if high == BITS or over.isEmpty():
            break
        side, _ = small(over)
        pending = materialize(keyed.join(side, "grain", "left_semi").drop("grain"), "sharding-pending")
        low, high = high, min(BITS, high + 8)
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    fits = placed.where(F.col("shard_bytes") <= limit)
    fits = fits.select("doc_id", "n_bytes", name.alias("shard_id"), "depth", "shard_bytes", "shard_docs")
    return fits.unionByName(_pages(placed.where(F.col("shard_bytes") > limit), name, limit)).withColumn("oversized", F.col("shard_bytes") > limit)


def _pages(rows: DataFrame, name: Column, limit: int) -> DataFrame:
    """Overflow pages for buckets of one hash value: rows that repeat an id, or one document over the limit.

    Rows lie in the order of their number. A page takes those that begin within limit less the largest row, so it fits;
    where a row is over half of the limit each gets its own page. What lies before a row is summed in two steps, over
    stretches of the table and within the row's own, so that no bucket is gathered in one task.
    """
    bucket = ["depth", "prefix"]
    rows = materialize(rows.withColumn("stretch", F.expr(f"shiftright(row, {STRETCH_BITS})")), "sharding-paged")
    sums = rows.groupBy(*bucket, "stretch").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("c"), F.max("n_bytes").alias("m"))
    upto = Window.partitionBy(*bucket).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    largest = sums.groupBy(*bucket).agg(F.max("m").alias("most"))
    starts = sums.select(*bucket, "stretch", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0")).join(largest, bucket)
    side, _ = small(materialize(starts, "sharding-stretches"))
    inside = Window.partitionBy(*bucket, "stretch").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("b0") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))
    number = F.col("c0") + F.count(F.lit(1)).over(inside)
    room = F.lit(limit) - F.col("most")
    page = F.when(room * 2 < limit, number).otherwise(F.floor(before / F.greatest(room, F.lit(1))))
    rows = rows.join(side, [*bucket, "stretch"]).withColumn("page", page)
    rows = materialize(rows.withColumn("shard_id", F.when(F.col("shard_docs") == 1, name).otherwise(F.concat(name, F.lit("."), F.col("page").cast("string")))), "sharding-pages")
    sums = rows.groupBy("shard_id").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    side, _ = small(materialize(sums, "sharding-page-sums"))
    return rows.join(side, "shard_id").select("doc_id", "n_bytes", "shard_id", "depth", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """shards() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return shards(table(spark, sf_dir, "documents"))


#: A limit under which the smallest tables split as well.
SPLIT_BYTES = 256 << 10


def sharding_splits(spark, sf_dir: str) -> DataFrame:
    """The same with a limit that makes the buckets of small tables split."""
    return shards(table(spark, sf_dir, "documents"), SPLIT_BYTES)


#: Ids are unique in the tables that this runs on, so it has no overflow pages.
OP7_TEMPLATE = """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {docs}),
lv AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS docs, count(DISTINCT h) AS hs
  FROM d, (SELECT CAST(unnest(generate_series(0, 40)) AS INTEGER) AS depth) GROUP BY ALL),
leaf AS (SELECT d.doc_id, d.n_bytes, min(lv.depth) AS depth FROM d JOIN lv ON lv.prefix = d.h >> (60 - lv.depth)
  WHERE lv.bytes <= {limit} OR lv.hs = 1 GROUP BY ALL)
SELECT leaf.doc_id, leaf.n_bytes, CASE WHEN leaf.depth = 0 THEN '' ELSE
    array_to_string(list_transform(generate_series(1, leaf.depth), lambda i: CAST((d.h >> (60 - i)) & 1 AS VARCHAR)), '') END AS shard_id,
  leaf.depth, CAST(lv.bytes AS BIGINT) AS shard_bytes, lv.docs AS shard_docs, lv.bytes > {limit} AS oversized
FROM leaf JOIN d ON leaf.doc_id = d.doc_id JOIN lv ON lv.depth = leaf.depth AND lv.prefix = d.h >> (60 - leaf.depth)
"""
OP7_SQL = OP7_TEMPLATE.format(docs="documents", limit=SHARD_BYTES)
SPLITS_SQL = OP7_TEMPLATE.format(docs="documents", limit=SPLIT_BYTES)
