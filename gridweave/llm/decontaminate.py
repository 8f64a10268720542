"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's window of ``window`` words (the whole item if it is shorter) is a set of positioned word shingles.
Containment of a window needs all of its shingles, so the necessary prefix in the order of rarity is a single
shingle: the one that the corpus has least often. Documents are joined with the windows on that shingle; a match
fixes where the window would start, the positional and length bounds discard starts outside of the document, and
the words of the window are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, fresh, materialize, row_key, same_row, small, table, text_of

# Fixed value: what separates words, once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same before A-Z are lower-cased, where words are only counted.
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

WINDOW = 10
SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, size): each run of ``window`` words of an item, or the whole item where it is shorter."""
    items = benchmark.select("item_id", words_of(text_of()).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    return (
        items.withColumn("size", size)
        .select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
        .select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("words"))
        .distinct()
    )


def shingle_key(k: int, row: str) -> Column:
    return F.xxhash64(*[F.col(f"{row}.{i}") for i in range(k)])


def positioned_shingles(words: str, k: int) -> Column:
    """The runs of k words as an array of structs; fields that lie beyond the end are null."""
    shifted = [F.col(words) if i == 0 else F.slice(words, F.lit(i + 1), F.greatest(F.size(words) - i, F.lit(0))) for i in range(k)]
    return F.arrays_zip(*[s.alias(str(i)) for i, s in enumerate(shifted)])


def explode_shingles(df: DataFrame, words: str, k: int, *keep: str) -> DataFrame:
    zipped = df.select(*keep, F.posexplode(positioned_shingles(words, k)).alias("pos", "s"))
    first = zipped.schema["s"].dataType.names
    parts = [F.col("s").getField(n) for n in first]
    return zipped.where(parts[-1].isNotNull()).withColumn("key", F.xxhash64(*parts)).drop("s")


def window_prefixes(docs: DataFrame, windows: DataFrame, shingle: int, k: int) -> DataFrame:
    """(key, offset, words, size, item_id): of each window whose shingles all occur in the corpus, the rarest one."""
    mine = windows.where(F.least(F.col("size"), F.lit(shingle)) == k)
    parts = explode_shingles(mine, "words", k, "item_id", "size", "words").withColumnRenamed("pos", "offset")
    keys, fits = small(parts.select("key").distinct())
    seen = explode_shingles(docs.select(words_of(text_of()).alias("w")), "w", k).select("key")
    if fits:
        counts = seen.join(keys, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    else:  # counted before the join, so that a frequent shingle is one row
        counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(keys, "key", "left_semi")
    counts = materialize(counts, "decontaminate-rarity")
    rated = parts.join(counts, "key", "left")
    best = rated.groupBy("item_id", "size", "words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("best")
    )
    return best.where("best.n > 0").select("best.key", "best.offset", "words", "size", "item_id")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, start, size, item_id): every place where a window of an item stands in a document."""
    windows = materialize(item_windows(benchmark, window), "decontaminate-windows")
    found = None
    sizes = [r[0] for r in windows.select(F.least(F.col("size"), F.lit(shingle))).distinct().collect()]  # at most ``shingle`` values
    for k in sorted(sizes):
        prefixes = materialize(window_prefixes(docs, windows, shingle, k), "decontaminate-prefixes")
        side, fits = small(prefixes)
        tokens = docs.select(*row_key(), words_of(text_of()).alias("w"))
        placed = explode_shingles(tokens.withColumn("n", F.size("w")), "w", k, "doc_id", "text_key", "w", "n")
        if not fits:  # the words stay behind: only places travel, and the documents come back for the comparison
            placed = placed.drop("w")
        matched = placed.join(side, "key").withColumn("start", F.col("pos") - F.col("offset"))
        matched = matched.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
        if not fits:
            again = docs.select(*row_key(), words_of(text_of()).alias("w")).dropDuplicates(["doc_id", "text_key"])
            matched = matched.distinct().join(again, same_row(matched, again)).drop(again["doc_id"]).drop(again["text_key"])
        hits = matched.where(F.slice("w", F.col("start") + 1, F.col("size")) == F.col("words")).select("doc_id", "text_key", "start", "size", "item_id")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, start int, size int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
    return found


def covered(spans: Column) -> Column:
    """How many places the spans (start, end exclusive), sorted, cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"),
        F.greatest(acc["upto"], s["stop"]).alias("upto"),
    )
    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty text has no words, long text is searched whole; an item without words has no window; a null item_id is not
    listed but its windows hit. Rows that repeat get the same result each, rows with one id (or none) that of their own text.
    Empty tables give no rows, or no hits. Other columns of either table are ignored, whatever their names.
    """
    found = occurrences(docs, benchmark, window, shingle)
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    per_doc = per_doc.select("doc_id", "text_key", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    base = docs.select(*row_key(), F.size(F.array_remove(F.split(text_of(), NOT_WORD_ANY_CASE), "")).cast("long").alias("n_words"))
    return base.join(per_doc, same_row(base, per_doc), "left").select(
        base["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns, whatever their names.

    Null and empty texts have no words and stay; long texts are searched whole; equal rows fare alike, and rows with one id (or
    none) by their own texts. An empty benchmark takes nothing out; an empty table gives no rows.
    """
    hit = materialize(occurrences(docs, benchmark, window, shingle).select("doc_id", "text_key").distinct(), "decontaminate-hit")
    side, _ = small(hit)
    id_, key = fresh(docs, "_hit_id", "_hit_key")
    side = side.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(text_of(docs["text"])) == F.col(key)), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contamination() of whole ``documents`` by whole ``benchmark``; its docstring says what null, empty and repeated rows give."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), run AS (
  SELECT r, s AS size, i, array_to_string(w[i : i + s - 1], ' ') AS k
  FROM (SELECT r, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM d, (SELECT DISTINCT size AS s FROM win) WHERE len(w) >= s)
), hit AS (SELECT run.r, run.i, run.size, win.item_id FROM run JOIN win ON run.size = win.size AND run.k = win.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r
"""
