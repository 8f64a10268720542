"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word uni- and bigrams of all documents are counted in hash buckets, once for the raw corpus and once for trusted
documents (labelled of good quality and not toxic). A document's score is the mean over its n-grams of the log
of their probability under the target over that under the corpus. Both are smoothed by the same pseudo-counts in
proportion to the corpus, so an n-gram that is merely rare says little either way. Documents below a fixed threshold
are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import SPACE_CHARS, arrow_batches, table, text_of

BUCKETS = 1 << 16
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.075
#: Pseudo-count of a bucket.
PRIOR = 80.0
#: The target is fitted on so many trusted labels at most, those with the least hash of their id.
MOST_TRUSTED = 50_000
# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50


def ngram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    both = np.concatenate([W.mix(hashes), W.mix(W.grams(hashes, 2))])
    return (both % W.U64(buckets)).astype(np.int64)


def base_features(text: str, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text whose words have these hashes."""
    word_chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode("utf-8", "surrogatepass").strip():
            seen.add(line)
    repeat = 0
    if len(hashes) > 3:
        _, of, n = np.unique(W.mix(W.grams(hashes, 3)), return_inverse=True, return_counts=True)
        twice = n[of] > 1
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeat = int(covered.sum())
    return word_chars, symbols, dup, repeat


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column("text").to_pylist(), batch.column("trusted").to_pylist()):
                counts = np.bincount(ngram_buckets(known.of(W.split(text)), buckets), minlength=buckets) if text else 0
                raw += counts
                if trusted:
                    target += counts
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> np.ndarray:
    """The log ratio by bucket: an array of fixed size, all that comes to the driver."""
    arrow_batches(docs.sparkSession)
    trusted = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("_id"), "_id").limit(most_trusted)
    marked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
    marked = marked.select("text", F.col("_id").isNotNull().alias("trusted"))
    counts = marked.mapInArrow(_count(buckets), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.collect():  # one row a bucket at most
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    share = target.sum() / raw.sum()
    return np.log((target + PRIOR * share) / (raw + PRIOR)) - np.log(share)


def _judged(batch: pa.RecordBatch, known: W.Hashes, ratios: np.ndarray, threshold: float) -> list[tuple]:
    out = []
    for text in batch.column("text").to_pylist():
        text = text or ""
        hashes = known.of(W.split(text))
        features = base_features(text, hashes)
        n = len(hashes)
        failed = n < LEAST_WORDS or 100 * features[3] > REPEAT_PERCENT * n
        grams = ngram_buckets(hashes, len(ratios))
        score = float(ratios[grams].mean()) if n else 0.0
        out.append((n, *features, failed, score, not failed and score >= threshold))
    return out


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base features, base_failed, score, kept.

    Null and empty text has no words and fails; long text is judged whole. Without trusted labels all scores are 0 and the base
    rules decide; a null id has no label. Repeated rows count as often as they are there and are judged alike. An empty table
    gives no rows. Other columns of either table are ignored, whatever their names.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets, most_trusted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        for batch in batches:
            columns = list(zip(*_judged(batch, known, ratios.value, threshold))) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns, whatever their names; nothing is shuffled. Null, empty,
    long and repeated rows, and empty tables, fare as there."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets, most_trusted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        for batch in batches:
            yield batch.filter(pa.array([row[-1] for row in _judged(batch, known, ratios.value, threshold)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """judge() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The base columns of op4_quality, which SQL can express."""
    return op4_quality(spark, sf_dir).drop("score", "kept")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM n WHERE n > 1) GROUP BY r),
l AS (SELECT r, l, count(*) - 1 AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL),
s AS (SELECT r, sum(n) AS n FROM l GROUP BY r),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(s.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN s ON s.r = d.r)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o
"""
