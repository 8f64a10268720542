"""Substring dedup by seed and extend.

Anchors are word 8-grams chosen by winnowing: of the 8-grams in each window of 20 words the one with the least hash,
so two equal windows choose the same anchor at the same place. Anchors that the corpus has twice are seeds. Documents
are joined on them: each occurrence of a seed travels with the words within a window's reach, and those of one anchor
meet in a task, in the order of (doc_id, start). There each is extended both ways, word by word, over every earlier
occurrence with other words around it; a match of 20 words or more is a repeat. Matches of neighbouring anchors overlap,
and their unions are the maximal repeats, whose words go.

An anchor that occurs more than ``hot`` times is split instead: it is lengthened to each of the windows that chose it, and
equal windows meet by a digest of 128 bits of their words, of which only the first place is gathered, in partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import arrow_batches, materialize, small, table, text_of

LENGTH = 20
ANCHOR = 8
#: Occurrences of an anchor that meet in one task; those of a more frequent one are split by window.
HOT = 24
#: Seeds are looked up in a bitmap of fixed size up to this many; more are joined with the anchors instead.
MOST_SEEDS = 32_000_000
MOST_BITS = 1 << 28
CHUNK_BITS = 1 << 13
#: Runs of repeats of all documents that may be broadcast.
MOST_RUNS = 1_000_000


def anchors_of(hashes: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each ``anchor``-gram, for each window the position of the anchor that it chooses: the last of the least)."""
    short = W.mix(W.grams(hashes, anchor))
    span = length - anchor + 1
    if len(short) < span:
        return short, np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(short, span)[:, ::-1]
    return short, np.arange(len(views)) + (span - 1) - views.argmin(axis=1)


def _anchor_rows(length: int, anchor: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        for batch in batches:
            keys, found, at, of = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                short, chosen = anchors_of(known.of(W.split(text)), length, anchor)
                chosen = np.unique(chosen)
                if len(chosen):
                    found.append(short[chosen].view(np.int64))
                    at.append(chosen)
                    of.append(np.full(len(chosen), i))
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            if not places:
                yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["anchor"])
                continue
            rows = pa.array(np.concatenate(of) if of else np.empty(0, np.int64))
            keys = [batch.column(c).take(rows) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([pa.array(flat), *keys, pa.array(np.concatenate(at).astype(np.int32) if at else np.empty(0, np.int32))], names=["anchor", "doc_id", "text_key", "pos"])

    return run


def _chunk(bits: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(min(bits, CHUNK_BITS), bool)
        out[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [key[0]], "packed": [np.packbits(out).tobytes()]})

    return pack


def _bitmap(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for each residue that a seed has; its size follows the seeds but is bounded."""
    bits = 1 << 16
    while bits < 16 * n and bits < MOST_BITS:
        bits <<= 1
    bit = F.expr(f"anchor & {bits - 1}")
    chunk = min(bits, CHUNK_BITS)
    rows = seeds.select(F.expr(f"cast(({bits - 1} & anchor) div {chunk} as int)").alias("chunk"), (bit % chunk).cast("int").alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for chunk_no, packed in rows.groupBy("chunk").applyInPandas(_chunk(bits), "chunk int, packed binary").collect():  # at most MOST_BITS together
        out[chunk_no * chunk // 8 : (chunk_no + 1) * chunk // 8] = np.frombuffer(packed, np.uint8)
    return out, bits


def _has(bitmap: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    has, bits = bitmap
    bit = (hashes & W.U64(bits - 1)).astype(np.int64)
    return (has[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _occurrences(length: int, anchor: int, seeds, hot):
    """Occurrences of seeds: (anchor, pos, words in reach, place of the anchor in them), and of hot ones each window that
    chose them: (w1, w2, start as ``pos``). Seeds are those of a bitmap, or the places in column ``seeds``."""
    reach = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        for batch in batches:
            listed = batch.column("seeds").to_pylist() if seeds is None else None
            out: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = W.split(text)
                short, chosen = anchors_of(known.of(words), length, anchor)
                if not len(chosen):
                    continue
                if listed is None:
                    seed = _has(seeds.value, short)
                else:
                    seed = np.zeros(len(short), bool)
                    seed[np.array(listed[i] or [], np.int64)] = True
                # The windows that choose one place follow each other.
                first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
                last = np.r_[first[1:], len(chosen)] - 1
                some = seed[chosen[first]]
                first, last = first[some], last[some]
                at = chosen[first]
                split = _has(hot.value, short[at])
                for key, pos, lo, hi, wide in zip(short[at].view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist(), split.tolist()):
                    if wide:
                        for s in range(lo, hi + 1):
                            h = xxhash.xxh3_128_intdigest(b" ".join(words[s : s + length]))
                            out.append((i, None, (h >> 64) - (1 << 63), (h & W.MASK) - (1 << 63), s, None, None))
                    else:
                        begin = max(0, pos - reach)
                        out.append((i, key, None, None, pos, pos - begin, b" ".join(words[begin : pos + length])))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            of, *rest = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_key").take(of), *rest], names=["doc_id", "text_key", "anchor", "w1", "w2", "pos", "at", "context"])

    return run


def extended(a: list[bytes], i: int, b: list[bytes], j: int, anchor: int) -> tuple[int, int] | None:
    """How many words ``a`` and ``b`` share before and after the anchors at ``i`` and ``j``; None where those differ."""
    if a[i : i + anchor] != b[j : j + anchor]:
        return None
    left = 0
    while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, x, y = 0, i + anchor, j + anchor
    while x + right < len(a) and y + right < len(b) and a[x + right] == b[y + right]:
        right += 1
    return left, right


def repeats(rows: list[tuple[int, int, bytes]], length: int, anchor: int) -> list[list[tuple[int, int]]]:
    """For each occurrence (pos, place of the anchor in its words, words) of one anchor, in order, its maximal matches
    (start, stop) of ``length`` words or more with earlier ones."""
    seen: set[tuple[int, bytes]] = set()
    before: list[tuple[list[bytes], int]] = []
    out = []
    for pos, at, context in rows:
        if (at, context) in seen:  # all words in reach are an earlier one's
            out.append([(pos - at, pos - at + context.count(b" ") + 1)])
            continue
        words = context.split(b" ")
        found = set()
        for other, j in before:
            match = extended(words, at, other, j, anchor)
            if match is not None and match[0] + anchor + match[1] >= length:
                found.add((pos - match[0], pos + anchor + match[1]))
        seen.add((at, context))
        before.append((words, at))
        out.append(sorted(found))
    return out


def _matches(length: int, anchor: int):
    """Occurrences in order of anchor and place to (doc_id, text_key, start, stop) of repeats. Holds one anchor at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def found(groups) -> Iterator[pa.RecordBatch]:
            out = []
            for group in groups:
                if len(group) > 1:
                    for row, runs in zip(group, repeats([r[3:] for r in group], length, anchor)):
                        out += [(row[1], row[2], start, stop) for start, stop in runs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "text_key", "start", "stop"])

        held: list[tuple] = []
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32()]
            held += zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "pos", "at", "context")])
            groups = [list(g) for _, g in groupby(held, key=itemgetter(0))]
            held = groups.pop() if groups else []
            yield from found(groups)
        if held:
            yield from found([held])

    return run


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """The union of runs, as runs in order that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a document, in two lists, to maximal repeats."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        runs = [[{"start": a, "stop": b} for a, b in merged(x, y)] for x, y in zip(batch.column("starts").to_pylist(), batch.column("stops").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(runs, kind)], names=["_id", "_key", "runs"])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for text, copy, runs in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("runs").to_pylist()):
                words = W.split(text)
                if copy and len(words) >= length:
                    left: list[bytes] = []
                elif runs:
                    left, upto = [], 0
                    for r in runs:
                        left += words[upto : r["start"]]
                        upto = r["stop"]
                    left += words[upto:]
                else:
                    left = words
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_seeds: int = MOST_SEEDS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept (the words left, UTF-8).

    A word goes if a window of ``length`` words covers it whose words also start earlier, in a lesser doc_id or earlier
    in the same document. Null or empty text has no words; a text of fewer words than a window stays whole, and one of any
    length is searched whole. Rows that repeat id and text are one document and get equal results; of rows that repeat
    only the id, and of null ids (first), the order is by the hash of the text. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"), F.unhex(F.md5(text_of())).alias("tid"))
    # All windows of a copy start earlier in the first document with its text, so only that one is searched.
    groups = base.groupBy("tid").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("tid", "first"), "substrings-copies")
    side, _ = small(groups)
    base = base.join(side, "tid", "left").withColumn("copy", F.col("first").isNotNull() & ~F.struct("doc_id", "text_key").eqNullSafe(F.col("first"))).drop("tid", "first")
    searched = base.where("NOT copy").drop("copy")

    anchors = searched.select("text").mapInArrow(_anchor_rows(length, anchor, False), "anchor bigint")
    seeds = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seeds = materialize(seeds, "substrings-seeds")
    n_seeds, n_hot = seeds.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > hot, 1))).first()
    # A cold anchor that shares its bit with a hot one is split at each of its occurrences as well.
    split = spark.sparkContext.broadcast(_bitmap(seeds.where(F.col("n") > hot), n_hot))
    columns = f"doc_id {id_type}, text_key bigint, anchor bigint, w1 bigint, w2 bigint, pos int, at int, context binary"
    if n_seeds <= most_seeds:
        bitmap = spark.sparkContext.broadcast(_bitmap(seeds, n_seeds))
        found = searched.mapInArrow(_occurrences(length, anchor, bitmap, split), columns)
    else:
        placed = searched.mapInArrow(_anchor_rows(length, anchor, True), f"anchor bigint, doc_id {id_type}, text_key bigint, pos int")
        placed = placed.join(seeds, "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("seeds"))
        placed = placed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "seeds")
        own = searched.dropDuplicates(["doc_id", "text_key"]).join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        found = own.select("doc_id", "text_key", "text", "seeds").mapInArrow(_occurrences(length, anchor, None, split), columns)
    found = materialize(found, "substrings-occurrences")

    near = found.where("context IS NOT NULL").select("anchor", "doc_id", "text_key", "pos", "at", "context").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_key", "pos")
    matches = near.mapInArrow(_matches(length, anchor), f"doc_id {id_type}, text_key bigint, start int, stop int")

    windows = found.where("context IS NULL").select("w1", "w2", "doc_id", "text_key", F.col("pos").alias("start"))
    place = F.struct("doc_id", "text_key", "start")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    firsts = materialize(firsts.select("w1", "w2", "first"), "substrings-firsts")
    again = windows.join(firsts, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop"))

    runs = matches.unionByName(again).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    runs = materialize(runs.mapInArrow(_merge, f"_id {id_type}, _key bigint, runs array<struct<start:int,stop:int>>"), "substrings-runs")
    size = runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    side = small(runs)[0] if size <= MOST_RUNS else runs
    cut = base.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return cut.select("doc_id", "text", "copy", "runs").mapInArrow(_cut(length), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """remove_repeats() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM again),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
