"""N-gram Jaccard join by MinHash banding.

Texts are compared as sets of word 5-grams. Bands and rows are chosen so that a pair at the threshold shares a band
with the target recall. Band hashes are shuffled; those that share one are tied to the least of them, which takes as
many rows as there are texts and never all pairs. Within each tied cluster the full n-gram sets are then compared
exactly, cluster by cluster, large ones block by block, and only links counted and roots leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import arrow_batches, fresh, materialize, small, table, text_of
from .components import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Words that a task holds at once to compare their texts, at most; and how much smaller a block may be for the sake of
#: more tasks. A cluster is cut into some eight blocks before its blocks grow to the most.
BLOCK_WORDS, FINER, BLOCKS = 2_000_000, 40, 8


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that keep the recall within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def shingles(hashes: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Hashes of the runs of n words; a text of fewer, but not none, has one: itself."""
    if 0 < len(hashes) < n:
        return W.mix(W.grams(hashes, len(hashes)) + W.U64(len(hashes)))
    return W.mix(W.grams(hashes, n))


def _signer(bands: int, rows: int, n: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * W.U64(2) + W.U64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Hashes()
        for batch in batches:
            ids, tids, sets, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                tids.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                words = W.split(text)
                sets.append(shingles(known.of(words), n))
                counts.append(len(words))
            full = [i for i, s in enumerate(sets) if len(s)]
            out: list = [None] * len(sets)
            if full:
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                acc = np.zeros((bands, len(full)), np.uint64)
                for k in range(bands * rows):
                    least = np.minimum.reduceat(flat * a[k] + b[k], starts)
                    acc[k // rows] = acc[k // rows] * W.U64(W.BASE) + W.mix(least)
                for j, i in enumerate(full):
                    out[i] = W.mix(acc[:, j]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(tids, pa.binary()), pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                names=["doc_id", "tid", "words", "bands"],
            )

    return sign


def _compare(n: int, threshold: float):
    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """One group: clusters of texts, or two blocks of one cluster, whose pairs
        within a block are another group's. Counts links and joins roots."""
        known = W.Hashes()
        out = []
        pdf = pdf.drop_duplicates(["cluster", "tid"])
        for _, part in pdf.groupby("cluster", sort=False):
            tids, copies, side = part["tid"].tolist(), part["copies"].to_numpy(np.int64), part["side"].to_numpy(np.int64)
            sets = [np.unique(shingles(known.of(W.split(t)), n)) for t in part["text"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            begin = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            end = np.r_[begin[1:], len(flat)]
            group = np.repeat(np.arange(len(begin)), end - begin)
            mine: np.ndarray = np.empty(len(flat), np.int64)
            mine[order] = group  # the postings list of each shingle, text by text
            at = np.r_[0, np.cumsum(sizes)]
            links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            crossed = key[1] != key[2]
            for i in range(len(sets)):
                lists = mine[at[i] : at[i + 1]]
                lens = end[lists] - begin[lists]
                where = np.repeat(begin[lists] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
                common = np.bincount(owner[where], minlength=len(sets))
                near = common >= threshold * (sizes[i] + sizes - common) - 1e-9
                near[i] = False
                if crossed:
                    near &= side != side[i]
                near = np.flatnonzero(near)
                links[i] = copies[near].sum()
                for j in near:
                    a, b = find(i), find(int(j))
                    if a != b:
                        if tids[a] > tids[b]:
                            a, b = b, a
                        parent[b] = a
            out.append(pd.DataFrame({"tid": tids, "links": links, "root": [tids[find(i)] for i in range(len(sets))]}))
        return pd.concat(out) if out else pd.DataFrame({"tid": [], "links": [], "root": []})

    return compare


def classified(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """near_duplicates() with the MD5 of the text as ``tid``, and the least one of its class, which no null id blurs, as ``root``."""
    arrow_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_of().alias("text"))
    signed = source.mapInArrow(_signer(bands, rows, n, seed), f"doc_id {id_type}, tid binary, words bigint, bands array<bigint>")
    signed = materialize(signed, "jaccard-signed")
    texts = signed.where("words > 0").groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("bands").alias("bands"))
    texts = materialize(texts, "jaccard-texts")
    band = texts.select("tid", F.posexplode("bands").alias("band", "hash"))
    shared = band.groupBy("band", "hash").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).where(F.col("least") < F.col("most")).drop("most")
    shared = materialize(shared, "jaccard-shared")
    tied = band.join(shared, ["band", "hash"]).where(F.col("tid") != F.col("least")).select(F.col("tid").alias("u"), F.col("least").alias("v")).distinct()
    clusters = components(tied).select(F.col("node").alias("tid"), F.col("root").alias("cluster"))
    members = clusters.join(texts.select("tid", "rep", "copies", "words"), "tid")
    members = materialize(members, "jaccard-members")
    weights = members.groupBy("cluster").agg(F.sum("words").alias("weight"))
    block = F.greatest(F.lit(max(1, block_words // FINER)), F.least(F.lit(block_words), F.ceil(F.col("weight") / BLOCKS)))
    weights = materialize(weights.withColumn("blocks", F.ceil(F.col("weight") / block).cast("int")), "jaccard-weights")
    bins = max(1, math.ceil((weights.agg(F.sum("weight")).first()[0] or 0) / max(1, block_words // FINER)))
    members = materialize(members.join(weights.select("cluster", "blocks"), "cluster"), "jaccard-sized")
    side, _ = small(members.select(F.col("tid").alias("t"), "rep", "copies", "cluster", "blocks"))
    keyed = source.withColumn("tid", F.unhex(F.md5("text")))
    held = keyed.join(side, (keyed["tid"] == F.col("t")) & keyed["doc_id"].eqNullSafe(F.col("rep")))
    block = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    held = held.select("tid", "text", "copies", "cluster", "blocks", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select(
        "tid", "text", "copies", "cluster",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster")).alias("bin"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    held = held.withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("side")))
    seen = held.groupBy("bin", "i", "j").applyInPandas(_compare(n, threshold), "tid binary, links bigint, root binary")
    seen = materialize(seen, "jaccard-links")
    links = seen.groupBy("tid").agg(F.sum("links").alias("links"))
    roots = components(seen.where("links > 0").select(F.col("tid").alias("u"), F.col("root").alias("v")))
    classes = roots.withColumnRenamed("node", "tid").join(texts.select("tid", "rep"), "tid")
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = texts.select("tid", "rep", "copies").join(links, "tid", "left").join(classes.select("tid", "root").join(least, "root"), "tid", "left")
    known = known.select("tid", F.coalesce("root", "tid").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialize(known, "jaccard-classes")
    side, _ = small(known)
    return signed.select("doc_id", "tid").join(side, "tid", "left").select("doc_id", "tid", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    A link is a pair of rows whose texts have a Jaccard similarity of ``threshold`` or more; a class is a connected
    component of links, named by its least doc_id. Equal texts are one text with copies: links count the copies of
    every linked text and the row's own other copies. Null, empty and blank texts have no n-grams: they link to
    nothing, and each has its own id as class; long texts are compared whole. A null id names a class only where none of it has
    another. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return classified(docs, n, threshold, recall, block_words, seed).drop("tid", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one of each class, the first by id and MD5 of the text; rows without links all stay.

    All columns stay, whatever their names. Of equal rows one stays. Null, empty and blank texts are in no class; classes under
    null ids are told apart by their texts. An empty table gives no rows.
    """
    linked = materialize(classified(docs, **options).where("n_links > 0"), "jaccard-linked")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("first"))
    first = materialize(first, "jaccard-first")
    judged = linked.groupBy("root", "doc_id", "tid").agg(F.count(F.lit(1)).alias("n")).join(first, "root")
    stays = F.struct("doc_id", "tid").eqNullSafe(F.col("first"))
    judged = materialize(judged.select("doc_id", "tid", "n", stays.alias("stays")), "jaccard-judged")

    def same(rows: DataFrame):
        id_, tid = fresh(docs, "_id", "_tid")
        side = rows.select(F.col("doc_id").alias(id_), F.col("tid").alias(tid))
        return small(side)[0], docs["doc_id"].eqNullSafe(F.col(id_)) & (F.unhex(F.md5(text_of(docs["text"]))) == F.col(tid))

    kept = docs.join(*same(judged.where("NOT stays")), "left_anti")
    again = judged.where("stays AND n > 1")
    if again.isEmpty():
        return kept
    once = kept.join(*same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(*same(again), "left_anti").unionByName(once)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return near_duplicates(table(spark, sf_dir, "documents"))
