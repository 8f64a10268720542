"""The pipeline's stages on small tables, and the registered queries against DuckDB."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridweave.llm import quality, queries, sharding
from gridweave.llm import words as W
from gridweave.llm.common import materialize
from tests.conftest import TESTDATA, same

from . import helpers
from .test_jaccard import brute
from .test_models import features
from .test_native import bits_of, mixed, words

SF = str(TESTDATA / "sf0.001")


def test_stage_order_and_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        if name != "sharding":
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert "shard_id" in docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) > 0


def plain(docs, labels, items):
    """The five stages restated over lists: {doc_id: (bytes, shard)}."""
    known, raw, good = W.Hashes(), np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    grams = {r["doc_id"]: quality.ngram_buckets(known.of(W.split(r["text"])), quality.BUCKETS) for r in docs}
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in trusted:
            np.add.at(good, g, 1)
    share = good.sum() / raw.sum()
    ratio = np.log((good + quality.PRIOR * share) / (raw + quality.PRIOR) / share)
    docs = [r for r in docs if not features(r["text"] or "")[-1] and ratio[grams[r["doc_id"]]].mean() >= quality.THRESHOLD]

    classes = {i: c for i, c, _ in brute([(r["doc_id"], r["text"]) for r in docs])}
    docs = [r for r in docs if classes[r["doc_id"]] == r["doc_id"]]

    windows = set()
    for r in items:
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    docs = [r for r in docs if not hit(r["text"])]

    taken = {r[0] for r in mixed(docs, corpus_pipeline.PIPELINE_MIX) if r[6]}
    docs = [r for r in docs if r["doc_id"] in taken]

    size = {r["doc_id"]: len(r["text"].encode()) for r in docs}
    out = {}
    for i in size:
        for depth in range(61):
            if sum(n for j, n in size.items() if bits_of(j)[:depth] == bits_of(i)[:depth]) <= sharding.SHARD_BYTES:
                out[i] = (size[i], bits_of(i)[:depth])
                break
    return out


def test_run_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(sharding.shards, "__defaults__", (20_000,))
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    want = plain(read("documents"), read("labels"), read("benchmark"))
    got = {r["doc_id"]: (r["n_bytes"], r["shard_id"]) for r in corpus_pipeline.run(spark, SF).collect() if not r["oversized"]}
    assert got == want and len(want) > 50 and len({s for _, s in want.values()}) > 1


def test_stages_of_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        assert docs.count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_of_awkward_rows(spark, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, at each stage by itself."""
    rows = helpers.awkward()
    docs = helpers.table(spark)
    out = materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, SF), "test-awkward")
    got = [tuple(r) for r in out.collect()]
    if name == "sharding":
        size = Counter()
        for i, text, *_ in rows:
            size[i] += len((text or "").encode())
        bytes_of = Counter()
        for r in out.collect():
            bytes_of[r["doc_id"]] += r["n_bytes"]
        assert len(got) == len(rows) and bytes_of == size and all(r["shard_id"] is not None for r in out.collect())
        return
    assert out.columns == docs.columns and not Counter(got) - Counter(rows)
    blank = Counter(r for r in rows if not (r[1] or "").strip())
    if name == "quality":
        assert got and not any(features(r[1] or "")[-1] for r in got)
    elif name == "near duplicates":
        ids = Counter(r[0] for r in got)
        assert ids[6] == 1 and not ids[7] and not ids[10] and ids[11] == 2 and not blank - Counter(got)
    elif name == "decontamination":
        assert not blank - Counter(got)
    else:
        # A leaf's rows with equal ids are taken together, so of a table that holds every row twice both or neither are.
        twice = materialize(dict(corpus_pipeline.STAGES)[name](spark, docs.unionAll(docs), SF), "test-awkward")
        assert got and all(n % 2 == 0 for n in Counter(tuple(r) for r in twice.collect()).values())


def test_run_of_awkward_rows(spark):
    docs = helpers.table(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
    assert 0 < docs.count() <= len(helpers.awkward())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        same(df, duck, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0
