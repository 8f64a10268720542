from collections import defaultdict

import pytest

from gridweave.llm import jaccard
from gridweave.llm import words as W

from .helpers import SCHEMA, edited, prose, table


def brute(rows, n=5, threshold=0.8):
    """(class, links) by row number, all pairs compared."""

    def grams(text):
        w = (text or "").encode().split()
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [grams(t) for _, t in rows]
    links, parent = defaultdict(int), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(len(rows)):
            common = len(sets[i] & sets[j])
            if i != j and sets[i] and sets[j] and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    key = lambda x: (x is not None, x or 0)
    return sorted(((rows[i][0], min(groups[find(i)], key=key) if links[i] else rows[i][0], links[i]) for i in range(len(rows))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_banding_reaches_recall():
    for recall in (0.9, 0.99, 0.9999):
        b, r = jaccard.banding(0.8, recall)
        assert 1 - (1 - 0.8**r) ** b >= recall and b * r <= jaccard.MOST_HASHES
    with pytest.raises(ValueError):
        jaccard.banding(0.1, 0.99999999, 4)


def test_awkward_rows(spark):
    df = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = jaccard.near_duplicates(df)
    assert out.columns == ["doc_id", "class_id", "n_links"]
    got = found(out)
    # A null id is the least of all, and Spark's min() passes over it.
    assert [g for g in got if g[0] is not None] == [b for b in brute(rows) if b[0] is not None]


def test_chains_and_blocks(spark):
    """A class is a whole chain of links, also where its texts are compared block by block."""
    texts, now = [], prose(20, 150)
    for i in range(12):
        texts.append((i, now))
        now = edited(now, 100 + i, 2)
    texts += [(100 + i, prose(200 + i, 80)) for i in range(10)]
    rows = [(i, t, "en", "src0", 1, *["c"] * 11) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(texts)
    assert found(jaccard.near_duplicates(df)) == want
    assert found(jaccard.near_duplicates(df, block_words=400)) == want


def test_keep_one(spark):
    df = table(spark)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert 6 in ids and not {7, 8, 9, 10} & set(ids)
    assert ids.count(11) == 2 and {1, 2, 3, 15} <= set(ids)


def test_repeated_rows_keep_one(spark):
    rows = [(1, prose(30, 60), "en", "s", 1, *["c"] * 11)] * 3
    assert jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).count() == 1


def test_classes_under_null_ids_keep_one_each(spark):
    """Two texts repeated and one nearly repeated, all without an id: one row of each class stays."""
    a, b, c = prose(31, 60), prose(32, 60), prose(33, 150)
    rows = [(None, t, "en", "s", 1, *["c"] * 11) for t in (a, a, b, b, b, c, edited(c, 34, 1))]
    kept = [r["text"] for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(kept) == 3 and {a, b} < set(kept)


def test_empty(spark):
    df = table(spark, [])
    assert jaccard.near_duplicates(df).count() == 0 and jaccard.keep_one(df).count() == 0


def test_recall_on_a_table(spark, duck):
    """All links of the documents of the smallest table, by exact comparison of every pair, against those found."""
    import numpy as np

    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    known = W.Hashes()
    sets = [set(jaccard.shingles(known.of(W.split(t))).tolist()) for _, t in docs]
    want = {}
    for i, (doc_id, _) in enumerate(docs):
        a = sets[i]
        want[doc_id] = sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets) if j != i and a and b)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.op9_jaccard(spark, "/root/testdata/sf0.001").collect()}
    links = np.array([[want[i], got[i]] for i, _ in docs])
    assert links[:, 0].sum() > 0 and (links[:, 1] <= links[:, 0]).all()
    assert links[:, 1].sum() >= 0.99 * links[:, 0].sum()
