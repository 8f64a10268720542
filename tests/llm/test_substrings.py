import hashlib

from gridweave.llm import substrings

from .helpers import SCHEMA, prose, table


def brute(rows, length=20):
    """By row: n_words, n_removed, digest. Rows are documents in order; equal rows are one document."""
    order = sorted({(r[0] is not None, r[0] or 0, r[2], r[1] or "") for r in rows})
    first = {}
    for _, doc, key, text in order:
        w = text.encode().split()
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (doc, key, i))
    out = []
    for doc, text, key in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (doc or 0, key, i):
                gone |= set(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def keyed(df):
    from pyspark.sql import functions as F

    return [(r["doc_id"], r["text"], r["k"]) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_awkward_rows_both_ways(spark):
    df = table(spark)
    want = brute(keyed(df))
    assert found(substrings.remove_repeats(df)) == want
    assert found(substrings.remove_repeats(df, most_seeds=-1)) == want
    for hot in (0, 2, 1000):  # all anchors split, some, none
        assert found(substrings.remove_repeats(df, hot=hot)) == want
    assert found(substrings.remove_repeats(df, most_seeds=-1, hot=2)) == want


def test_many_contexts_around_one_passage(spark):
    """Passages of 8 to 60 words in other surroundings, overlapping each other's copies, on both sides of ``hot``."""
    passages = [prose(90 + n, n) for n in (8, 12, 19, 20, 21, 33, 60)]
    rows = []
    for i in range(60):
        p = passages[i % 7].split()
        rows.append((i, " ".join([prose(1000 + i, i % 30), *p[i % 3 :], prose(2000 + i % 9, 15), *(passages[(i + 1) % 7].split()[: 25 + i % 5])]), "en", "s", 1, *["c"] * 11))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(keyed(df))
    assert sum(n for _, _, n, _ in want) > 500
    for hot in (0, 5, 1000):
        assert found(substrings.remove_repeats(df, hot=hot)) == want


def test_matches_are_extended_both_ways_and_words_are_compared():
    a, b = "p q a b c d x y z".encode().split(), "r q a b c d x y w".encode().split()
    assert substrings.extended(a, 2, b, 2, 4) == (1, 2)
    assert substrings.extended(a, 2, b, 1, 4) is None  # equal hashes of other words join nothing
    one, two = b"p q a b c d x y z", b"r q a b c d x y w"
    assert substrings.repeats([(2, 2, one), (12, 2, two), (22, 2, one)], 7, 4) == [[], [(11, 18)], [(20, 29)]]
    assert substrings.repeats([(2, 2, one), (12, 2, two)], 8, 4) == [[], []]


def test_other_lengths(spark):
    df = table(spark)
    assert found(substrings.remove_repeats(df, length=30, anchor=10)) == brute(keyed(df), 30)


def test_kept_text_is_returned(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(40)), "en", "s", 1, *["c"] * 11) for i in range(2)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == b"" and got[0].startswith(b"w0 w1")


def test_empty(spark):
    assert substrings.remove_repeats(table(spark, [])).count() == 0
