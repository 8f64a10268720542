"""Quality rules, the language model and the block labeller against plain restatements and held-out accuracy."""

import html as H
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import classlm, html, quality
from gridweave.llm import words as W

from .helpers import SCHEMA, prose, table


def test_grams_of_any_size_agree_with_a_sum():
    h = np.array([zlib.crc32(bytes([i])) for i in range(50)], np.uint64)
    for n in (1, 2, 3, 5, 8, 13, 20, 50):
        want = [sum(int(h[i + j]) * pow(W.BASE, j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(50 - n + 1)]
        assert W.grams(h, n).tolist() == want
    assert len(W.grams(h[:3], 5)) == 0


def test_words_are_cut_at_ascii_space_only():
    text = "a b c d\x0be\x1cf\x85g"
    assert W.split(text) == [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]


def features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_quality_features_and_scores(spark):
    df = table(spark).where("doc_id IS NULL OR doc_id <> 15")
    marks = [(6, 1, 0), (7, 1, 0), (12, 1, 0), (8, 1, 1), (11, 0, 0), (None, 1, 0), (6, 1, 0), (18, None, None)]
    got = sorted((tuple(r) for r in quality.judge(df, labels(spark, marks)).collect()), key=repr)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    known, raw, good = W.Hashes(), np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    grams = [quality.ngram_buckets(known.of(W.split(t)), quality.BUCKETS) for _, t in rows]
    for (i, _), g in zip(rows, grams):
        np.add.at(raw, g, 1)
        if i in (6, 7, 12):
            np.add.at(good, g, 1)
    share = good.sum() / raw.sum()
    ratio = np.log((good + quality.PRIOR * share) / (raw + quality.PRIOR) / share)
    want = []
    for (i, t), g in zip(rows, grams):
        score = float(ratio[g].mean()) if len(g) else 0.0
        f = features(t)
        want.append((i, *f, score, not f[-1] and score >= quality.THRESHOLD))
    want.sort(key=repr)
    assert [(*g[:7], g[8]) for g in got] == [(*w[:7], w[8]) for w in want]
    assert np.allclose([g[7] for g in got], [w[7] for w in want])


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [(i, prose(i, 150), None, None, None, *["c"] * 11) for i in range(120)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(5000 + i % 8, 90).split()), None, None, None, *["c"] * 11) for i in range(40)]
    marks = [(i, 1, 0) for i in range(0, 120, 2)] + [(1000 + i, 0, 0) for i in range(0, 40, 2)]
    df = spark.createDataFrame(clean + junk, SCHEMA)
    kept = quality.keep_good(df, labels(spark, marks))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(120))


def test_quality_without_labels_or_rows(spark):
    df = table(spark)
    assert quality.judge(df, labels(spark, [])).where("score <> 0").count() == 0
    assert quality.judge(table(spark, []), labels(spark, [])).count() == 0


# --- language model


def hash_of(word: bytes) -> int:
    return int(np.uint64(W.Hashes()[word]).astype(np.int64))


def test_language_model(spark):
    """Scores, counts and bases against the model restated: classes as fitted, probabilities from plain counts."""
    rows = [(i, prose(i % 37, 30 + i % 50).replace("ba", "BA"), None, None, None, *["c"] * 11) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(table(spark))
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), b" "]
    train = [toks(t) for i, t in texts if not out(i)]
    c = Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for w, x in c.items() if w != b" ") for k in (1, 2))
    for small in (dict(head=40, classes=6, known=100), dict(head=5, classes=3, known=10**6, rounds=3)):
        got = classlm.score(df, **small).collect()
        model, vocabulary, classed = classlm.fit(df.where(~classlm.held_out()), **small)
        assert {r["h"]: r["n"] for r in vocabulary.collect()} == {hash_of(w): k for w, k in c.items() if w != b" "}
        cls = {r["h"]: r["class"] for r in classed.collect()}
        assert len(cls) == v - 1 and min(cls.values()) >= 2  # every word has a class
        of = {w: cls[hash_of(w)] for w in c if w != b" "} | {b" ": classlm.END}
        size = Counter()
        for w, k in c.items():
            size[of[w]] += k
        step = np.zeros((small["classes"] + 2,) * 2)
        for t in train:
            for x, y in zip([classlm.END, *(of[w] for w in t)], [of[w] for w in t]):
                step[x, y] += 1
        unseen = (once + 1) / (n + 2)
        prior = np.array([size[k] + 1.0 if k != classlm.RARE else 0 for k in range(len(step))])
        step = (step + classlm.PRIOR * prior / prior.sum()) / (step.sum(1, keepdims=True) + classlm.PRIOR) * (1 - unseen)
        step[:, classlm.RARE] = unseen
        assert np.allclose(step.sum(1), 1) and np.allclose(10**model.step, step)
        want = []
        for i, t in texts:
            w = toks(t)
            path = [classlm.END, *(of.get(x, classlm.RARE) for x in w)]
            emit = [c[x] / size[of[x]] if x in of else 1 / max(1, once * (once - 1) / (2 * (twice + 1))) for x in w]
            score = sum(math.log10(step[x, y]) for x, y in zip(path, path[1:])) + sum(map(math.log10, emit))
            want.append((i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), score))
        key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
        got = sorted((tuple(r)[:7] for r in got), key=key)
        want.sort(key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_gains_are_those_of_the_likelihood():
    """What a move gains, against the likelihood of all bigrams before and after it; words do not follow themselves here."""
    r = np.random.default_rng(3)
    size, total = 30, 7
    pairs = r.integers(0, 40, (size, size)) * (r.random((size, size)) < 0.5)
    of = np.r_[0, 1, r.integers(2, total, size - 2)]
    for w in range(2, size):  # nor their class, whose links the gain takes as they stand
        pairs[w, of == of[w]] = pairs[of == of[w], w] = 0
    likely = lambda b: classlm._xlogx(b).sum() - classlm._xlogx(b.sum(0)).sum() - classlm._xlogx(b.sum(1)).sum()
    bigrams = lambda of: np.eye(total)[of].T @ pairs @ np.eye(total)[of]
    for w in range(2, size):
        left, right = (np.bincount(of, x, total).astype(np.int64) for x in (pairs[:, w], pairs[w]))
        key = np.r_[np.flatnonzero(left), total + np.flatnonzero(right)]
        gain = classlm.gains(np.zeros(len(key), np.int64), key, np.r_[left[left > 0], right[right > 0]], np.array([of[w]]), bigrams(of).astype(float))[0]
        for b in range(2, total):
            if left[b] or right[b]:
                continue
            moved = of.copy()
            moved[w] = b
            assert gain[b] - gain[of[w]] == pytest.approx(likely(bigrams(moved)) - likely(bigrams(of)))


def test_exchange_finds_planted_classes():
    """Words that stand in the same places end up together."""
    size, groups = 2 + 24, 4
    pairs = np.zeros((size, size))
    for a in range(24):
        for b in range(24):
            if (a % groups + 1) % groups == b % groups:
                pairs[2 + a, 2 + b] = 10 + (a * b) % 3
    of = classlm.exchange(pairs, groups, 20)
    kinds = [{int(of[2 + w]) for w in range(24) if w % groups == k} for k in range(groups)]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == groups


def alternating(n, each=40):
    def text(i):
        r = random.Random(i)
        return " ".join("ab"[j % 2] + str(r.randrange(4 if r.random() < 0.6 else each)) for j in range(40))

    return [(i, text(i), None, None, None, *["c"] * 11) for i in range(n)]


def test_words_past_the_core_have_classes(spark):
    """Two kinds of words alternate; those past the core, known to workers or joined, are told apart as the core is."""
    df = spark.createDataFrame(alternating(120), SCHEMA)
    c = Counter(w for r in df.collect() for w in r["text"].encode().split())
    for known in (1000, 12):
        cls = {r["h"]: r["class"] for r in classlm.fit(df, classes=8, known=known, head=8)[2].collect()}
        assert set(cls) == set(map(hash_of, c)) and len(c) > 30
        assert len({(w[:1], cls[hash_of(w)]) for w in c}) == len(set(cls.values()))  # each class has words of one kind


def test_rounds_move_rare_words_and_raise_the_likelihood(spark):
    """Rounds cover words of every rank: some past the 5,000th change class, and training text gets likelier."""
    df = spark.createDataFrame(alternating(2500, 4000), SCHEMA)
    one, two = (classlm.fit(df, classes=16, head=50, rounds=k)[2].collect() for k in (1, 2))
    rank = {r["h"]: i for i, r in enumerate(sorted(one, key=lambda r: -r["n"]))}
    before = {r["h"]: r["class"] for r in one}
    moved = [rank[r["h"]] for r in two if before[r["h"]] != r["class"]]
    assert len(rank) > 6000 and max(moved) > 5000
    total = [classlm.score(df, classes=16, head=50, rounds=k).where("NOT held_out").agg({"score": "sum"}).first()[0] for k in (1, 2)]
    assert total[1] > total[0]


def test_language_model_of_nothing(spark):
    assert classlm.score(table(spark, [])).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None, *["c"] * 11)], SCHEMA)
    r = classlm.score(one).collect()[0]
    assert r["n_tokens"] == 1 and math.isfinite(r["score"]) and math.isfinite(r["base_score"])


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&nbsp;line &lt;x&gt;</h1><p>First  <b>bold\n text</b>.<br>More<p>Second &copy; &#233;&amp <!-- hidden --> end<ul><li>one<li>two</ul>
<div class="ad">Buy now</div><p>Third</p></article><section class="comments"><div class="comment"><p>I disagree</p></div></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; Site</footer></body></html>"""


def test_blocks():
    found = [t for _, t, _ in html.blocks_of(PAGE)]
    assert found == ["T & t", "Home", "Menu", "We use cookies", "Head line <x>", "First bold text. More", "Second © é& end", "one", "two", "Buy now", "Third", "I disagree", "Mail", "Send", "© Site"]
    assert html.blocks_of(None) == [] and html.blocks_of("") == [] and html.blocks_of("<p>") == []
    assert [t for _, t, _ in html.blocks_of("plain <b>text")] == ["plain text"]


def test_all_words_and_ancestors_reach_the_vectors():
    """Blocks that differ only after many words, or in an element far above or the fifth of its names, get other ids."""
    ids = lambda page: tuple(x[0] for x in html.vectors(html.blocks_of(page))[:2])
    text = "word " * 300
    assert ids(f"<p>{text}comments</p>")[1] != ids(f"<p>{text}article</p>")[1]
    for names in ("comments", "a b c d comments"):
        assert ids(f"<div class='{names}'>{'<div>' * 12}text</div>")[0] != ids(f"<div class='{names[:-8]}article'>{'<div>' * 12}text</div>")[0]


def test_gradients():
    pages, labels_ = html.training_pages(4, 5)
    net = html.Labeller(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.gradients(pages, labels_)
    for name in ("xf", "hb", "out", "bf"):
        flat = net.p[name].reshape(-1)
        at = int(np.argmax(np.abs(grad[name])))
        eps, old = 1e-3, flat[at]
        flat[at] = old + eps
        up = net.gradients(pages, labels_)[0]
        flat[at] = old - eps
        down = net.gradients(pages, labels_)[0]
        flat[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(grad[name].reshape(-1)[at]), rel=0.05, abs=1e-4)


def test_held_out_accuracy():
    pages, want = html.training_pages(250, 4242)
    got = html.trained().label(pages)
    assert np.mean(np.concatenate([g == (w > 0) for g, w in zip(got, want)])) > 0.99


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "clash", "c"), (2, None, None, "clash", "c"), (None, "v", "", None, None), (1, "u", PAGE, "clash", "c"), (4, "w", "<article>" + "<p>word word word.</p>" * 3000 + "</article>", None, None)]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, "u"][0] == "Head line <x>\nFirst bold text. More\nSecond © é& end\none\ntwo\nThird"
    assert got[2, None] == ("", 0) and got[None, "v"] == ("", 0)
    assert got[4, "w"][0].count("\n") == 2999 and got[4, "w"][1] == len(got[4, "w"][0])
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


def test_pages_of_the_tables(spark, duck):
    """Nearly every page's text is that of its article element, which the labeller is not told."""
    truth = {}
    for page_id, page in duck.execute("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        truth[page_id] = "\n".join(x for x in parts if x)
    got = html.op1_html(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["text"] == truth[r["page_id"]] for r in got) >= 0.98 * len(truth)
