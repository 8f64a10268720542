"""A Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Every word of every training document is counted, clustered and scored. Documents are read once, into hashes of 64 bits
of their words, and all later passes run on those. Clustering is by exchange, which puts a word into the class that raises
the likelihood of the class bigrams most. It starts with the most frequent words, one at a time on the driver. Then come
rounds over the whole vocabulary: each word, whatever its count, is judged with all its neighbours in the corpus, summed by
their classes, against what the class bigrams gain without it where it is and with it elsewhere. Words move together in a
round, as one that is split over many tasks must, and bigrams are counted anew between rounds.

P(text) is the product over tokens of P(class | class before) * P(token | class). The end of a document has its own class.
So has what training lacks: its rate is that of words seen once, and a word of it is one of as many as Chao's estimate
says were not seen.

Counts and classes of the most frequent words (``known``, a documented bound) go to every worker as arrays; what other words
a document has is joined with the full vocabulary by a shuffle. As neighbours, those count as one class of rare words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .common import arrow_batches, materialize, table, text_of

#: Words that exchange starts with, on the driver; a table of this size squared is all that it holds.
HEAD = 1000
CLASSES = 64
KNOWN = 1_000_000
SWEEPS = 6
#: Rounds of exchange over the whole vocabulary, the first of which gives all words past the start a class.
ROUNDS = 2
#: Tokens that a task gathers before it sums them, and pairs of a word and a class that it weighs at a time.
MOST_TOKENS, MOST_PAIRS = 1_200_000, 20_000
#: Counts up to this are weighed by a table.
TABLED = 12
#: Weight of the class unigram in the transition probabilities.
PRIOR = 5.0
END, RARE = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (bytes.lower() changes nothing else); the end is counted apart."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = W.Hashes()
    for batch in batches:
        out = [known.of(tokens_of(text)).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(out, pa.binary())], names=["row", "doc_id", "hashes"])


def hashed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hashes) of each row, written: rows are numbered once and for all."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows.mapInArrow(_hashed, f"row bigint, doc_id {id_type}, hashes binary"), "classlm-hashes", "zstd")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all documents of a batch, and how many each has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int64), np.array([len(x) >> 3 for x in parts], np.int64)


def _line(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another with an end before and after each, and where their words stand."""
    at = np.arange(len(ids)) + 1 + np.repeat(np.arange(len(lens)), lens)
    line = np.full(len(ids) + len(lens) + 1, END, np.int64)
    line[at] = ids
    return line, at


class Lookup:
    """Places of known hashes. They lie in the order of their low bits, so a hash is looked for from where its own begin."""

    def __init__(self, hashes: np.ndarray):
        self.mask = (1 << max(8, (2 * len(hashes)).bit_length())) - 1
        self.keys = hashes[np.argsort(hashes & self.mask, kind="stable")]
        self.start = np.r_[0, np.cumsum(np.bincount(self.keys & self.mask, minlength=self.mask + 1))].astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or their number where it is not known."""
        slot = hashes & self.mask
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(hashes), len(self.keys))
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            hit = self.keys[at] == hashes[live]
            out[live[hit]] = at[hit]
            live, at = live[~hit], at[~hit] + 1
            more = at < end[live]
            live, at = live[more], at[more]
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    for batch in batches:
        held.append(_flat(batch.column("hashes"))[0])
        if sum(map(len, held)) > MOST_TOKENS:
            yield out()
    yield out()


def _count_pairs(model, size: int):
    """Bigrams of ids; ``model`` has the known hashes and the id of each, with that of other words at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = model.value
        counts = np.zeros(size * size, np.int64)
        for batch in batches:
            flat, lens = _flat(batch.column("hashes"))
            line, _ = _line(ids[known.find(flat)], lens)
            counts += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pair", "n"])

    return run


def _pairs(texts: DataFrame, model, size: int) -> np.ndarray:
    seen = texts.mapInArrow(_count_pairs(model, size), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    seen = seen.toArrow()  # at most the square of ``size`` rows
    out = np.zeros(size * size, np.int64)
    out[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    return out.reshape(size, size)


def _count_neighbours(model, total: int, least: int):
    """(h, near) of words whose class is below ``least``: counts by the class before, ``total`` and the class after, or
    twice ``total`` for the word itself, which is counted once. A count is multiplied by their number and joined with its key."""
    wide = 2 * total + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = model.value
        codes: list[np.ndarray] = []  # of known words, place and key
        words: list[np.ndarray] = []  # of others, hash and key
        near: list[np.ndarray] = []

        def rows(h: np.ndarray, some: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``some``: sorted, place in ``h`` and key."""
            of = some // wide
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
            h, ends = h[of[first]], np.r_[first, len(some)]
            for i in range(0, len(h), 50_000):
                cut = ends[i : i + 50_001]
                part = slice(cut[0], cut[-1])
                lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(n[part] * wide + some[part] % wide))
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000]), lists], names=["h", "near"])

        def out() -> Iterator[pa.RecordBatch]:
            yield from rows(known.keys, *np.unique(np.concatenate(codes), return_counts=True))
            h, of = np.unique(np.concatenate(words), return_inverse=True)
            yield from rows(h, *np.unique(of * wide + np.concatenate(near), return_counts=True))
            for held in (codes, words, near):
                held.clear()

        for batch in batches:
            flat, lens = _flat(batch.column("hashes"))
            place = known.find(flat)
            own = ids[place]
            line, at = _line(own, lens)
            again = np.zeros(len(flat) + 1, bool)  # the word before, in the same document, is the same
            again[1:-1] = (flat[1:] == flat[:-1]) & (at[1:] == at[:-1] + 1)
            wanted, strange = own < least, place == len(known)
            for rest, key in ((wanted, np.where(again[:-1], 2 * total, line[at - 1])), (wanted & ~again[1:], total + line[at + 1])):
                codes.append((place * wide + key)[rest & ~strange])
                words.append(flat[rest & strange])
                near.append(key[rest & strange])
            if sum(map(len, codes)) + sum(map(len, words)) > 2 * MOST_TOKENS:
                yield from out()
        if codes:
            yield from out()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each id, END and RARE apart in classes 0 and 1, by exchange over the bigram counts of ids."""
    size, total = len(pairs), classes + 2
    of = np.r_[END, RARE, 2 + np.arange(size - 2) % classes]
    one = np.eye(total, dtype=np.float64)
    pairs = pairs.astype(np.float64)
    right, left = pairs @ one[of], one[of].T @ pairs  # words by class, class by words
    bigrams = one[of].T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(2, size):
            own, a = pairs[w, w], of[w]
            r, c = right[w].copy(), left[:, w].copy()
            r[a] -= own
            c[a] -= own
            bigrams[a, :] -= r
            bigrams[:, a] -= c
            bigrams[a, a] -= own
            rows, columns = bigrams.sum(1), bigrams.sum(0)
            gain = (_xlogx(bigrams + r) - _xlogx(bigrams)).sum(1) + (_xlogx(bigrams + c[:, None]) - _xlogx(bigrams)).sum(0)
            d = np.diagonal(bigrams)
            gain += _xlogx(d + r + c + own) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + c)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(columns + c.sum() + own) - _xlogx(columns)
            gain[:2] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            bigrams[b, :] += r
            bigrams[:, b] += c
            bigrams[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[a, :] -= pairs[w, :]
                left[b, :] += pairs[w, :]
        if not moved:
            break
    return of



def gains(of: np.ndarray, key: np.ndarray, n: np.ndarray, now: np.ndarray, bigrams: np.ndarray, tabled: np.ndarray | None = None) -> np.ndarray:
    """For each word and class, what the class bigrams gain by the word in that class over it in none.

    ``of``, ``key``, ``n``: sorted words (0, 1, ..), their neighbours' classes as _count_neighbours() numbers them, counts;
    ``now``: the class in which ``bigrams`` have a word, or -1. Links of a word to its own class are taken as they stand.
    """
    total = len(bigrams)
    both = np.concatenate([bigrams, bigrams.T, np.diagonal(bigrams)[None]])
    tabled = gain_table(bigrams) if tabled is None else tabled
    low = n <= TABLED
    out = np.empty((len(n), total))
    out[low] = tabled[n[low], key[low]]
    x, m = both[key[~low]], n[~low, None]
    out[~low] = _xlogx(x + m) - _xlogx(x)
    mine = now[of]
    p = np.flatnonzero(mine >= 0)
    x = both[key[p], mine[p]]
    out[p, mine[p]] = _xlogx(x) - _xlogx(x - n[p])
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    out = np.add.reduceat(out, starts)
    itself = key == 2 * total
    before, after = (np.bincount(of, np.where((key // total == side) | itself, n, 0), len(now))[:, None] for side in (0, 1))
    rows, columns = bigrams.sum(1), bigrams.sum(0)
    w = np.flatnonzero(now >= 0)
    for count, sums in ((after, rows), (before, columns)):  # a word that comes before another is in the row of its class
        loss = _xlogx(sums + count) - _xlogx(sums)
        loss[w, now[w]] = _xlogx(sums[now[w]]) - _xlogx(sums[now[w]] - count[w, 0])
        out -= loss
    out[:, :2] = -np.inf
    return out


def gain_table(bigrams: np.ndarray) -> np.ndarray:
    """What counts up to TABLED add, by count, key and class."""
    both = np.concatenate([bigrams, bigrams.T, np.diagonal(bigrams)[None]])
    return np.stack([_xlogx(both + i) - _xlogx(both) for i in range(TABLED + 1)])


def _moved(model, bigrams: np.ndarray):
    """Rows of _count_neighbours() in order of h to (h, n, class): each word in the class that gains most, or where it is."""
    total = len(bigrams)
    wide = 2 * total + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = model.value
        tabled = gain_table(bigrams)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def judged(h: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            words, of = np.unique(h, return_inverse=True)
            some, at = np.unique(of * wide + key, return_inverse=True)
            n = np.bincount(at, n, len(some)).astype(np.int64)
            of, key = some // wide, some % wide
            now = ids[known.find(words)]
            now = np.where(now == RARE, -1, now)
            ends = np.searchsorted(of, np.arange(len(words) + 1))
            i = 0
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + MOST_PAIRS, "right")) - 1)
                cut = slice(ends[i], ends[j])
                gain = gains(of[cut] - i, key[cut], n[cut], now[i:j], bigrams, tabled)
                best, a = gain.argmax(1), now[i:j]
                stay = np.flatnonzero(a >= 0)
                stay = stay[gain[stay, best[stay]] <= gain[stay, a[stay]] + 1e-9]
                best[stay] = a[stay]
                count = np.bincount(of[cut] - i, np.where((key[cut] < total) | (key[cut] == 2 * total), n[cut], 0), j - i)  # each token has one before it
                yield pa.RecordBatch.from_arrays([pa.array(words[i:j]), pa.array(count.astype(np.int64)), pa.array(best.astype(np.int32))], names=["h", "n", "class"])
                i = j

        for batch in batches:
            lists = batch.column("near")
            flat = lists.flatten().to_numpy()
            held.append((np.repeat(batch.column("h").to_numpy(), np.diff(lists.offsets.to_numpy())), flat % wide, flat // wide))
            size += len(held[-1][0])
            if size > 4 * MOST_PAIRS:
                h, key, n = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last word may go on
                held = [(h[whole:], key[whole:], n[whole:])]
                size = len(h) - whole
                yield from judged(h[:whole], key[:whole], n[:whole])
        if held:
            yield from judged(*(np.concatenate(x) for x in zip(*held)))

    return run


def _band() -> Column:
    """Counts in bands of a sixty-fourth of a doubling."""
    return F.floor(F.log2("n") * 64)


def _least_band(vocabulary: DataFrame, known: int) -> int:
    """The lowest band such that it and those above hold at most ``known`` words: no sort, whatever the vocabulary."""
    bands = sorted(vocabulary.groupBy(_band().alias("band")).count().collect(), reverse=True)  # some thousand rows
    total, least = 0, 1 << 30
    for band, n in bands:
        total += n
        if total > known:
            break
        least = band
    return least


@dataclass
class Model:
    """What workers score with: known words by hash, with their counts and classes, and the class of other words at the end."""

    known: Lookup
    counts: np.ndarray
    classes: np.ndarray
    step: np.ndarray  # log10 P(class | class before); zero until counted
    class_tokens: np.ndarray
    total: int  # tokens in training
    types: int  # distinct tokens in training
    unseen: float  # rate of words that training lacks
    unseen_types: float  # how many they are
    least: int  # band of counts from which words are known


def _steps(bigrams: np.ndarray, class_tokens: np.ndarray, unseen: float) -> np.ndarray:
    """Transitions; one to the class of unseen words has their rate from any class."""
    prior = class_tokens + 1
    prior[RARE] = 0
    seen = bigrams.astype(float)
    seen[:, RARE] = 0
    step = (seen + PRIOR * prior / prior.sum()) / (seen.sum(1, keepdims=True) + PRIOR) * (1 - unseen)
    step[:, RARE] = unseen
    return np.log10(step)


def _learned(rows: DataFrame, classes: int, known: int, sweeps: int, rounds: int, head: int) -> tuple[Model, DataFrame, DataFrame]:
    """From hashed training rows: the model without its steps, (h, n) of all words, and (h, n, class) of them."""
    spark = rows.sparkSession
    texts = rows.select("hashes")
    vocabulary = texts.mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    vocabulary = materialize(vocabulary, "classlm-vocabulary")
    n_docs = rows.count()
    n_words, n_types, once, twice = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).first()
    least = _least_band(vocabulary, known)
    top = vocabulary.where(_band() >= least).toArrow()  # at most ``known`` rows
    words = Lookup(top["h"].to_numpy())
    counts = np.zeros(len(words), np.int64)
    counts[words.find(top["h"].to_numpy())] = top["n"].to_numpy()
    core = np.lexsort((words.keys, -counts))[:head]
    size, total = len(core) + 2, classes + 2
    ids = np.full(len(words) + 1, RARE, np.int64)
    ids[core] = np.arange(2, size)
    pairs = _pairs(texts, spark.sparkContext.broadcast((words, ids)), size)
    of = exchange(pairs, classes, sweeps)
    ids[core] = of[2:]
    one = np.eye(total)[of]
    bigrams = one.T @ pairs @ one
    classed = None
    for i in range(max(1, rounds)):
        model = spark.sparkContext.broadcast((words, ids.copy()))
        if i:
            bigrams = _pairs(texts, model, total).astype(np.float64)
        near = texts.mapInArrow(_count_neighbours(model, total, total if i else 2), "h bigint, near array<bigint>")
        moved = near.repartition("h").sortWithinPartitions("h").mapInArrow(_moved(model, bigrams), "h bigint, n bigint, class int")
        if not i:  # the words that exchange has started with stay
            mine = pa.table({"h": words.keys[core], "n": counts[core], "class": ids[core].astype(np.int32)})
            moved = moved.unionByName(spark.createDataFrame(mine.to_pandas(), "h bigint, n bigint, class int"))
        classed = materialize(moved, "classlm-classes")
        found = classed.where(_band() >= least).select("h", "class").toArrow()  # at most ``known`` rows
        ids[words.find(found["h"].to_numpy())] = found["class"].to_numpy()
    class_tokens = np.zeros(total)
    class_tokens[END] = n_docs
    for k, n in classed.groupBy("class").agg(F.sum("n")).collect():
        class_tokens[k] += n
    unseen = (once + 1) / (n_words + n_docs + 2)
    model = Model(words, counts, ids, np.zeros((total, total)), class_tokens, n_words + n_docs, n_types + (n_docs > 0), unseen, max(1.0, once * (once - 1) / (2.0 * (twice + 1))), least)
    return model, vocabulary, classed


def _read(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        log_count = np.r_[np.log10(m.counts + 1.0), 0.0]
        # Of a known word; one that is not adds its own once it is joined.
        emit = np.r_[np.log10(m.counts / m.class_tokens[m.classes[:-1]]), 0.0]
        n_docs = int(m.class_tokens[END])
        end_base = math.log10(n_docs + 1.0)
        for batch in batches:
            flat, lens = _flat(batch.column("hashes"))
            at = m.known.find(flat)
            strange = at == len(m.known)
            of = np.repeat(np.arange(len(lens)), lens)
            add = lambda x: np.bincount(of, x, len(lens)).astype(np.float64)
            first = np.r_[0, np.cumsum(lens)]
            cls = m.classes[at].astype(np.int16)
            end = np.array([END], np.int16)
            paths = [np.concatenate([end, cls[first[i] : first[i + 1]], end]).tobytes() for i in range(len(lens))]
            null = lambda n, kind: pa.nulls(n, kind)
            n, kinds = len(lens), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), batch.schema.field("doc_id").type)
            names = ["row", "h", "at", "n_tokens", "n_known", "base", "emitted", "path", "doc_id"]
            main = [batch.column("row"), null(n, pa.int64()), null(n, pa.int32()), pa.array(lens + 1), pa.array(lens - add(strange).astype(np.int64) + (n_docs > 0)), pa.array(add(log_count[at]) + end_base), pa.array(add(emit[at])), pa.array(paths, pa.binary()), batch.column("doc_id")]
            yield pa.RecordBatch.from_arrays(main, names=names)
            some = np.flatnonzero(strange)
            if len(some):
                k = len(some)
                place = (some - first[of[some]] + 1).astype(np.int32)
                tail = [batch.column("row").take(pa.array(of[some])), pa.array(flat[some]), pa.array(place), pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k, np.int64)), *[pa.array(np.zeros(k))] * 2, *[null(k, t) for t in kinds[-2:]]]
                yield pa.RecordBatch.from_arrays(tail, names=names)

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes of joined words where they stand in the path."""
    for batch in batches:
        lists = batch.column("found")
        ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        at, k = (x.to_numpy() for x in lists.flatten().flatten())
        out = []
        for i, path in enumerate(batch.column("path").to_pylist()):
            if ends[i] < ends[i + 1]:
                whole = np.frombuffer(path, np.int16).copy()
                whole[at[ends[i] : ends[i + 1]]] = k[ends[i] : ends[i + 1]]
                path = whole.tobytes()
            out.append(path)
        rest = [c for c in batch.schema.names if c not in ("path", "found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, "path"])


def _paths(rows: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """One row per hashed row: doc_id, counts, sums of logarithms of word counts and emissions, and the path of classes."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    columns = f"row bigint, h bigint, at int, n_tokens bigint, n_known bigint, base double, emitted double, path binary, doc_id {id_type}"
    parts = rows.mapInArrow(_read(rows.sparkSession.sparkContext.broadcast(model)), columns)
    # A row of its own for each document, without a hash, carries what is known already; spread, lest all meet in one task.
    others = classed.where(_band() < model.least).select(F.col("h").alias("word"), F.col("n").alias("c"), "class")
    joined = parts.join(others, F.coalesce("h", -F.col("row") - 1) == F.col("word"), "left").where("at IS NOT NULL OR path IS NOT NULL")
    tail = F.col("at").isNotNull()
    c, k = F.when(tail, F.coalesce("c", F.lit(0))).otherwise(0), F.coalesce("class", F.lit(RARE))
    size = F.element_at(F.lit([float(x) for x in model.class_tokens]), k + 1)
    emitted = F.when(k == RARE, F.lit(-math.log10(model.unseen_types))).otherwise(F.log10(c / size))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + (tail & F.col("c").isNotNull()).cast("int")).alias("n_known"),
        F.sum(F.col("base") + F.when(tail, F.log10(c + F.lit(1.0))).otherwise(0.0)).alias("base"),
        F.sum(F.col("emitted") + F.when(tail, emitted).otherwise(0.0)).alias("emitted"),
        F.max("path").alias("path"),
        F.collect_list(F.when(tail, F.struct("at", k.cast("int").alias("k")))).alias("found"),
    )
    out = out.drop("row").mapInArrow(_fill, f"doc_id {id_type}, n_tokens bigint, n_known bigint, base double, emitted double, path binary")
    return materialize(out, "classlm-paths", "zstd")


def _count_steps(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total * total, np.int64)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                at = np.frombuffer(path, np.int16).astype(np.int64)
                counts += np.bincount(at[:-1] * total + at[1:], minlength=total * total)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pair", "n"])

    return run


def _with_steps(model: Model, paths: DataFrame) -> Model:
    """The model with the transitions of the training paths."""
    total = len(model.class_tokens)
    seen = paths.select("path").mapInArrow(_count_steps(total), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(total * total)
    bigrams[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    model.step = _steps(bigrams.reshape(total, total), model.class_tokens, model.unseen)
    return model


def fit(docs: DataFrame, classes: int = CLASSES, known: int = KNOWN, sweeps: int = SWEEPS, rounds: int = ROUNDS, head: int = HEAD) -> tuple[Model, DataFrame, DataFrame]:
    """The model, (h, n) of all words of the training documents ``docs``, and (h, n, class) of them."""
    rows = hashed(docs)
    model, vocabulary, classed = _learned(rows, classes, known, sweeps, rounds, head)
    return _with_steps(model, _paths(rows, model, classed)), vocabulary, classed


def _walk(step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                at = np.frombuffer(path, np.int16)
                out.append(float(step[at[:-1], at[1:]].sum()))
            rest = [c for c in batch.schema.names if c != "path"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.float64())], names=[*rest, "walked"])

    return run


def score(docs: DataFrame, classes: int = CLASSES, known: int = KNOWN, sweeps: int = SWEEPS, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out. Null and empty text has its end alone; a text of any length is scored whole;
    a null id counts as empty text in the hash. A word that training lacks has a class of its own. Rows are numbered and
    scored one by one, so repeated rows get equal results, and in training they count as often as they are there. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = hashed(docs)
    model, _, classed = _learned(rows.where(~held_out()), classes, known, sweeps, rounds, head)
    paths = _paths(rows, model, classed)
    model = _with_steps(model, paths.where(~held_out()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = paths.mapInArrow(_walk(model.step), f"doc_id {id_type}, n_tokens bigint, n_known bigint, base double, emitted double, walked double")
    n_tokens = F.col("n_tokens")
    out = out.select(
        "doc_id",
        held_out().alias("held_out"),
        n_tokens.alias("n_tokens"),
        F.col("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") - n_tokens * F.lit(math.log10(model.total + model.types + 1))).alias("base_score"),
        (F.col("walked") + F.col("emitted")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_classlm(spark, sf_dir: str) -> DataFrame:
    """score() over whole ``documents``; its docstring says what null, empty and repeated rows give."""
    return score(table(spark, sf_dir, "documents")).drop("perplexity")
