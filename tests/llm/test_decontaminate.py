"""Benchmark decontamination against brute force over all item-sized windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate as D


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def weight(bag):
    return sum(c * len(x) for g, c in bag.items() for x in g)


def brute(text, item):
    """(start, words, similarity) of the best window, the first of equals; None if none reaches the threshold."""
    w, own = words(text), words(item)
    m, best = len(own), None
    if 0 < m < 5:
        return next(((s, m, 1.0) for s in range(len(w) - m + 1) if w[s : s + m] == own), None)
    if m and len(w) >= 5:
        b, n = shingles(own), min(m, len(w))
        for s in range(len(w) - n + 1):
            a = shingles(w[s : s + n])
            common = weight(a & b)
            both = weight(a) + weight(b) - common
            if common * 100 >= both * 75 and (best is None or common / both > best[2]):
                best = s, n, common / both
    return best


def made(seed, n_docs=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    template = prose(9)
    items = [(i, prose(rng.choice([2, 3, 4, 5, 6, 8, 12, 20, 30, 60])) if i % 3 else f"{template} {prose(rng.randint(0, 25))}") for i in range(60)]
    items += [(0, items[0][1]), (None, items[1][1]), (99, None), (98, " ?! "), (97, "")]

    def edited(text):
        w = text.split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [f"{rng.choice(vocabulary).upper()}!"] * rng.randint(0, 1)
        return " ".join(w)

    docs = []
    for i in range(n_docs):
        item, kind = edited(rng.choice(items[:60])[1]), rng.random()
        docs.append((i, f"{prose(rng.randint(0, 40))} {item} {prose(rng.randint(0, 40))}" if kind < 0.7 else item if kind < 0.85 else prose(60) if kind < 0.95 else template))
    return items, [*docs, (3, docs[3][1]), (None, items[4][1]), (500, None), (501, ""), (502, f"{prose(3000)} {items[5][1]}"), (503, "...")]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    items, docs = made(seed)
    want = sorted(str((d, i, *found)) for d, t in docs for i, x in items if t and (found := brute(t, x)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "similarity": F.lit("x"), "words": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    clean = sorted(str(d) for d, t in docs if not any(brute(t, x) for _, x in items))
    for limit in (D.ITEMS, 20):  # in one pass, and in several
        monkeypatch.setattr(D, "ITEMS", limit)
        got = D.decontaminate(df, bench).collect()
        assert sorted(str((r.doc_id, r.item_id, r.start, r.n_words, r.similarity)) for r in got) == want
        text = dict(docs)
        for r in got:
            if r.doc_id is not None:
                assert len(words(text[r.doc_id].encode()[r.byte_start : r.byte_end].decode())) == r.n_words
        left = D.uncontaminated(df, bench)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == clean


def test_empty(spark):
    df, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for a, b in ((df.filter("false"), bench), (df, bench.filter("false"))):
        assert D.decontaminate(a, b).count() == 0
        assert D.uncontaminated(a, b).count() == a.count()


def test_recall_of_fingerprints():
    """Of windows at the threshold or little over it, at least nine tenths have fingerprints within the radius."""
    rng = np.random.default_rng(3)
    near = n = 0
    for _ in range(2000):
        size = int(rng.integers(8, 200))
        item, weights = rng.integers(0, 1 << 63, size, dtype=np.uint64), rng.integers(8, 50, size)
        window, other = item.copy(), weights.copy()
        gone = rng.permutation(size)[: int(size * rng.uniform(0.09, 0.14))]
        window[gone], other[gone] = rng.integers(0, 1 << 63, len(gone), dtype=np.uint64), rng.integers(8, 50, len(gone))
        common = np.delete(weights, gone).sum()
        if common * 100 >= 75 * (weights.sum() + other.sum() - common):
            a, b = (D.prints_of(D.simhash_steps(x, w).sum(axis=0)[None]) for x, w in ((item, weights), (window, other)))
            near, n = near + int(np.bitwise_count(a ^ b)[0] <= D.RADIUS), n + 1
    assert n > 500 and near / n >= 0.95


def test_hamming_index():
    rng = np.random.default_rng(1)
    number = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    prints, groups = number(300), rng.integers(5, 8, 300)
    flips = np.array([sum(1 << b for b in rng.permutation(64)[: int(rng.integers(0, 24))]) for _ in prints], object).astype(np.uint64)
    index = D.HammingIndex(prints, groups)
    queries = np.concatenate([number(50), prints ^ flips])
    for group in (5, 6, 7, 8):
        got = set(zip(*(x.tolist() for x in index.search(queries, group)), strict=True))
        assert got == {(i, j) for i, x in enumerate(queries) for j in range(300) if groups[j] == group and np.bitwise_count(x ^ prints[j]) <= D.RADIUS}
    assert len(index.looked_up(number(200), 6)[0]) < 0.25 * 200 * (groups == 6).sum()
    assert not len(D.HammingIndex(number(0), np.zeros(0, np.int64)).search(queries, 5)[0])
