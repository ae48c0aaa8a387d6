"""Benchmark decontamination.

Words are runs of letters and digits, A-Z lower-cased, so that decoration and punctuation hide nothing. For every
benchmark item, windows of as many words slide over each document, and a window matches if its weighted shingle
similarity to the item reaches the threshold: Jaccard over the five-word shingles with their multiplicities, each
weighted by its letters, so that content counts for more than little words. A window of an item of fewer than five
words is one shingle, and matches if it is the same.

A window that reaches the threshold shares that part of the item's weight, so only windows with as much weight in
shingles of items of their length are fingerprinted: SimHash, from running sums of the square roots of weights. A multi-index over six
blocks of the items' fingerprints finds all within the radius: of two fingerprints at most r bits apart, one block
differs in r // 6 bits at most, and all such values are looked up among items of the window's length. What it finds is
then verified exactly. Nothing about an item depends on other items, so they can be matched a bounded slice at a time;
documents are read once a slice and nothing is shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import spread
from textloom.llm.common import Words, blocks, documents, mix, runs

K, PERCENT = 5, 75
#: Bits that fingerprints may differ by, and the bits of their blocks.
RADIUS, BLOCKS = 17, (11, 11, 11, 11, 10, 10)
#: Items, and bytes of their texts, sent to the tasks at once; more are matched in several passes over the documents.
ITEMS, ITEM_BYTES = 20_000, 1 << 26
#: Windows looked up at once.
LOOKED_UP = 2048
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)


def simhash_steps(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Signed roots of weights of each shingle for the 64 bits."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.uint8).reshape(-1, 8), axis=1)
    root = np.sqrt(weights)[:, None]
    return np.where(bits, root, -root)


def prints_of(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as 64-bit numbers, of rows of sums; sums within rounding of zero are a zero bit."""
    return np.packbits(sums > 1e-6, axis=1).view(">u8").astype(np.uint64).reshape(-1)


class HammingIndex:
    """Fingerprints by group and by the values of their blocks."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.shifts = np.cumsum([0, *BLOCKS[:-1]])
        # by block, all ways in which so many bits differ
        self.masks = [np.array([sum(1 << b for b in own) for r in range(radius // len(BLOCKS) + 1) for own in itertools.combinations(range(bits), r)], np.int64) for bits in BLOCKS]
        keys = np.concatenate([self._keys(prints, groups, j) for j in range(len(BLOCKS))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], np.tile(np.arange(len(prints)), len(BLOCKS))[order]

    def _keys(self, prints: np.ndarray, groups: np.ndarray, block: int) -> np.ndarray:
        value = (prints >> np.uint64(self.shifts[block])) & np.uint64((1 << BLOCKS[block]) - 1)
        return ((groups.astype(np.int64) * len(BLOCKS) + block) << max(BLOCKS)) | value.astype(np.int64)

    def looked_up(self, prints: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) pairs of the group with a block near enough, each once."""
        pairs = []
        for j, masks in enumerate(self.masks):
            near = (self._keys(prints, np.full(len(prints), group), j)[:, None] ^ masks).reshape(-1)
            low = np.searchsorted(self.keys, near, "left")
            n = np.searchsorted(self.keys, near, "right") - low
            pairs.append(np.repeat(np.repeat(np.arange(len(prints)), len(masks)), n) * len(self.prints) + self.numbers[spread(low, n)])
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.prints)))

    def search(self, prints: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, print) pairs of the group within the radius."""
        query, number = self.looked_up(prints, group)
        near = np.bitwise_count(prints[query] ^ self.prints[number]) <= self.radius
        return query[near], number[near]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])


class Text:
    """A text's words: hashes, the shingle from each on (as far as there are k), and its letters."""

    def __init__(self, hashes: np.ndarray, letters: np.ndarray, k: int):
        self.hashes, self.shingles = hashes, runs(hashes, k)
        total = _sums(letters.astype(np.int64))
        self.weights = total[k:] - total[:-k] if len(hashes) >= k else np.zeros(0, np.int64)


class Benchmark:
    """Items ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], k: int = K, percent: int = PERCENT, radius: int = RADIUS):
        self.k, self.percent = k, percent
        self.ids, self.lengths, self.totals = [], [], []
        self.sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        short: dict[int, list[tuple[int, int]]] = {}
        sums = []
        for item_id, text in items:
            data = _PLAIN[np.frombuffer(text.encode(), np.uint8)]
            words = Words(data, np.array([0, len(data)]))
            n = len(words.hashes)
            if not n:
                continue
            own = Text(words.hashes, words.ends - words.starts, k)
            if n < k:
                short.setdefault(n, []).append((int(runs(words.hashes, n)[0]), len(self.ids)))
            values, at, counts = np.unique(own.shingles, return_index=True, return_counts=True)
            self.ids.append(item_id)
            self.lengths.append(n)
            self.sets.append((values, counts, own.weights[at]))
            self.totals.append(int(own.weights.sum()))
            sums.append(simhash_steps(own.shingles, own.weights).sum(axis=0))
        lengths = np.array(self.lengths, np.int64)
        self.index = HammingIndex(prints_of(np.array(sums).reshape(-1, 64)), lengths, radius)
        self.known = np.unique(np.concatenate([x for x, _, _ in self.sets])) if self.sets else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        #: by length, the least weight of an item
        self.least: dict[int, int] = {}
        for n, t in zip(self.lengths, self.totals, strict=True):
            self.least[n] = min(t, self.least.get(n, t))
        # of each shingle, in the order of known, the lengths of the items that have it
        held = np.unique(np.array([(p, n) for (x, _, _), n in zip(self.sets, self.lengths, strict=True) for p in np.searchsorted(self.known, x).tolist()], np.int64).reshape(-1, 2), axis=0)
        self.of_length = held[:, 1]
        self.first = np.searchsorted(held[:, 0], np.arange(len(self.known) + 1))
        #: by length under k, the items' hashes in order, and the items of each
        self.short = {n: (np.unique(np.array([h for h, _ in own], np.uint64)), {h: [i for g, i in own if g == h] for h, _ in own}) for n, own in sorted(short.items())}

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        out = self.maybe[(shingles >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.known[np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)] == shingles[at]
        return out

    def near(self, words: Words) -> np.ndarray:
        """Rows of a block that have a shingle of some item; most documents have none."""
        found = [words.owners()[: max(0, len(words.hashes) - self.k + 1)][self.hits(words.runs(self.k)) & words.whole(self.k)]]
        for n, (hashes, _) in self.short.items():
            found.append(words.owners()[: max(0, len(words.hashes) - n + 1)][np.isin(words.runs(n), hashes) & words.whole(n)])
        return np.unique(np.concatenate(found))

    def similarity(self, window: np.ndarray, weight: int, item: int) -> tuple[int, int]:
        """Weight in common of a window's shingles (weighing ``weight``) and an item, and of both together."""
        values, counts, weights = self.sets[item]
        own, n = np.unique(window, return_counts=True)
        _, x, y = np.intersect1d(own, values, assume_unique=True, return_indices=True)
        common = int((np.minimum(n[x], counts[y]) * weights[y]).sum())
        return common, weight + self.totals[item] - common

    def matches(self, text: Text) -> list[tuple[int, int, int, float]]:
        """Of a document, for each item the best window, the first of equals: (item's number, first word, words, similarity)."""
        n, k = len(text.hashes), self.k
        best: dict[int, tuple[float, int, int]] = {}
        for length, (hashes, items) in self.short.items():
            grams = runs(text.hashes, length)
            at = np.flatnonzero(np.isin(grams, hashes))
            for h, first in zip(*np.unique(grams[at], return_index=True), strict=True):
                best.update((i, (1.0, int(at[first]), length)) for i in items[int(h)])
        hits = np.flatnonzero(self.hits(text.shingles))
        known = np.searchsorted(self.known, text.shingles[hits])
        several = self.first[known + 1] - self.first[known]
        place, lengths = np.repeat(hits, several), self.of_length[spread(self.first[known], several)]
        total = _sums(text.weights)
        for length in np.unique(lengths).tolist():
            # a document with fewer words than the item is one window
            width = min(length, n) - k + 1
            own = np.zeros(len(text.weights), np.int64)
            own[place[lengths == length]] = text.weights[place[lengths == length]]
            held = _sums(own)
            weights, held = total[width:] - total[:-width], held[width:] - held[:-width]
            starts = np.flatnonzero(held * 100 >= np.maximum(weights, self.least[length]) * self.percent)
            for at in range(0, len(starts), LOOKED_UP):
                part = starts[at : at + LOOKED_UP]
                low, high = int(part[0]), int(part[-1]) + width
                steps = _sums(simhash_steps(text.shingles[low:high], text.weights[low:high]))
                query, number = self.index.search(prints_of(steps[part - low + width] - steps[part - low]), length)
                for start, item in zip(part[query].tolist(), number.tolist(), strict=True):
                    common, both = self.similarity(text.shingles[start : start + width], int(weights[start]), item)
                    if common * 100 >= both * self.percent and (item not in best or common / both > best[item][0]):
                        best[item] = common / both, start, min(length, n)
        return [(i, start, length, s) for i, (s, start, length) in sorted(best.items())]


def _texts(benchmark: Benchmark, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, Words, slice, list]]:
    """(row, words of the block, the row's words, matches) of rows with a match."""
    words = Words(_PLAIN[data], offsets)
    for row in benchmark.near(words).tolist():
        own = words.of(row)
        found = benchmark.matches(Text(words.hashes[own], words.ends[own] - words.starts[own], benchmark.k))
        if found:
            yield row, words, own, found


def _found(items: list[tuple[int, str]], k: int, percent: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(items, k, percent, radius)
        for rows, data, offsets in blocks(batches):
            ids, out = rows.column("doc_id").to_pylist(), []
            for row, words, own, found in _texts(benchmark, data, offsets):
                for i, start, length, s in found:
                    low, high = words.starts[own.start + start], words.ends[own.start + start + length - 1]
                    out.append((ids[row], benchmark.ids[i], start, length, int(low - offsets[row]), int(high - offsets[row]), s))
            columns = zip(*out, strict=True) if out else ([],) * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "n_words", "byte_start", "byte_end", "similarity"])

    return run


def _clean(items: list[tuple[int, str]], k: int, percent: int, radius: int):
    """Rows with a column text_ -> other columns of those in which no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(items, k, percent, radius)
        for rows, data, offsets in blocks(batches, "text_"):
            clean = np.ones(rows.num_rows, bool)
            clean[[row for row, *_ in _texts(benchmark, data, offsets)]] = False
            yield rows.drop_columns(["text_"]).filter(pa.array(clean))

    return run


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in slices of about ITEMS and ITEM_BYTES at most; one is on the driver at a time."""
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(-(-size.n // ITEMS), -(-size.b // ITEM_BYTES))
    for i in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(x.item_id, x.text) for x in own.orderBy("item_id", "text").toLocalIterator()]


def decontaminate(df: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Matches of benchmark (item_id, text) in df (doc_id, text), one row a document and item, for the best window
    (the first of equals): doc_id, item_id, start and n_words (in words), byte_start and byte_end (in the text's
    UTF-8), similarity.

    A document with fewer words than an item of k words or more is one window; an item of fewer than k words is found
    where the same words stand. Null or empty texts of either table match nothing; null ids are carried as they are;
    repeated rows match as often, and so do repeated items. A text of any length is searched whole, in memory and
    time that grow with its length. Other columns are ignored; empty tables give an empty result.
    """
    docs, schema = documents(df), "doc_id long, item_id long, start long, n_words long, byte_start long, byte_end long, similarity double"
    out = None
    for items in _slices(benchmark):
        part = docs.mapInArrow(_found(items, k, percent, radius), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def uncontaminated(df: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The rows of df (with a column text, whatever else it has but text_) in which decontaminate() finds no item."""
    out = df
    for items in _slices(benchmark):
        rows = out.withColumn("text_", F.coalesce(F.col("text").cast("string"), F.lit("")))
        out = rows.mapInArrow(_clean(items, k, percent, radius), df.schema)
    return out


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
