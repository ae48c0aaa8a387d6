"""N-gram Jaccard join with T-occurrence search (DivideSkip).

Documents with equal shingle sets are one class. Classes meet on prefixes: by a total order of shingles, two sets of
Jaccard similarity t or more share one of the first n - ceil(t n) + 1 shingles of either. The order is by hash, with
frequent shingles last, so that a line or passage common to many documents hardly ever brings them together; the
frequent ones are a list of bounded length, and any such list gives the same links. Prefixes are taken longer than
that by n // 10, and then linked sets share n // 10 + 1 shingles of them; sets that share fewer with all others drop out.

Candidates are searched by T-occurrence: a block of candidates is an inverted index over the query's shingles; its
short lists are heap-merged, its long lists binary-probed, and sets that reach the required overlap remain, which is
exact. First every class is searched against one centre of each prefix group and size band, so that a group of n near
copies costs n searches. What that leaves apart, but shares a prefix shingle and could reach the overlap, is searched
pair by pair where few sets have the shingle, and block against block where many have it.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import spread
from textloom.llm.common import Shingles, Words, blocks, discard, documents, mix, release, shingle_sets, store
from textloom.llm.components import components

K = 5
#: Similarity in hundredths.
PERCENT = 75
#: Most shingles in the list of frequent ones, the least count in it, and shingles counted at once in a task.
FREQUENT, AT_LEAST, COUNTED = 1 << 17, 16, 1 << 22
#: A prefix is longer than it must be by one shingle in so many, and as many more must then be shared.
EXTRA = 10
#: Rounds of dropping sets, and shingles, that too few others share; each is a sound filter.
ROUNDS = 2
#: Sets that make a shingle's sets a family, and bytes of sets in a block of one, about: a set goes to as many tasks as
#: its family has blocks.
DENSE, CELL_BYTES = 64, 1 << 23
#: Weight of the logarithm in DivideSkip's choice of long lists.
MU = 0.0085


def required(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m elements whose similarity reaches percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids found in at least ``least`` of the sorted lists, with their number of lists.

    The longest lists are set aside; an id must then occur often enough among the short ones, which are merged by a
    heap, and only such ids are looked up in the long ones by bisection.
    """
    if least < 1 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found, last, count = {}, None, 0
    for x in heapq.merge(*short):
        if x == last:
            count += 1
            continue
        if last is not None and count >= least - aside:
            found[last] = count
        last, count = x, 1
    if last is not None and count >= least - aside:
        found[last] = count
    out = {}
    for x, count in found.items():
        for left, own in zip(range(len(long), 0, -1), reversed(long), strict=True):
            if count + left < least:
                break
            at = bisect_left(own, x)
            count += at < len(own) and own[at] == x
        if count >= least:
            out[x] = count
    return out


def _keys(found: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, as two signed longs; 0 for empty sets."""
    return found.sums(mix(found.values)).view(np.int64), found.sums(mix(found.values ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall in each of a power of two of buckets, about one a bucket; None beyond a byte's range."""
    buckets = 1 << max(4, min(16, int(len(shingles)).bit_length()))
    counts = np.bincount((shingles >> np.uint64(48)).astype(np.int64) % buckets, minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most(a: bytes | None, b: bytes | None) -> int | None:
    """No overlap of two sets is larger than the sum of the lesser counts of their sketches; None: unknown."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)).sum())


def _sets(k: int):
    """A row for each document, and for shingles that a few documents of a task share (frequent: their count there)."""
    names = ["doc_id", "key", "key2", "n", "sketch", "frequent"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= 4
        n = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(values[keep].view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(counts[keep])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows, data, offsets in blocks(batches):
            found = Shingles(Words(data, offsets, fold=True), k)
            key, key2 = _keys(found)
            sketches = [sketch(found.of(row)) if found.sizes[row] else None for row in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(key), pa.array(key2), pa.array(found.sizes.astype(np.int64)), pa.array(sketches, pa.binary()), pa.nulls(rows.num_rows, pa.int64())], names)
            held.append(found.values)
            n += len(found.values)
            if n >= COUNTED:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    return run


def _prefixes(k: int, percent: int, frequent: np.ndarray):
    """frequent: hashes, most frequent first. The order: others by hash, then frequent ones, the rarer first."""
    by_hash = np.argsort(frequent)
    ordered, place = frequent[by_hash], len(frequent) - by_hash
    maybe = np.zeros(1 << 20, bool)
    maybe[(ordered >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches):
            found = Shingles(Words(data, offsets, fold=True), k)
            if not len(found.values):
                continue
            at = found.place()
            hits = np.flatnonzero(maybe[(found.values >> np.uint64(44)).astype(np.int64)])
            if len(hits):
                near = np.minimum(np.searchsorted(ordered, found.values[hits]), len(ordered) - 1)
                same = ordered[near] == found.values[hits]
                hits, rank = hits[same], place[near[same]]
                weight = np.zeros(len(at), np.int64)
                weight[hits] = rank
                for row in np.unique(found.owner[hits]):
                    own = slice(found.bounds[row], found.bounds[row + 1])
                    at[own][np.argsort(weight[own], kind="stable")] = np.arange(own.stop - own.start)
            sizes = found.sizes[found.owner]
            own = np.flatnonzero(at < sizes - -(-percent * sizes // 100) + 1 + sizes // EXTRA)
            keys = _keys(found)[0][found.owner[own]]
            yield pa.RecordBatch.from_arrays([pa.array(found.values[own].view(np.int64)), pa.array(keys), pa.array(sizes[own].astype(np.int32)), pa.array(at[own].astype(np.int32))], ["h", "key", "n", "i"])

    return run


def _possible(percent: int):
    """Pairs (a, centre, n, n2, sketch, sketch2) that could reach the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n, m, s, t = (x.column(c).to_pylist() for c in ("n", "n2", "sketch", "sketch2"))
            keep = []
            for i in range(x.num_rows):
                bound = most(s[i], t[i])
                keep.append(bound is None or bound >= required(n[i], m[i], percent))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("centre")], ["a", "centre"]).filter(pa.array(keep, pa.bool_()))

    return run


def _only(k: int):
    """Rows whose text has the class's set: a repeated doc_id may bring another text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            same = pa.array(_keys(Shingles(Words(data, offsets, fold=True), k))[0] == np.asarray(rows.column("key")))
            yield pa.RecordBatch.from_arrays([rows.column("key").filter(same), rows.column("text").filter(same)], ["key", "text"])

    return run


class Lists:
    """The inverted lists of a block of sets: by shingle, the numbers of the sets that have it, in ascending order."""

    def __init__(self, sets: list[np.ndarray]):
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.values, self.owners = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def of(self, query: np.ndarray, wanted: np.ndarray | None = None) -> list[list[int]]:
        """The lists of the query's shingles, of ``wanted`` sets only (by number, true or false)."""
        low = np.searchsorted(self.values, query, "left")
        n = np.searchsorted(self.values, query, "right") - low
        owners, which = self.owners[spread(low, n)], np.repeat(np.arange(len(query)), n)
        if wanted is not None:
            owners, which = owners[wanted[owners]], which[wanted[owners]]
        ends = np.flatnonzero(np.diff(which)) + 1
        held = owners.tolist()
        return [held[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(held)], strict=True)] if held else []


def search(query: np.ndarray, lists: Lists, percent: int, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Which sets of the block link with the query, and their overlap, by T-occurrence over its shingles' lists."""
    n = len(query)
    found = divide_skip(lists.of(query, wanted), -(-percent * n // 100))
    return [(x, count) for x, count in found.items() if count >= required(n, int(lists.sizes[x]), percent)]


def _searched(k: int, percent: int):
    """Rows (a, text, centre, other), those of a centre together -> links (a, centre, overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            sets = shingle_sets(Words(data, offsets, fold=True), k)
            keys, centres, others = rows.column("a").to_pylist(), rows.column("centre").to_pylist(), rows.column("other")
            out: list[tuple[int, int, int]] = []
            at = 0
            for centre, group in itertools.groupby(centres):
                size = len(list(group))
                text = others[at].as_py().encode()
                own = shingle_sets(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), fold=True), k)[0]
                out += [(keys[at + x], centre, count) for x, count in search(own, Lists(sets[at : at + size]), percent)]
                at += size
            yield _as_links(out)

    return run


def _as_links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "overlap"])


def _in_cell(percent: int):
    """A cell's sets (key, root, i, j, block, shingles, sketch) -> links between its blocks i and j, but none between
    sets that other links of the cell have joined already."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        keys, blocks_, roots = (cell.column(c).to_pylist() for c in ("key", "block", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        sketches = cell.column("sketch").to_pylist()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        left = [x for x in range(len(keys)) if blocks_[x] == i]
        right = np.array([x for x in range(len(keys)) if blocks_[x] == j], np.int64)
        folded: dict[int, np.ndarray] = {}

        def at_most(query: bytes, size: int) -> np.ndarray:
            """Bounds of the overlap with all of the right block, on sketches of one size."""
            if size not in folded:
                folded[size] = np.array([np.frombuffer(sketches[x], np.uint8).reshape(-1, size).sum(axis=0) if sketches[x] is not None and len(sketches[x]) >= size else np.full(size, 1 << 30) for x in right], np.int64).reshape(len(right), size)
            own = np.frombuffer(query, np.uint8).reshape(-1, size).sum(axis=0)
            return np.minimum(folded[size], own).sum(axis=1)

        smallest = min((len(x) for x in sketches if x is not None), default=0)
        lists, out = Lists([sets[x] for x in right]), []
        for x in left:
            other = right[right > x] if i == j else right
            place = np.flatnonzero(right > x) if i == j else np.arange(len(right))
            fits = np.minimum(sizes[other], sizes[x]) * 100 >= np.maximum(sizes[other], sizes[x]) * percent
            need = -(-percent * (sizes[other] + sizes[x]) // (100 + percent))
            if sketches[x] is not None:
                for size in {smallest, len(sketches[x])}:
                    fits &= at_most(sketches[x], size)[place] >= need
            mine = root(roots[x])
            wanted = np.zeros(len(right), bool)
            wanted[[int(y) for y in place[fits] if root(roots[right[y]]) != mine]] = True
            for y, count in search(sets[x], lists, percent, wanted) if wanted.any() else ():
                if (a := root(roots[x])) != (b := root(roots[right[y]])):
                    joined[max(a, b)] = min(a, b)
                    out.append((keys[x], keys[right[y]], count))
        return pa.Table.from_batches([_as_links(out)])

    return run


def _links(texts: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Which pairs (a, centre) are links. Joins have stored sides, so that a skewed centre can be split."""
    spark = texts.sparkSession
    with_a = store(pairs.join(classes.select(F.col("key").alias("a"), "n", "sketch"), "a"))
    both = with_a.join(classes.select(F.col("key").alias("centre"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "centre")
    possible = store(both.select("a", "centre", "n", "n2", "sketch", "sketch2").mapInArrow(_possible(percent), "a long, centre long"))
    discard(with_a)
    release(spark)
    with_a = store(possible.join(texts.withColumnRenamed("key", "a"), "a"))
    rows = with_a.join(texts.select(F.col("key").alias("centre"), F.col("text").alias("other")), "centre")
    links = store(rows.select("a", "text", "centre", "other").mapInArrow(_searched(k, percent), "a long, b long, overlap long"))
    discard(with_a, possible)
    release(spark)
    return links


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, text of the classes (key, doc_id) wanted: the one phase that moves all texts."""
    return store(docs.join(wanted.hint("merge"), "doc_id").select("key", "text").mapInArrow(_only(k), "key long, text string").dropDuplicates(["key"]))


def _as_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            sets = [x.tobytes() for x in shingle_sets(Words(data, offsets, fold=True), k)]
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(sets, pa.binary())], ["key", "shingles"])

    return run


def _within_families(texts: DataFrame, classes: DataFrame, left: DataFrame, many: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within families: for each centre the sets that have one of its shingles. A family's blocks of about
    CELL_BYTES are searched against each other, a cell of two blocks at a time."""
    family = store(left.join(many, "h").select("centre", "key", "root").distinct())
    sized = family.join(classes.select("key", "n"), "key")
    sizes = sized.groupBy("centre").agg(F.ceil(F.sum(8 * F.col("n") + 64) / CELL_BYTES).cast("int").alias("n_blocks"))
    members = store(family.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")))
    wanted = texts.join(members.select("key").distinct(), "key")
    sets = store(wanted.mapInArrow(_as_sets(k), "key long, shingles binary").join(classes.select("key", "sketch"), "key"))
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("centre", "key", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    cells = store(dealt.join(sets, "key"))
    links = store(cells.groupBy("centre", "i", "j").applyInArrow(_in_cell(percent), "a long, b long, overlap long"))
    discard(family, members, sets, cells)
    release(texts.sparkSession)
    return links


def jaccard_links(df: DataFrame, k: int = K, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members doc_id, n, key, key2 of each row of df; links (a, b, overlap) between keys of different sets.

    Together with the classes (rows of one key) the links span every pair that reaches the similarity: two classes
    are in one component exactly if a chain of such pairs joins them. Empty sets (key 0) link with nothing.
    """
    spark = df.sparkSession
    docs = documents(df)
    rows = store(docs.mapInArrow(_sets(k), "doc_id long, key long, key2 long, n long, sketch binary, frequent long"))
    sets = rows.filter("frequent is null")
    hot = rows.filter("frequent is not null").groupBy("key").agg(F.sum("frequent").alias("n")).filter(F.col("n") >= AT_LEAST)
    hot = hot.orderBy(F.desc("n"), "key").limit(frequent).collect()
    order = np.array([x.key for x in hot], np.int64).view(np.uint64)

    prefixes = docs.filter("doc_id is not null").mapInArrow(_prefixes(k, percent, order), "h long, key long, n int, i int")
    met = store(prefixes.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("h"))
    release(spark)
    shared = store(prefixes.join(met, "h", "left_semi").groupBy("h", "key").agg(F.min("n").alias("n"), F.min("i").alias("i")))
    discard(met)
    release(spark)
    # a set shares sizes // EXTRA + 1 shingles of its prefix with each of its links, or as many of the smaller one's
    least = F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA) + 1
    for _ in range(ROUNDS):
        enough = store(shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).filter(F.col("c") >= least).select("key"))
        fewer = store(shared.join(enough, "key", "left_semi"))
        several = store(fewer.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
        left = store(fewer.join(several, "h", "left_semi"))
        discard(shared, enough, fewer, several)
        shared = left
        release(spark)
    # one row a class that meets another; with the first document of its first set of that key
    classes = sets.filter("n > 0 and doc_id is not null").join(shared.select("key").distinct(), "key", "left_semi")
    classes = store(classes.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))

    texts = _texts(docs, classes.select("key", "doc_id"), k)
    release(spark)

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) if percent < 100 else 1.0))
    banded = store(shared.withColumn("band", band))
    centres = store(banded.groupBy("h", "band").agg(F.min("key").alias("centre"), F.max("key").alias("top")).filter("centre <> top").drop("top"))
    stars = store(banded.join(centres, ["h", "band"]).filter("key <> centre").select(F.col("key").alias("a"), "centre").distinct())
    discard(banded, centres)
    links = _links(texts, classes, stars, k, percent)

    roots = store(components(links.select("a", "b")))
    rooted = store(shared.join(roots, shared.key == roots.node, "left").select("h", "key", "n", "i", F.coalesce("root", "key").alias("root")))
    apart = store(rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h"))
    left = store(rooted.join(apart, "h", "left_semi"))
    discard(rooted, apart, shared, roots)
    # a shingle of many sets: its sets are a family, searched block by block; one of few: pairs
    many = store(left.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("centre")).filter(F.col("c") >= DENSE).drop("c"))
    within = _within_families(texts, classes, left, many, k, percent)
    few = store(left.join(many.select("h"), "h", "left_anti"))
    discard(many, left)
    other = few.select("h", *(F.col(x).alias(f"{x}2") for x in ("key", "n", "i", "root")))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent))
    could = F.least("i", "i2") + F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    pairs = few.join(other, "h").filter((F.col("key") < F.col("key2")) & (F.col("root") != F.col("root2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (could >= need))
    pairs = store(pairs.select(F.col("key").alias("a"), F.col("key2").alias("centre")).distinct())
    known = stars.unionByName(stars.select(F.col("centre").alias("a"), F.col("a").alias("centre")))
    rest = store(pairs.join(known, ["a", "centre"], "left_anti"))
    discard(few, stars, pairs)
    release(spark)
    found = _links(texts, classes, rest, k, percent).unionByName(within)
    discard(rest, classes, texts)
    return sets, links.unionByName(found)


def jaccard_join(df: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable by links).

    Words have A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence as one if there are
    fewer words. Null, empty and blank texts have an empty set, which links with nothing: component_id is doc_id. A
    null doc_id links with nothing and has a null component_id. Rows that repeat are returned as often. A text of any
    length is one set, which a task holds. Other columns are ignored; an empty table gives an empty result.
    """
    sets, links = jaccard_links(df, k, percent)
    roots = store(components(links.select("a", "b")))
    named = sets.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("key", "key2").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(roots, classes.key == roots.node, "left").select("key", "key2", "class_id", F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("key2")).alias("alone"))
    classes = store(classes)
    least = store(classes.groupBy("root", "alone").agg(F.min("class_id").alias("component_id")))
    classes = store(classes.join(least, (classes.root == least.root) & classes.alone.eqNullSafe(least.alone)).select("key", "key2", "component_id"))
    release(df.sparkSession)
    return sets.join(classes, ["key", "key2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
