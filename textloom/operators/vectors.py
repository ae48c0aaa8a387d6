"""Word vectors: looking up, averaging, and nearest neighbours by Manhattan distance, a block of queries at a time.

A table of word vectors is (word, vec); all vecs are as long as another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that are sent to the tasks at once.
BLOCK = 2000


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, near, distance): each query's nearest other vector, the least key of equally near ones.

    Queries go out in blocks of bounded size; each task keeps one candidate a query, so that what is shuffled follows
    the queries and the number of tasks. Null and empty vectors are left out; all others must be as long as another.
    """
    out, held = None, []

    def block(rows: list) -> DataFrame:
        ids, points = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, near = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
            for x in batches:
                own = np.asarray(x.column(0), np.int64)
                data = np.stack([np.asarray(v.values, np.float64) for v in x.column(1)]) if x.num_rows else np.zeros((0, points.shape[1]))
                for at in range(0, len(own), 256):
                    part = data[at : at + 256]
                    apart = np.abs(points[:, None, :] - part[None, :, :]).sum(axis=2)
                    apart[ids[:, None] == own[None, at : at + 256]] = np.inf
                    least = apart.min(axis=1)
                    found = np.where(apart == least[:, None], own[None, at : at + 256], np.iinfo(np.int64).max).min(axis=1)
                    closer = (least < best) | (least == best) & (found < near)
                    best[closer], near[closer] = least[closer], found[closer]
            known = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(near[known]), pa.array(best[known])], [key, "near", "distance"])

        return vectors.filter(F.size(vector) > 0).select(key, vector).mapInArrow(run, f"{key} long, near long, distance double")

    for row in queries.filter(F.size(vector) > 0).select(key, vector).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == BLOCK:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held or out is None:
        part = block(held) if held else queries.sparkSession.createDataFrame([], f"{key} long, near long, distance double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.min(F.struct("distance", "near")).alias("x"))
    return best.select(key, F.col("x.near").alias("near"), F.round("x.distance", 6).alias("distance"))


def vector_of(words: DataFrame, vectors: DataFrame, dims: int, unknown: list[float] | None = None, safe: bool = True) -> DataFrame:
    """(word, vec) of words (word, ...), looked up in lower case; ``unknown`` (else zeros) for those without a vector or
    null. ``safe`` leaves out what stored vectors have beyond their dims, such as a length or an index."""
    if unknown is not None and len(unknown) < dims:
        raise ValueError(f"unknown has fewer than {dims} numbers")
    other = F.array(*[F.lit(float(x)) for x in unknown]) if unknown is not None else F.array_repeat(F.lit(0.0), dims)
    known = vectors.select(F.col("word").alias("_word"), F.col("vec").cast("array<double>").alias("_vec"))
    vec = F.coalesce("_vec", other)
    return words.join(known, F.lower("word") == F.col("_word"), "left").select("word", (F.slice(vec, 1, dims) if safe else vec).alias("vec"))


def document_vectors(terms: DataFrame, vectors: DataFrame, dims: int, precision: int = 6) -> DataFrame:
    """(doc_id, vec, l2) from (doc_id, term): the rounded mean of the terms' vectors, and its length.

    Terms without a vector, or with one of no length, have no say; a document without others has zeros. Terms are
    counted before the join, so that a frequent word is one row a document.
    """
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    known = vectors.select(F.col("word").alias("term"), F.col("vec").cast("array<double>").alias("vec")).filter(length(F.col("vec")) > 0)
    counts = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.join(known, "term").select("doc_id", "n", F.posexplode("vec").alias("i", "x"))
    means = parts.groupBy("doc_id", "i").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), precision).alias("x"))
    rows = means.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("vec"))
    whole = terms.select("doc_id").distinct().join(rows, "doc_id", "left").select("doc_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec"))
    return whole.withColumn("l2", F.round(length(F.col("vec")), precision))


def contextual_vectors(terms: DataFrame, vectors: DataFrame, dims: int, specific: tuple[str, ...] = (), similar: bool = False, limit: int = 0) -> DataFrame:
    """(word, word_index, vec): the vectors that a corpus needs, from its terms (term) and words (word, word_index, vec).

    The vocabulary is the distinct terms and the specific words that are not blank; those without a vector have zeros and
    come last, with no word_index. ``similar`` adds each known word's nearest other word. ``limit`` fills up with the words
    of least word_index until there are as many; it must be less than the number of vectors, else ValueError.
    """
    spark = terms.sparkSession
    if not isinstance(limit, int) or limit < 0 or limit and limit >= vectors.count():
        raise ValueError(f"limit {limit}")
    listed = spark.createDataFrame([(w,) for w in specific if w.strip()], "word string")
    wanted = terms.filter("term is not null").select(F.lower("term").alias("word")).unionByName(listed).distinct()
    table = vectors.select("word", F.col("word_index").cast("long").alias("word_index"), F.col("vec").cast("array<double>").alias("vec"))
    if similar:
        close = nearest(table.join(wanted, "word", "left_semi"), table, "word_index", "vec")
        wanted = wanted.unionByName(table.join(close.select(F.col("near").alias("word_index")), "word_index", "left_semi").select("word")).distinct()
    if limit:
        more = limit - wanted.count()
        if more > 0:
            wanted = wanted.unionByName(table.join(wanted, "word", "left_anti").orderBy("word_index").limit(more).select("word"))
    rows = wanted.join(table, "word", "left")
    return rows.select("word", "word_index", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec")).orderBy(F.asc_nulls_last("word_index"), "word")
