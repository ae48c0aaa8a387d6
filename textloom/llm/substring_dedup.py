"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window - k + 1`` consecutive k-word runs the one with the least hash, so any
two equal windows hold the same anchor. Documents meet on anchors that two different texts share; from a shared
anchor a match is extended both ways to every window that holds it, and a window is a repeat if its words also start
in a document with a smaller id. Overlapping repeats join into maximal ones, which are removed.

Equal texts are one class, represented by its least doc_id; a longer copy goes whole. Nothing is paired: each
phase groups by anchor or by window and takes a minimum, so a passage in a third of all documents costs no more rows
than its occurrences. Window hashes have 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Words, blocks, discard, documents, release, store

WINDOW = 13
K = 7


def _anchor_mask(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word runs, and which of them are anchors."""
    grams, w = words.runs(k), window - k + 1
    picked = np.zeros(len(grams), bool)
    at = np.flatnonzero(words.whole(window))
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(grams, w)[at]
        picked[at + view.argmin(axis=1)] = True
    return grams, picked


def _anchors(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            grams, picked = _anchor_mask(words, window, k)
            at = np.flatnonzero(picked)
            keys = np.asarray(rows.column("key"))[words.owners()[at]]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(keys)], ["anchor", "key"])

    return run


def _windows(window: int, k: int):
    """Windows that hold a shared anchor: (w, w2, doc_id, key, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            grams, picked = _anchor_mask(words, window, k)
            shared = np.zeros(len(words.hashes) + 1, np.int64)
            lists = rows.column("anchors")
            for row in range(rows.num_rows):
                at = words.of(row)
                if at.stop - at.start >= window:
                    own = slice(at.start, at.stop - k + 1)
                    hit = np.flatnonzero(picked[own] & np.isin(grams[own], np.asarray(lists[row].values, np.int64).view(np.uint64))) + at.start
                    np.add.at(shared, np.maximum(hit - (window - k), at.start), 1)
                    np.add.at(shared, np.minimum(hit, at.stop - window) + 1, -1)
            near = np.cumsum(shared[:-1])[: max(0, len(words.hashes) - window + 1)] > 0
            at = np.flatnonzero(near & words.whole(window))
            owner = words.owners()[at]
            w, w2 = words.runs(window)[at], words.runs(window, second=True)[at]
            ids = np.asarray(rows.column("doc_id"))[owner]
            keys = np.asarray(rows.column("key"))[owner]
            pos = (at - words.bounds[owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids), pa.array(keys), pa.array(pos)], ["w", "w2", "doc_id", "key", "pos"])

    return run


def covered(positions: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the positions."""
    mark = np.zeros(n + 1, np.int64)
    at = np.unique(positions)
    mark[at] += 1
    np.subtract.at(mark, np.minimum(at + window, n), 1)
    return np.cumsum(mark[:-1]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words, raw = Words(data, offsets), data.tobytes()
            wholes, lists = rows.column("whole").to_pylist(), rows.column("positions")
            n_words, n_removed, kept = [], [], []
            for row in range(rows.num_rows):
                at = words.of(row)
                n = at.stop - at.start
                gone = np.zeros(n, bool)
                if n >= window and wholes[row]:
                    gone[:] = True
                elif n >= window and lists[row].is_valid:
                    gone = covered(np.asarray(lists[row].values), n, window)
                spans = zip(words.starts[at][~gone].tolist(), words.ends[at][~gone].tolist(), strict=True)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([raw[a:b] for a, b in spans]).decode())
            carried = rows.drop_columns(["text", "whole", "positions"])
            yield pa.RecordBatch.from_arrays([*carried.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*carried.schema.names, "n_words", "n_removed", "kept"])

    return run


def substring_dedup(df: DataFrame, window: int = WINDOW, k: int = K, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, the columns to carry, n_words, n_removed, kept (words joined by one space).

    Null or empty text: no words, nothing removed. Null doc_id: the row is kept whole and is nobody's earlier
    document. Rows that repeat a doc_id are not earlier than each other. A text of any length is one row of one task,
    whose windows are rows. Other columns are ignored. An empty table gives an empty result. ``k`` must be at most ``window`` and at least half of it.
    """
    spark = df.sparkSession
    docs = documents(df).withColumn("key", F.xxhash64("text"))
    named = docs.filter("doc_id is not null")

    # seeds: anchors that two different texts share, listed by text
    anchors = named.mapInArrow(_anchors(window, k), "anchor long, key long")
    shared = store(anchors.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("anchor"))
    release(spark)
    seeds = store(anchors.join(shared, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    discard(shared)
    release(spark)

    # equal texts are a class; its first document stands for it, all others are copies
    ids = named.select("doc_id", "key", F.md5("text").alias("digest"))
    classes = store(ids.groupBy("key", "digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    several = classes.filter("n > 1").drop("n")
    copies = ids.join(several, ["key", "digest"]).filter("doc_id > first_id").select("doc_id", "key").distinct()

    # extension: every window around a seed, and the first document that has it
    firsts = classes.select("key", F.col("first_id").alias("doc_id")).join(seeds, "key")
    windows = store(named.join(firsts, ["key", "doc_id"]).select("doc_id", "key", "text", "anchors").mapInArrow(_windows(window, k), "w long, w2 int, doc_id long, key long, pos int"))
    release(spark)
    earliest = store(windows.groupBy("w", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("w", "w2", "a"))
    release(spark)
    repeats = windows.join(earliest, ["w", "w2"]).filter("doc_id > a").groupBy("doc_id", "key").agg(F.collect_set("pos").alias("positions"))
    found = store(repeats.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True))
    discard(windows, earliest, seeds, classes)
    release(spark)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    rows = rows.withColumn("key", F.xxhash64("text")).join(found, ["doc_id", "key"], "left").drop("key")
    schema = rows.select("doc_id", *carry).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return rows.mapInArrow(_cut(window), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
