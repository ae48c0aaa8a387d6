"""Byte-level BPE encoding and decoding.

Encoding a document means encoding its words (matches of the pattern) one by one, so the merges run over distinct
words only. ``fold_words`` is the relational form: Spark's ``aggregate`` folds ranked merges over an array of byte
pieces, with the ranks in a literal map, and decoding concatenates the pieces. ``bpe`` runs the same fold over the
distinct words of each task, in an Arrow function: nothing is shuffled, and each word is merged once a task.
See the README for why it, and not ``fold_words``, encodes whole tables.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.chunks import SPACE_LED, ChunkTable, spread, table_of
from textloom.llm.common import blocks, documents

#: Bytes of text whose chunks are looked up at once, and chunks that a worker remembers.
BLOCK_BYTES, REMEMBERED = 1 << 21, 1 << 18
#: Buckets of the literal rank map, each a small map that is searched in order.
BUCKETS = 1 << 16
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 pieces and their ranks, which are the ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank, leftmost first, is merged until no pair has a rank.

    Pairs wait in a heap and pieces are a linked list, so that a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n > 64:
        return _fold_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(n)]
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(n - 1)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + pieces[i], NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(pieces[i] + pieces[i + 1], NONE)
    return [ranks[x] for x in pieces]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != to:
            continue
        end[i], end[middle] = to, -1
        if to < n:
            before[to] = i
            if (r := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:to])) is not None:
            heapq.heappush(heap, (r, left, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Ranked:
    """Ids of new chunks: a chunk's words are folded one by one. One of ASCII letters alone, perhaps after a space, is
    one word, without the pattern's help."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.split, self.led = read_ranks(path), regex.compile(pattern).findall, pattern == SPACE_LED
        pieces = sorted((v, k) for k, v in self.ranks.items())
        # pieces by id, one after the other
        n = pieces[-1][0] + 1 if pieces else 0
        self.lengths = np.zeros(n, np.int64)
        self.lengths[[v for v, _ in pieces]] = [len(k) for _, k in pieces]
        self.starts, self.pieces = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join([k for _, k in pieces]), np.uint8)

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, folded = array("i"), [], {}
        for x in chunks:
            single = self.led and (y := x.removeprefix(b" ")).isalpha() and y.isascii()
            before = len(ids)
            for word in (x,) if single else map(str.encode, self.split(x.decode())):
                own = folded.get(word)
                if own is None:
                    own = folded[word] = fold(word, self.ranks)
                ids.extend(own)
            lengths.append(len(ids) - before)
        return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.array(lengths, np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids' pieces in a row, and how many each text has."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pieces[spread(self.starts[ids], lengths)], np.diff(ends[np.concatenate([[0], np.cumsum(n)])])


def _bpe(path: str, pattern: str):
    def made() -> tuple[ChunkTable, _Ranked]:
        ranked = _Ranked(path, pattern)
        return ChunkTable(pattern == SPACE_LED, ranked, "i4", REMEMBERED), ranked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranked = table_of(("ranks", path, pattern), made)
        for rows, data, offsets in blocks(batches, size=BLOCK_BYTES):
            ids, n = table.of(data, offsets)
            text, size = ranked.decode(ids, n)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            decoded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), listed, decoded], ["doc_id", "ids", "decoded"])

    return run


def bpe(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, ids, decoded (the bytes that the ids stand for).

    ``path`` is a rank file that must hold all 256 bytes and be readable at the same place on every executor;
    ``pattern`` splits text into words, and text between matches is lost, as in the libraries. Null text: empty;
    null doc_id and repeated rows: kept. Special tokens' strings are ordinary text. A text of any length is encoded
    whole, and a long word in n log n steps. Other columns are ignored; an empty table gives an empty result.
    """
    return documents(df).mapInArrow(_bpe(path, pattern), "doc_id long, ids array<int>, decoded binary")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(df: DataFrame, word: str, ranks: dict[bytes, int]) -> DataFrame:
    """df with ids array<int> and decoded binary for the distinct words of a string column, by functions of Spark alone.

    A null or empty word has no ids. Takes about 80 microseconds of CPU for a word of ten bytes, and time that
    grows with the square of a word's length.
    """
    spark: SparkSession = df.sparkSession
    names = spark.createDataFrame([(k.decode("latin-1"), v) for k, v in ranks.items()], "k string, v int")
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for x in names.groupBy(F.pmod(F.hash("k"), F.lit(BUCKETS)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).collect():
        buckets[x.b] = x.m
    literal = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        return _let(piece, lambda x: F.coalesce(F.try_element_at(F.get(literal, F.pmod(F.hash(x), F.lit(BUCKETS))), x), F.lit(NONE)))

    # one character a byte; a state holds where pieces start, and the rank of each adjacent pair
    w = F.decode(F.encode(F.coalesce(F.col(word), F.lit("")), "UTF-8"), "ISO-8859-1")
    n = F.length(w)
    none = F.array().cast("array<int>")

    def span(starts: Column, i: Column, j: Column) -> Column:
        return _let(F.get(starts, i), lambda a: rank(F.substr(w, a, F.get(starts, j) - a)))

    def merge(state: Column, least: Column) -> Column:
        def at(k: Column) -> Column:
            def kept(starts: Column) -> Column:
                left = F.when(k > 1, F.concat(F.slice(state["r"], F.lit(1), k - 2), F.array(span(starts, k - 2, k)))).otherwise(none)
                right = F.when(k < F.size(state["r"]), F.concat(F.array(span(starts, k - 1, k + 1)), F.slice(state["r"], k + 2, n))).otherwise(none)
                return F.struct(starts.alias("p"), F.concat(left, right).alias("r"))

            return _let(F.array_remove(state["p"], F.get(state["p"], k)), kept)

        return _let(F.array_position(state["r"], least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["r"]), lambda least: F.when(F.coalesce(least, F.lit(NONE)) == NONE, state).otherwise(merge(state, least)))

    start = F.struct(F.sequence(F.lit(1), n + 1).alias("p"), F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substr(w, i, F.lit(2)))).alias("r"))
    merged = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["p"])
    many = _let(merged, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: span(p, i, i + 1)))
    ids = F.when(n == 0, none).otherwise(_let(rank(w), lambda whole: F.when((whole < NONE) | (n < 2), F.array(whole)).otherwise(many)))
    spans = F.when(n < 2, F.array(w)).otherwise(_let(merged, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.substr(w, F.get(p, i), F.get(p, i + 1) - F.get(p, i)))))
    return df.withColumns({"ids": ids, "decoded": F.encode(F.array_join(spans, ""), "ISO-8859-1")})


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
