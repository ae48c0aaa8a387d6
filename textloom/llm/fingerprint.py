"""Document fingerprints: quartile bucket digests.

Every byte triplet of a text is hashed into one of 256 buckets and counted. A digest holds a code for the length, two
ratios of the quartiles of the counts, and for each bucket the quartile that its count falls in (two bits). Two
digests are compared by a difference that is bounded, and their likeness is 1 less the difference's share of its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents
from textloom.llm.token_output import _range_of

BUCKETS = 256
#: Documents in a range, about, and most ranges: a row for each is sent to all tasks.
RANGE_ROWS, RANGES = 512, 50_000
_rng = np.random.Generator(np.random.PCG64(7))
_FIRST, _SECOND, _THIRD = (_rng.permutation(256).astype(np.uint8) for _ in range(3))
#: Difference of bucket codes 0..3 apart, and the most that length and ratio codes add.
_APART = np.array([0, 1, 2, 6], np.int64)
LENGTH_MOST, RATIO_MOST = 64, 15
MOST = int(_APART[-1]) * BUCKETS + LENGTH_MOST + 2 * RATIO_MOST


def digest(text: bytes) -> bytes:
    """66 bytes: length code, two ratio codes in one byte, and 64 bytes of bucket codes. Equal texts, equal digests."""
    data = np.frombuffer(text, np.uint8)
    if len(data) >= 3:
        hashed = _FIRST[data[:-2]] ^ _SECOND[_FIRST[data[1:-1]]] ^ _THIRD[data[2:]]
        counts = np.bincount(hashed, minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log1p(len(data)) * 12))
    ratios = (q1 * 15 // q3 << 4 | q2 * 15 // q3) if q3 else 0
    packed = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return bytes([length, ratios]) + packed.tobytes()


_PAIRS = _APART[np.abs((np.arange(256)[:, None, None] >> np.array([0, 2, 4, 6]) & 3) - (np.arange(256)[None, :, None] >> np.array([0, 2, 4, 6]) & 3))].sum(axis=2)


def difference(a: bytes, b: bytes) -> int:
    """From 0 for equal digests to MOST."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    ratios = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return int(_PAIRS[x[2:], y[2:]].sum()) + min(LENGTH_MOST, abs(a[0] - b[0])) + ratios


def likeness(a: bytes, b: bytes) -> float:
    return 1 - difference(a, b) / MOST


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, extra, doc_id, text) in order; an extra row is the one after its block, and is not returned."""
    from hashlib import sha256

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: tuple | None = None
    for x in batches:
        out: list[list] = [[] for _ in names]
        for block, extra, doc_id, text in zip(*(x.column(c).to_pylist() for c in ("block", "extra", "doc_id", "text")), strict=True):
            own = digest(text.encode())
            if held is not None and held[0] == block:
                _, before, its_id, its_digest = held
                n = len(before)
                edited = (before[: n - n // 2] + text[: n // 2]).encode()
                changed = digest(edited)
                row = (its_id, n, sha256(edited).hexdigest(), its_digest.hex(), changed.hex(), likeness(its_digest, changed), likeness(its_digest, own))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            held = None if extra else (block, text, doc_id, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)


def fingerprints(df: DataFrame) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) first ones of the next
    document; the next one follows in the order of doc_id, then text; after the last comes the first. A null doc_id
    comes first; null text is empty; a table's only row follows itself; repeated rows follow each other. A text of any
    length is digested whole, one at a time. Other columns are ignored; an empty table gives an empty result.

    Documents are dealt into ranges of ids. Each range also gets the first document of the one after it, so that
    every task sees its rows' followers and nothing is ordered in one place.
    """
    docs = documents(df)
    n = min(RANGES, max(1, -(-docs.count() // RANGE_ROWS)))
    parts = min(1000, n)
    cuts = docs.select(F.approx_percentile("doc_id", [i / parts for i in range(1, parts)], 20000).alias("cuts")).first().cuts if parts > 1 else []
    dealt = docs.withColumn("block", _range_of(sorted(set(cuts or [])), n))
    from pyspark.sql import Window

    # a row a range
    firsts = dealt.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("key"))).alias("first"))
    order = Window.orderBy("block")
    following = firsts.select("first", F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ids = following.select(F.col("first.doc_id").alias("first_id"), "to")
    extras = docs.join(F.broadcast(ids), docs.doc_id.eqNullSafe(F.col("first_id"))).select(F.col("to").alias("block"), F.lit(True).alias("extra"), "doc_id", "text")
    rows = dealt.select("block", F.lit(False).alias("extra"), "doc_id", "text").unionByName(extras)
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "extra", F.asc_nulls_first("doc_id"), "text")
    return rows.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
