"""Token ids as binary output.

Ids are replaced by their rank in frequency, so that common ones take one byte, and written in a byte-aligned
variable-length code whose control bytes (two bits an id: its length less one) are a stream of their own. Decoding
looks up each control byte's four lengths in a table and gathers the data bytes with numpy.

The file format is Parquet of blocks in ascending doc_id order: block (its number), first (ids before it), doc_ids,
lengths, control, data; and beside it the table of ranks. A block holds a range of documents, and what one task
gathers is one block's ids: both follow from the number of blocks, which grows with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.chunks import ALNUM, LEAD, LINE, QUOTE, SIGN, SPACE_LED, ChunkTable, kinds, spread, table_of
from textloom.llm.common import blocks, discard, documents, release, shared_dir, store

#: Documents in a block, about.
BLOCK_ROWS = 2048
#: Chunks that are encoded as the lines of one text, and bytes of text whose chunks are looked up at once.
LINES, BLOCK_BYTES = 500, 1 << 22
#: Blocks whose prefix sums one task makes.
SUMMED = 4096

_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: For each control byte, the lengths of its four ids.
LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << _SHIFTS).sum(axis=1, dtype=np.uint8)
    ends = np.cumsum(extra + np.int64(1))
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - extra - 1
    data[starts] = ranks & 0xFF
    for more in range(1, int(extra.max(initial=0)) + 1):
        at = np.flatnonzero(extra >= more)
        data[starts[at] + more] = ranks[at] >> 8 * more & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of pack()."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    packed = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = packed[starts].astype(np.uint32)
    for more in range(1, int(lengths.max(initial=1))):
        at = np.flatnonzero(lengths > more)
        out[at] |= packed[starts[at] + more].astype(np.uint32) << np.uint32(8 * more)
    return out


class _Library:
    """The tokenizer's ids of new chunks.

    Many chunks are encoded at once, as the lines of one text, where a line end has an id of its own; a chunk that
    white space begins or ends (but for one space before it) or that holds a line end is encoded by itself.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library looks for before it splits a text
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        line = self.ids("\n")
        self.line = line[0] if len(line) == 1 and pattern == SPACE_LED and not any(b"\n" in x for x in self.added) else None

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold an added token's string."""
        out, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
        for x in self.added:
            if x in raw:
                out |= np.array([x in raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)
        return out

    def _lines(self, chunks: list[bytes]) -> np.ndarray:
        """Which chunks can be lines of a text."""
        if self.line is None:
            return np.zeros(len(chunks), bool)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(x) for x in chunks])
        starts = np.concatenate([[0], ends[:-1]])
        kind = kinds(data)
        begins, inked = np.isin(kind, (ALNUM, SIGN, QUOTE, LEAD)), np.isin(kind, (ALNUM, SIGN, QUOTE))
        spaced = data[starts] == 0x20
        out = np.where(spaced, begins[np.minimum(starts + 1, ends - 1)], begins[starts]) & inked[ends - 1]
        for i in np.flatnonzero(~out).tolist():
            text = chunks[i].decode()
            out[i] = text.strip() == text.removeprefix(" ") and text != " "
        if LINE in kind:
            out[np.searchsorted(ends, np.flatnonzero(kind == LINE), "right")] = False
        for x in self.added:
            if x in data.tobytes():
                out &= np.array([x not in y for y in chunks], bool)
        return out

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lines = self._lines(chunks)
        own: list[np.ndarray] = []
        lengths = np.zeros(len(chunks), np.int64)
        fit, others = np.flatnonzero(lines), np.flatnonzero(~lines)
        parts = [fit[at : at + LINES] for at in range(0, len(fit), LINES)]
        texts = [b"\n".join([chunks[i] for i in part.tolist()]).decode() for part in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids)
            ends = np.flatnonzero(ids == self.line)
            lengths[part] = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            own.append(np.delete(ids, ends))
        for i in others.tolist():
            own.append(np.array(self.ids(chunks[i].decode()), np.int64))
            lengths[i] = len(own[-1])
        order = np.concatenate([fit, others])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(own)[spread(starts, lengths)] if own else np.zeros(0, np.int64), lengths


def _encode(path: str, pattern: str, end: int, kind: str):
    """doc_id, n, ids (little-endian, with the end id)."""

    def made() -> tuple[ChunkTable, _Library]:
        library = _Library(path, pattern)
        return ChunkTable(pattern == SPACE_LED, library, kind), library

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, library = table_of(("tokenizer", path, pattern, kind), made)
        width = np.dtype(kind).itemsize
        for rows, data, offsets in blocks(batches, size=BLOCK_BYTES):
            ids, n = table.of(data, offsets, library.whole(data, offsets))
            ids = np.insert(ids, np.cumsum(n), end)
            ends = np.concatenate([[0], np.cumsum(n + 1)])
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * width), pa.py_buffer(ids.astype(kind, copy=False))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n + 1), held], ["doc_id", "n", "ids"])

    return run


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes in a row, and their offsets."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1 + wide.offset)[wide.offset :]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for x in batches:
            ids = _held(x.column("ids"))[0].view(kind)
            for at in range(0, len(ids), 1 << 20):
                own = np.bincount(ids[at : at + (1 << 20)])
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def _blocks(ids_by_rank: np.ndarray, kind: str):
    """Rows (block, first, doc_id, ids) by block, that with first before others, then by doc_id -> a row for each block."""
    rank = np.zeros(int(ids_by_rank.max()) + 1 if len(ids_by_rank) else 1, np.uint32)
    rank[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    names = ["block", "first", "doc_ids", "lengths", "control", "data"]

    def written(block: int, first: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(held), kind)
        control, data = pack(rank[ids])
        lengths = [len(x) // ids.itemsize for x in held]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([first]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, doc_ids, held = None, 0, [], []
        for x in batches:
            for block, first, doc_id, ids in zip(*(x.column(c).to_pylist() for c in ("block", "first", "doc_id", "ids")), strict=True):
                if first is not None:
                    if held:
                        yield written(now, start, doc_ids, held)
                    now, start, doc_ids, held = block, first, [], []
                else:
                    doc_ids.append(doc_id)
                    held.append(ids)
        if held:
            yield written(now, start, doc_ids, held)

    return run


def write_ids(encoded: DataFrame, path: str, kind: str = "<u4") -> None:
    """(doc_id, n, ids) rows -> files under path, in ascending doc_id order (nulls first, equal ids in any order)."""
    spark = encoded.sparkSession
    counts = encoded.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # as long as the vocabulary at most
    order = np.array([x.id for x in counts.orderBy(F.desc("n"), "id").collect()], np.int64)
    spark.createDataFrame(list(enumerate(order.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    n = max(1, -(-encoded.count() // BLOCK_ROWS))
    parts = min(1000, n)
    cuts = encoded.select(F.approx_percentile("doc_id", [i / parts for i in range(1, parts)], 20000).alias("cuts")).first().cuts if parts > 1 else []
    dealt = encoded.withColumn("block", _range_of(sorted(set(cuts or [])), n))
    first = _firsts(dealt.groupBy("block").agg(F.sum("n").alias("n")))
    rows = dealt.select("block", F.lit(None).cast("long").alias("first"), "doc_id", "ids").unionByName(first, allowMissingColumns=True)
    rows = rows.repartition(max(1, min(n, 100000)), "block").sortWithinPartitions("block", F.asc_nulls_last("first"), "doc_id")
    made = rows.select("block", "first", "doc_id", "ids").mapInArrow(_blocks(order, kind), "block long, first long, doc_ids array<long>, lengths array<int>, control binary, data binary")
    made.write.parquet(f"{path}/blocks")


def _firsts(totals: DataFrame) -> DataFrame:
    """(block, n) -> (block, first): the sum of n over lower blocks. Blocks are summed up in groups of SUMMED, and then
    the groups, of which there is one for some eight million documents."""
    grouped = totals.withColumn("group", F.floor(F.col("block") / SUMMED))
    lower = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("n")).select("group", lower(Window.orderBy("group")).alias("before"))
    within = grouped.select("block", "group", lower(Window.partitionBy("group").orderBy("block")).alias("within"))
    return within.join(groups, "group").select("block", (F.col("before") + F.col("within")).alias("first"))


def _range_of(cuts: list[int], n: int):
    """Block of a doc_id: which of the approximate quantiles it follows, and where it lies between two of them.

    Ids that are dense or not, the order of blocks is that of ids; blocks are even as far as the quantiles are.
    """
    if not cuts:
        return F.lit(0).cast("long")
    inner = max(1, -(-n // (len(cuts) + 1)))
    low = F.array(*map(F.lit, [cuts[0], *cuts]))
    cut = F.array(*map(F.lit, cuts))
    at = F.size(F.filter(cut, lambda x: x <= F.col("doc_id")))
    below, above = F.get(low, at), F.get(cut, at)
    within = F.floor((F.col("doc_id") - below) * inner / F.greatest(above - below, F.lit(1)))
    return F.coalesce(at.cast("long") * inner + F.when((at > 0) & above.isNotNull(), F.least(F.greatest(within, F.lit(0)), F.lit(inner - 1))).otherwise(F.lit(0)), F.lit(-1).cast("long"))


def _read(ids_by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                lengths = np.asarray(x.column("lengths")[i].values, np.int64)
                ids = ids_by_rank[unpack(x.column("control")[i].as_py(), x.column("data")[i].as_py(), int(lengths.sum()))].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(lengths)])
                own = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([x.column("doc_ids")[i].values, pa.array(ends[:-1] + x.column("first")[i].as_py()), pa.array(lengths), own], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark, path: str) -> DataFrame:
    """The files of write_ids: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    order = np.array([x.id for x in ranks], np.int64)
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_read(order), "doc_id long, start long, n_tokens long, ids binary")


def token_output(df: DataFrame, path: str, tokenizer: str, pattern: str, end: int) -> DataFrame:
    """Encodes df's texts (null: empty), appends ``end`` to each, writes the ids under path and reads them back.

    Rows with a null doc_id come first; rows that repeat a doc_id keep their number. The strings of the
    tokenizer's added tokens become their ids, as in the library; a text that holds one is encoded whole. A text of any
    length is one row of one block, whose ids a task holds. An empty table gives no blocks and an empty result. Other
    columns are ignored.
    ``pattern`` must be the tokenizer's own way of splitting, ``tokenizer`` a file at one place on every executor.
    """
    spark = df.sparkSession
    from tokenizers import Tokenizer

    kind = "<u2" if max(end, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16 else "<u4"
    encoded = store(documents(df).mapInArrow(_encode(tokenizer, pattern, end, kind), "doc_id long, n long, ids binary"))
    write_ids(encoded, path, kind)
    discard(encoded)
    release(spark)
    return read_ids(spark, path)


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = token_output(docs, out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
