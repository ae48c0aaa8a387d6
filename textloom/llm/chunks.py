"""Texts as numbers of distinct chunks, for encoders that work on one word at a time.

A block's bytes are cut, by numpy, where the space-led pattern is sure to begin a new word whatever comes after: the
chunks between are mostly one word each, and their encodings put together are the whole text's. Arrow finds a block's
distinct chunks, a table that the worker process keeps gives each its number, and only new ones are encoded. Nothing
in Python runs per occurrence of a word.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: The byte-level pattern of the public vocabularies: a space goes with what follows it. (A fixed value.)
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers; past that it keeps those met more than once, or none.
REMEMBERED = 3 << 17

OTHER, ALNUM, SIGN, QUOTE, WHITE, LINE, LEAD, HIGH = range(8)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[33:127] = SIGN
_CLASS[0x27] = QUOTE
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = ALNUM
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = WHITE
_CLASS[0x0A] = LINE
_CLASS[128:] = HIGH
#: First bytes of two-byte characters that are all letters, but for the times and division signs.
_LEADS = np.array([0xC3, 0xC4, 0xC5, 0xD0, 0xD1], np.uint8)
_CLASS[_LEADS] = LEAD
#: By the classes of two bytes: 1 a word ends between them, 2 it does unless the first ends a space beyond ASCII.
_PAIR = np.zeros(64, np.uint8)
for _a in (ALNUM, SIGN, QUOTE):
    _PAIR[[_a * 8 + WHITE, _a * 8 + LINE]] = 1
_PAIR[[ALNUM * 8 + SIGN, ALNUM * 8 + QUOTE, SIGN * 8 + ALNUM]] = 1
_PAIR[[HIGH * 8 + WHITE, HIGH * 8 + LINE]] = 2


def _ends_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bytes at these places (of two-byte characters or longer) end a white-space character."""
    a, b, c = data[np.maximum(at - 2, 0)], data[np.maximum(at - 1, 0)], data[at]
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | general | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte; the last one of a two-byte letter has that of letters."""
    kind = _CLASS[data]
    letter = np.flatnonzero(kind[:-1] == LEAD) + 1
    sign = (data[letter - 1] == 0xC3) & ((data[letter] == 0x97) | (data[letter] == 0xB7))
    kind[letter[~sign]] = ALNUM
    return kind


def cuts(data: np.ndarray, offsets: np.ndarray, led: bool, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and each row's range of chunks. Without ``led``, and for rows ``whole``, a text is a chunk."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if led and n > 1:
        kind = kinds(data)
        pair = _PAIR[(kind[:-1] << 3) | kind[1:]]
        cut[1:n] = pair == 1
        maybe = np.flatnonzero(pair == 2)
        cut[maybe[~_ends_space(data, maybe)] + 1] = True
        # a line end alone between what is not white space is a word of its own
        line = np.flatnonzero(kind[1:-1] == LINE) + 1
        before, after = kind[line - 1], kind[line + 1]
        alone = np.isin(before, (ALNUM, SIGN, QUOTE)) & np.isin(after, (ALNUM, SIGN, QUOTE, LEAD))
        cut[line[alone] + 1] = True
        for row in np.flatnonzero(whole) if whole is not None else ():
            cut[offsets[row] : offsets[row + 1]] = False
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all elements of spans, span after span."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class ChunkTable:
    """Numbers of chunks, and what each is encoded as: a span of ``values``.

    ``encode`` takes new chunks as bytes and gives all their values in a row, and how many each has.
    """

    def __init__(self, led: bool, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: str, most: int | None = None):
        self.led, self.encode, self.kind, self.most = led, encode, kind, most or REMEMBERED
        self._reset([], np.zeros(0, kind), np.zeros(0, np.int64))

    def _reset(self, keys: list[bytes], values: np.ndarray, lengths: np.ndarray) -> None:
        self.numbers = dict(zip(keys, range(len(keys)), strict=True))
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.met = np.zeros(len(keys), np.int64)

    def _forget(self) -> None:
        kept = np.flatnonzero(self.met > 1)
        if len(kept) * 2 > self.most:
            kept = np.zeros(0, np.int64)
        keys = list(self.numbers)
        self._reset([keys[i] for i in kept.tolist()], self.values[spread(self.starts[kept], self.lengths[kept])], self.lengths[kept])

    def of(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The values of a block's texts in a row, and how many each text has."""
        if len(self.numbers) > self.most:
            self._forget()
        starts, bounds = cuts(data, offsets, self.led, whole)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = held.dictionary_encode()
        keys, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        numbers = np.fromiter(map(self.numbers.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            values, lengths = self.encode(new)
            numbers[missing] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self.numbers.update(zip(new, numbers[missing].tolist(), strict=True))
            self.starts = np.append(self.starts, len(self.values) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.values = np.append(self.values, values.astype(self.kind, copy=False))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.met[numbers] += 1
        found = numbers[places]
        lengths = self.lengths[found]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.values[spread(self.starts[found], lengths)], np.diff(ends[bounds])


#: The worker process's table, by what it encodes with.
_TABLES: dict[tuple, object] = {}


def table_of(key: tuple, make):
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]
