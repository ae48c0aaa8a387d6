"""Language identification: words first, character n-grams for words that were never seen.

A text's words (runs of letters, lower-cased) are scored one by one. A word of the model adds its log-frequency in each
language. An unseen word backs off: its character n-grams of the greatest length of which any is known add the mean
of their log-frequencies; if none of four is known, those of three, two and one are tried. The language with the
greatest sum wins and its score is its share of the softmax of the sums.

The model has every word and n-gram of a bounded sample of labelled texts, as sparse rows over languages.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import spread, table_of

LONGEST = 4
#: Different labelled texts a language to learn from, about; the most languages, beyond which learning is refused.
SAMPLE, LANGUAGES = 4000, 10_000
#: Words whose scores a worker remembers at most, and bytes of their scores; past that it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 26
#: Words whose scores are added up at once.
AT_ONCE = 1 << 14
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; signs that the class takes in beside them, as fractions and superscripts are, end a word."""
    words = _WORD.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    return [y for x in words for y in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between spaces; for n = 1 its characters."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, n, gram, count): words as n = 0, with n-grams counted in each occurrence of a word."""
    for x in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(x.column("lang").to_pylist(), x.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        out: list[tuple] = []
        for lang, own in words.items():
            out += [(lang, 0, w, c) for w, c in own.items()]
            for n in range(1, LONGEST + 1):
                grams: Counter = Counter()
                for w, c in own.items():
                    for g in grams_of(w, n):
                        grams[g] += c
                out += [(lang, n, g, c) for g, c in grams.items()]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "gram", "count"])


def learn(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict:
    """A model from (lang, text) rows without nulls: of each language about ``sample`` different texts, chosen by a
    hash, are counted whole and once each. A language of fewer texts is learnt from all of them. More than
    ``languages`` values of lang are an error. An empty input gives a model that knows nothing."""
    sizes = {x.lang: x.n for x in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "keys": [[] for _ in range(LONGEST + 1)], "lengths": np.zeros(0, np.int64), "lang": np.zeros(0, np.int32), "more": np.zeros(0), "base": np.zeros((LONGEST + 1, 0))}
    shares = labelled.sparkSession.createDataFrame([(x, min(1.0, sample / max(1, n))) for x, n in sizes.items()], "lang string, share double")
    # a row a language
    chosen = labelled.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text").distinct()
    counts = chosen.mapInArrow(_counted, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    # bounded by the sample's texts
    found = counts.toArrow().sort_by([("n", "ascending"), ("gram", "ascending"), ("lang", "ascending")]).combine_chunks()
    n, lang = np.asarray(found.column("n")), np.searchsorted(np.array(langs, object), np.array(found.column("lang").to_pylist(), object))
    grams, count = found.column("gram").to_pylist(), np.asarray(found.column("count")).astype(np.float64)
    keys, lengths, base = [], [], np.zeros((LONGEST + 1, len(langs)))
    for level in range(LONGEST + 1):
        at = slice(int(np.searchsorted(n, level, "left")), int(np.searchsorted(n, level, "right")))
        own = Counter(grams[at])  # in order of the rows
        keys.append(list(own))
        lengths += own.values()
        # a gram that a language never showed counts as half of one
        base[level] = np.log(0.5 / (np.bincount(lang[at], count[at], len(langs)) + 0.5 * max(1, len(own))))
    return {"langs": langs, "keys": keys, "lengths": np.array(lengths, np.int64), "lang": lang.astype(np.int32), "more": np.log(count / 0.5), "base": base}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.base = model["langs"], np.vstack([model["base"], np.zeros(len(model["langs"]))])
        self.numbers: list[dict[str, int]] = []
        for keys in model["keys"]:
            first = sum(map(len, self.numbers))
            self.numbers.append(dict(zip(keys, range(first, first + len(keys)), strict=True)))
        self.lengths, self.lang, self.more = model["lengths"], model["lang"].astype(np.int64), model["more"]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.most = max(1, min(REMEMBERED, REMEMBERED_BYTES // (8 * max(1, len(self.langs)))))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log-frequency by language, or the mean of its longest known n-grams'."""
        level, n, found = [], [], []
        known = self.numbers[0].get
        for w in words:
            at, own = 0, [i] if (i := known(w)) is not None else []
            for size in range(LONGEST, 0, -1):
                if own:
                    break
                at, own = size, [i for i in map(self.numbers[size].get, grams_of(w, size)) if i is not None]
            level.append(at if own else LONGEST + 1)
            n.append(len(own))
            found += own
        n = np.array(n, np.int64)
        ids = np.array(found, np.int64)
        row = np.repeat(np.repeat(np.arange(len(words)), n), self.lengths[ids])
        at = spread(self.starts[ids], self.lengths[ids])
        more = np.bincount(row * len(self.langs) + self.lang[at], self.more[at] / n[row], len(words) * len(self.langs))
        return self.base[level] + more.reshape(len(words), -1)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its share of each text."""
        out = []
        for words in (words_of(x or "") for x in texts):
            if not words or not self.langs:
                out.append(("und", 0.0))
                continue
            total = np.zeros(len(self.langs))
            for at in range(0, len(words), AT_ONCE):
                total += self._rows(words[at : at + AT_ONCE]).sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.rows))
        if new:
            if len(self.rows) > self.most:
                self.forget()
                new = list(set(words))
            # in room that doubles
            first, to = len(self.rows), len(self.rows) + len(new)
            if to > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(to, 1 << 12), len(self.langs)))])
            step = max(1, (1 << 22) // len(self.langs))
            for at in range(0, len(new), step):
                part = new[at : at + step]
                self.scores[first + at : first + at + len(part)] = self.word_scores(part)
            self.rows.update(zip(new, range(first, to), strict=True))
        return self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def _predicted(held, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = table_of(("languages", key), lambda: Scorer(held.value))
        for x in batches:
            found = scorer.texts(x.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: dict) -> DataFrame:
    """Per row of df (doc_id, held_out, text): doc_id, held_out, lang_pred, score.

    Null text and text without a letter: ``und`` and 0, as with a model that learnt nothing. Ties go to the first
    language by name. A text of any length is scored whole.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    return df.select("doc_id", "held_out", "text").mapInArrow(_predicted(held, uuid.uuid4().hex), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from four fifths of df (doc_id, text, lang) and predicts all of it: doc_id, held_out, lang_pred, score.

    Held out are rows whose crc32 of the doc_id as text is divisible by 5; a null doc_id is neither held out nor
    learnt from. Rows without text or lang are not learnt from, and of rows with one text and language only one is.
    Repeated rows are returned as often; other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    model = learn(rows.filter("not held_out and doc_id is not null and text is not null and lang is not null").select("lang", "text"), sample)
    return predict(rows, model)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
