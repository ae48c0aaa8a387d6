"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a document. How accurate those of shape are, and how common good
documents are, is estimated without labels by expectation-maximisation over the counts of vote patterns, which are taken
over all documents and number 2 * 3^8 at most. The labeller of words looks for insults, and, where a table of labelled
documents is given, for words that toxic ones of a bounded sample have and others hardly ever; a document is bad if it
says so, whatever its shape. Posterior labels of a bounded sample then train a linear scorer on hashed features of a text's shape
and on its hashed words, which judges every document, also those on which the labellers are silent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Words, blocks, documents

#: Documents that the scorer is fitted to, about; passes and step of the fit; rounds of EM.
SAMPLE, PASSES, STEP, ROUNDS = 6000, 200, 2.0, 100
#: A document is kept if its score reaches this.
KEEP = 0.5
BAD, SILENT, GOOD = 0, 1, 2

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 small letter, 2 capital, 3 other sign, 4 digit
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_SHAPE = np.zeros(256, np.int64)  # letters and digits as classes, signs as themselves
_SHAPE[:128] = np.arange(128) + 8
for _c in (0, 1, 2, 4):
    _SHAPE[_CLASS == _c] = _c

#: For each labeller (signal, bad from, good to): at or above the first it votes bad, at or below the second good.
LABELLERS = (
    ("signs", 0.22, 0.10),  # share of bytes that are signs, of those not white space
    ("capitals", 0.50, 0.20),  # share of letters that are capitals
    ("decorated", 0.25, 0.06),  # share of words with two signs or more
    ("bare", 0.18, 0.05),  # share of words without a letter
    ("stutter", 0.20, 0.05),  # share of words that equal the one before
    ("again", 0.60, 0.30),  # share of three-word runs that came before
    ("commonest", 0.35, 0.20),  # share of the commonest word
    ("endless", 0.98, 0.90),  # share of words that end no sentence
)
#: Words that insult, in lower case; each also with an s at its end. Other words than these are not known to be toxic.
INSULTS = (
    *("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "filth", "idiot", "idiotic", "imbecile"),
    *("loser", "moron", "moronic", "pathetic", "retard", "scum", "scumbag", "stupid", "trash", "vermin", "whore", "worthless"),
    *("abruti", "connard", "connasse", "crétin", "débile", "dégoûtant", "imbécile", "minable", "ordure", "pathétique", "salaud", "salope", "stupide"),
    *("abschaum", "arschloch", "dummkopf", "erbärmlich", "hurensohn", "idioten", "schwachkopf", "trottel", "versager", "wertlos", "widerlich"),
    *("asqueroso", "asquerosa", "basura", "cabrón", "escoria", "estúpido", "estúpida", "gilipollas", "idiota", "imbécil", "patético", "patética", "payaso"),
)


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that tries each shared beginning once."""
    rest: dict[str, list[str]] = {}
    for x in words:
        rest.setdefault(x[:1], []).append(x[1:])
    parts = [re.escape(c) + _any_of(own) for c, own in sorted(rest.items()) if c]
    return "" if not parts else parts[0] if len(parts) == 1 and "" not in rest else f"(?:{'|'.join(parts)}){'?' if '' in rest else ''}"


_INSULT = re.compile(f"{_any_of(sorted(set(INSULTS)))}s?(?![^\\W\\d_])")
#: From this share of insults among the words a text is toxic.
TOXIC = 0.006
#: Labelled documents of either kind that toxic words are learnt from, about; in how many toxic ones a word must be, how
#: many times as often there as in others, and how many such words a text must have before they count.
LABELLED, SEEN, LIFT, SEVERAL = 20_000, 4, 20, 2
_LETTER = np.full(256, 0x20, np.uint8)  # letters in lower case, as far as ASCII goes, and all bytes beyond it
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
#: Hashed features: shares by labeller and of insults, shapes, words. Before the fit, weight of a share that is toxic.
NAMED, SHAPES, WORDS, TOXIC_START = 64 * (len(LABELLERS) + 1), (1 << 13) - 512, 1 << 16, -10.0
FEATURES = NAMED + SHAPES + WORDS
#: Below so many words a text's shares say nothing; bytes that a text is short of, as far as its shapes count.
FEW, SHORT = 20, 300


def _insults(text: str) -> int:
    text = text.lower()
    return sum(not text[x.start() - 1 : x.start()].isalpha() for x in _INSULT.finditer(text))


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of letters of a block, with capitals of two bytes as small ones, and without quotes and dashes."""
    plain = _LETTER[data]
    lead = np.flatnonzero(plain[:-1] == 0xC3)
    capital = lead[(plain[lead + 1] < 0x9F) & (plain[lead + 1] != 0x97)] + 1
    plain[capital] += 0x20
    sign = np.flatnonzero((plain[:-1] == 0xC2) & (plain[1:] >= 0xA0))
    plain[sign] = plain[sign + 1] = 0x20
    sign = np.flatnonzero((plain[:-2] == 0xE2) & (plain[1:-1] == 0x80))
    plain[sign] = plain[sign + 1] = plain[sign + 2] = 0x20
    return Words(plain, offsets)


def _learnt(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How many words of each text are learnt as toxic (hashes in order); fewer than SEVERAL count as none."""
    if not len(toxic):
        return np.zeros(len(offsets) - 1, np.int64)
    words = _letter_runs(data, offsets)
    hit = toxic[np.minimum(np.searchsorted(toxic, words.hashes), len(toxic) - 1)] == words.hashes
    n = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.bounds])
    return np.where(n >= SEVERAL, n, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (h, t, c): in how many toxic and other texts a word is; those of no word count the texts."""
    for rows, data, offsets in blocks(batches):
        words = _letter_runs(data, offsets)
        kind = np.asarray(rows.column("toxic"), np.int64)
        pairs = np.unique(np.stack([words.owners().astype(np.uint64), words.hashes]), axis=1) if len(words.hashes) else np.zeros((2, 0), np.uint64)
        found, place = np.unique(pairs[1], return_inverse=True)
        t = np.bincount(place, kind[pairs[0].astype(np.int64)], len(found)).astype(np.int64)
        c = np.bincount(place, minlength=len(found)) - t
        h = pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([h, pa.array(np.append(t, kind.sum())), pa.array(np.append(c, len(kind) - kind.sum()))], ["h", "t", "c"])


def learn_toxic(docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> np.ndarray:
    """Hashes of words that tell of toxic documents, from docs (doc_id, text) and labels (doc_id, toxic), in order.

    About ``sample`` labelled documents of either kind are chosen by a hash of their id, and one of equal texts counts.
    Labels without a doc_id or a verdict, and of no document, tell nothing; a document with several is toxic if one
    says so. No labels, no words.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {x.toxic: x.n for x in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return np.zeros(0, np.uint64)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # two times the sample at most, about
    texts = docs.join(F.broadcast(chosen), "doc_id").filter("text <> ''").groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    counts = texts.select("toxic", "text").mapInArrow(_counted, "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = counts.filter((F.col("t") >= SEEN) | F.col("h").isNull()).toArrow()
    h, t, c = (np.asarray(found.column(x).combine_chunks().fill_null(0)) for x in ("h", "t", "c"))
    total = np.asarray(found.column("h").combine_chunks().is_null())
    if not total.any():
        return np.zeros(0, np.uint64)
    n_toxic, n_other = int(t[total].sum()), int(c[total].sum())
    telling = ~total & (t >= SEEN) & (t * float(n_other) >= LIFT * (c + 1.0) * n_toxic)
    return np.sort(h[telling].view(np.uint64))


def _shares(words: Words, data: np.ndarray, row: int, learnt: int = 0) -> dict[str, float] | None:
    """The labellers' signals, ``learnt`` being how many learnt words there are; that of insults alone for a text of few words, None for one without words."""
    at = words.of(row)
    n = at.stop - at.start
    if not n:
        return None
    toxic = max(learnt, _insults(data[words.starts[at.start] : words.ends[at.stop - 1]].tobytes().decode())) / n
    if n < FEW:
        return {"toxic": toxic}
    starts, ends, hashes = words.starts[at], words.ends[at], words.hashes[at]
    low, high = starts[0], ends[-1]
    kinds = _CLASS[data[low:high]]
    counts = np.bincount(kinds, minlength=5)
    letters = counts[1] + counts[2]
    sign = np.concatenate([[0], np.cumsum(kinds == 3)])
    letter = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == 2))])
    signs = sign[ends - low] - sign[starts - low]
    ordered = np.sort(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7))
    own = np.sort(hashes)
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    return {
        "signs": counts[3] / max(1, counts[1:].sum()),
        "capitals": counts[2] / max(1, letters),
        "decorated": float((signs >= 2).mean()),
        "bare": float((letter[ends - low] == letter[starts - low]).mean()),
        "stutter": float((hashes[1:] == hashes[:-1]).mean()),
        "again": float((ordered[1:] == ordered[:-1]).mean()),
        "commonest": float(np.diff(cuts).max() / n),
        "endless": float(1 - np.isin(data[ends - 1], _ENDS).mean()),
        "toxic": toxic,
    }


_ENDS = np.frombuffer(b".!?", np.uint8)


def _pattern(shares: dict[str, float] | None) -> str:
    """A vote a labeller: 0 bad, 1 nothing, 2 good; the last is that of insults, which finds nothing good."""
    votes = []
    for name, bad, good in LABELLERS:
        x = (shares or {}).get(name)
        votes.append(SILENT if x is None or good < x < bad else BAD if x >= bad else GOOD)
    return "".join(map(str, [*votes, BAD if shares and shares["toxic"] >= TOXIC else SILENT]))


def _features(shares: dict[str, float] | None, data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their weights: shares in twentieths (but for sentence ends, which vary in short texts), that of insults in thirds of TOXIC, and three-byte shapes and words by their share of the text."""
    if shares is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    named = [i * 64 + min(20, int(shares[name] * 20)) for i, (name, _, _) in enumerate(LABELLERS) if name != "endless" and name in shares]
    named.append(len(LABELLERS) * 64 + (3 + min(20, int((shares["toxic"] / TOXIC - 1) * 3)) if shares["toxic"] >= TOXIC else int(shares["toxic"] / TOXIC * 3)))
    shape = _SHAPE[data]
    if len(shape) >= 3:
        hashed = (shape[:-2] * 18397 + shape[1:-1] * 331 + shape[2:] * 7) % SHAPES
        counts = np.bincount(hashed, minlength=SHAPES)
        at = np.flatnonzero(counts)
        weight = np.sqrt(counts[at] / (counts.sum() + SHORT))
    else:
        at, weight = np.zeros(0, np.int64), np.zeros(0)
    word, counts = np.unique((hashes % np.uint64(WORDS)).astype(np.int64), return_counts=True)
    weights = [np.ones(len(named)), weight, np.sqrt(counts / (len(hashes) + SHORT))]
    return np.concatenate([np.array(named, np.int64), at + NAMED, word + NAMED + SHAPES]), np.concatenate(weights).astype(np.float32)


def _voted(toxic: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words, learnt = Words(data, offsets, fold=True), _learnt(data, offsets, toxic).tolist()
            patterns = [_pattern(_shares(words, data, i, learnt[i])) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string())], ["votes"])

    return run


def _sampled(toxic: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words, learnt = Words(data, offsets, fold=True), _learnt(data, offsets, toxic).tolist()
            out: list[tuple] = []
            for i in range(rows.num_rows):
                shares = _shares(words, data, i, learnt[i])
                at, weight = _features(shares, data[offsets[i] : offsets[i + 1]], words.hashes[words.of(i)])
                out.append((_pattern(shares), at.astype(np.int32).tobytes(), weight.tobytes()))
            votes, at, weight = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string()), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], ["votes", "at", "weight"])

    return run


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Vote patterns and their counts -> the posterior of good for each, by expectation-maximisation.

    A document's shape is good or bad; given that, labellers vote independently, each with its own chances of either
    vote; silence tells nothing. It starts at the share of good votes. Then what the labeller of insults votes bad is
    not good. An empty input gives an empty result.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes = np.array([[int(c) for c in x] for x in keys])
    votes, toxic = votes[:, :-1], votes[:, -1] == BAD
    n = np.array([patterns[x] for x in keys], np.float64)
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    p = np.where(bad > 0, (good + 0.5) / (good + 8 * bad + 1), (good + 0.9) / (good + 1))
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        prior = np.log((weight.sum(axis=1) + 1) / (n.sum() + 2))
        total = np.tile(prior[:, None], (1, len(keys)))
        for j in range(votes.shape[1]):
            chance = np.stack([weight @ (votes[:, j] == v) for v in (BAD, GOOD)], axis=1) + np.array([[1.5, 0.5], [0.5, 1.5]])
            chance = np.log(chance / chance.sum(axis=1, keepdims=True))
            total += np.where(votes[:, j] == SILENT, 0, chance[:, votes[:, j] // 2])
        p = 1 / (1 + np.exp(np.clip(total[0] - total[1], -500, 500)))
    return dict(zip(keys, np.where(toxic, 0, p).tolist(), strict=True))


def fit(rows: list[tuple[bytes, bytes, float]]) -> np.ndarray:
    """Weights (bias last) of a logistic scorer, from (features, their weights, posterior) rows, by AdaGrad."""
    weights, grown = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-3)
    weights[NAMED - 64 + 3 : NAMED] = TOXIC_START  # also if the sample has none
    if not rows:
        return weights
    at = [np.frombuffer(x, np.int32) for x, _, _ in rows]
    value = np.concatenate([np.frombuffer(x, np.float32) for _, x, _ in rows]).astype(np.float64)
    owner, column = np.repeat(np.arange(len(rows)), [len(x) for x in at]), np.concatenate(at)
    wanted = np.array([x for _, _, x in rows])
    for _ in range(PASSES):
        z = np.bincount(owner, value * weights[column], len(rows)) + weights[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - wanted) / len(rows)
        step = np.append(np.bincount(column, value * miss[owner], FEATURES), miss.sum()) + 1e-5 * weights
        grown += step**2
        weights -= STEP / 10 * step / np.sqrt(grown)
    return weights


def _scored(weights: np.ndarray, toxic: np.ndarray, keep: float):
    """Rows with a column text_ -> their other columns, score and keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text_"):
            words, learnt = Words(data, offsets, fold=True), _learnt(data, offsets, toxic).tolist()
            scores = []
            for i in range(rows.num_rows):
                at, weight = _features(_shares(words, data, i, learnt[i]), data[offsets[i] : offsets[i + 1]], words.hashes[words.of(i)])
                scores.append(1 / (1 + np.exp(-np.clip(weights[at] @ weight + weights[-1], -500, 500))) if len(at) else 0.0)
            others = [i for i, c in enumerate(rows.schema.names) if c != "text_"]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in others), pa.array(scores, pa.float64()), pa.array([x >= keep for x in scores], pa.bool_())], [*(rows.schema.names[i] for i in others), "score", "keep"])

    return run


def learn(df: DataFrame, sample: int = SAMPLE, toxic: np.ndarray | None = None) -> np.ndarray:
    """The scorer's weights: vote patterns are counted over all of df, the fit sees about ``sample`` texts."""
    docs, toxic = documents(df), np.zeros(0, np.uint64) if toxic is None else toxic
    counts = {x.votes: x.n for x in docs.mapInArrow(_voted(toxic), "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = estimate(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).select("text").distinct()
    rows = chosen.mapInArrow(_sampled(toxic), "votes string, at binary, weight binary").toLocalIterator()
    return fit(sorted((bytes(x.at), bytes(x.weight), posterior[x.votes]) for x in rows))


def quality(df: DataFrame, sample: int = SAMPLE, keep: float = KEEP, carry: tuple[str, ...] = (), labels: DataFrame | None = None, labelled: int = LABELLED) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, the columns to carry, score (0 to 1), keep.

    ``labels`` (doc_id, toxic) teaches the labeller of words what it does not know, from about ``labelled`` documents
    of either kind. Null, empty and blank texts score 0 and are not kept. Equal texts have equal scores; repeated rows
    and null doc_ids are returned as they come; a text of any length is judged whole. Other columns are ignored; an
    empty table gives an empty result. Carried columns must not be named score, keep or text_.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    schema = rows.drop("text_").schema.add("score", "double").add("keep", "boolean")
    toxic = np.zeros(0, np.uint64) if labels is None else learn_toxic(documents(df), labels, labelled)
    return rows.mapInArrow(_scored(learn(df, sample, toxic), toxic, keep), schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))
