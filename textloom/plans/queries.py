"""Queries over the whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import stem as STEM
from textloom.functions import text as T
from textloom.operators import annotate as A
from textloom.operators import corpus as C
from textloom.operators import lexicon as LEX
from textloom.operators import patterns as P
from textloom.operators import spans as S
from textloom.sources.tables import read, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

q = lambda s: s.replace("'", "''")  # noqa: E731  a string inside SQL quotes
listed = lambda words: ", ".join(f"'{q(w)}'" for w in words)


def case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def tok(table: str = "documents", key: str = "doc_id", text: str = "text", more: str = "") -> str:
    return f"""toks AS (SELECT {key} AS doc_id{more}, flatten(list_transform(regexp_extract_all({text}, '{q(T.PATTERN)}'), lambda t:
 CASE WHEN regexp_matches(t, '{q(T.NEGATED)}') THEN [left(t, length(t) - 3), right(t, 3)] ELSE [t] END)) AS ts FROM {table}),
tok AS (SELECT doc_id{more}, unnest(range(0, len(ts))) AS idx, unnest(ts) AS value FROM toks)"""


TYPE = case([(f"regexp_matches(value, '{q(p)}')", f"'{n}'") for n, p in T.TYPES], "'punctuation'")
CASE_ = case([(r"regexp_matches(value, '^[A-Z][A-Z\-–—.]*$')", "'upperCase'"), (r"regexp_matches(value, '^[a-z][a-z\-–—.]*$')", "'lowerCase'"), (r"regexp_matches(value, '^[A-Z][a-z\-–—.]*$')", "'titleCase'")], "'other'")
SHAPE = f"translate(value, '{T.ACCENTED}', '{T.PLAIN}')"
for _p, _s in T.SHAPES:
    SHAPE = f"regexp_replace({SHAPE}, '{_p}', '{_s}', 'g')"
SHAPE = f"translate({SHAPE}, '\x01\x02\x03', 'Xxd')"
NORMAL = case([(f"lower(value) = '{q(k)}'", f"'{v}'") for k, v in L.NORMALS.items()], "lower(value)")
WORDS = r"words AS (SELECT *, lower(value) AS term FROM tok WHERE regexp_matches(value, '[\p{L}]'))"
ENDS = r"(value IN ('.', '!', '?') OR regexp_matches(value, '^[\n\r\t]+$'))"
SENT = f"sent0 AS (SELECT *, lag(CASE WHEN {ENDS} THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM tok), sent AS (SELECT * EXCLUDE (n), sum(n) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS sent_idx FROM sent0)"
MARK = f"CASE WHEN lower(value) IN ({listed(L.CUES)}) THEN 1 WHEN lower(value) IN ({listed(L.TERMINATORS)}) THEN 0 END"
NEG = rf"neg0 AS (SELECT *, {MARK} AS mark FROM sent), neg AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, sent_idx ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND mark IS NULL AND regexp_matches(value, '[\p{{L}}\p{{N}}]') AS negated FROM neg0)"
SCORE = case([(f"lower(value) = '{w}'", f"{s}::DOUBLE / 1000") for w, s in L.SENTIMENT.items()], "NULL")
SENTIMENT = f"scored AS (SELECT doc_id, sent_idx, {SCORE} AS s, negated FROM neg), sentiment AS (SELECT doc_id, sent_idx, coalesce(sum(CASE WHEN negated THEN -s ELSE s END) / nullif(count(s), 0), 0.0) AS sentiment FROM scored GROUP BY ALL)"
_BY_END = [(f"regexp_extract(value, '{A._ENDINGS}') IN ({listed(x for x, t in L.SUFFIX_POS.items() if t == tag)})", f"'{tag}'") for tag in dict.fromkeys(L.SUFFIX_POS.values())]
_BY_START = [(f"regexp_extract(value, '{A._BEGINNINGS}') IN ({listed(x for x, t in L.PREFIX_POS.items() if t == tag)})", f"'{tag}'") for tag in dict.fromkeys(L.PREFIX_POS.values())]
UNKNOWN_POS = case([(f"NOT regexp_matches(value, '{A.SMALL}')", "'PROPN'"), *_BY_END, *_BY_START], "'NOUN'")
POS = case(
    [(f"lower(value) IN ({listed(w)})", f"'{t}'") for t, w in L.POS.items()] + [(f"({TYPE}) = '{n}'", f"'{t}'") for n, t in reversed(L.TYPE_POS.items())] + [(f"({TYPE}) = 'word'", UNKNOWN_POS), ("regexp_matches(value, '^[A-Z]')", "'PROPN'")],
    "'NOUN'",
)
LEMMA = case([(f"lower(value) = '{w}'", f"'{v}'") for w, v in L.IRREGULAR.items()] + [(f"regexp_matches(lower(value), '{p}')", f"left(lower(value), length(value) - {g}) || '{c}'") for p, g, c in L.LEMMA_RULES], "lower(value)")
ENTITY = case([(f"type = '{k}'", f"'{v}'") for k, v in L.ENTITY_NAMES.items()], "upper(type)")
_BARE = "regexp_replace(lower(value), 'e$', '')"
_GROUPS = "".join(f" {sign} regexp_matches({_BARE}, '{p}')::INT" for sign, own in (("+", L.MORE_SYLLABLES), ("-", L.FEWER_SYLLABLES)) for p in own)
SYLLABLES = f"CASE WHEN length(value) < 3 THEN 1 WHEN lower(value) IN ({listed(L.SYLLABLES)}) THEN MAP {{{', '.join(f"'{k}': {v}" for k, v in L.SYLLABLES.items())}}}[lower(value)] ELSE greatest(1, len(regexp_extract_all({_BARE}, '[aeiouy]+')){_GROUPS}) END"
BM25 = """tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY ALL),
shape AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM dl), idf AS (SELECT term, round(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM tf, shape GROUP BY term, n),
raw AS (SELECT doc_id, term, idf * 2.2::DOUBLE * tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean) + tf) AS w FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), shape)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"))


def toks(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    return A.tokenize(docs(spark, d), "text", "doc_id", *carry)


def count_of(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def by_value(spark: SparkSession, d: str) -> DataFrame:
    """(value, n): what depends on a token alone is told once for each distinct one."""
    return toks(spark, d).groupBy("value").agg(count_of())


def in_sentences(spark: SparkSession, d: str, **options) -> DataFrame:
    return A.annotated(docs(spark, d), **options)


@query(f"WITH {tok(more=', lang')} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens FROM tok GROUP BY lang")
def token_count_by_lang(spark, d):
    return toks(spark, d, "lang").groupBy("lang").agg(F.count_distinct("doc_id").alias("n_docs"), count_of("n_tokens"))


@query(f"WITH {tok()}, {WORDS} SELECT term, count(*) AS freq FROM words GROUP BY term")
def token_freq_table(spark, d):
    return A.words(by_value(spark, d)).groupBy("term").agg(F.sum("n").alias("freq"))


@query(f"WITH {tok(more=', lang')}, {WORDS}, f AS (SELECT lang, term, count(*) AS freq FROM words GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, term) AS rk FROM f) WHERE rk <= 20")
def top_terms_per_lang(spark, d):
    counts = A.words(toks(spark, d, "lang")).groupBy("lang", "term").agg(count_of("freq"))
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("freq"), "term")).cast("long")).filter("rk <= 20")


@query(f"WITH {tok()}, {WORDS} SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL")
def doc_bow(spark, d):
    return C.dealt(docs(spark, d))


@query(f"WITH {tok()}, {WORDS} SELECT doc_id, count(DISTINCT term) AS n_unique FROM words GROUP BY ALL")
def doc_unique_terms(spark, d):
    return A.words(toks(spark, d)).groupBy("doc_id").agg(F.count_distinct("term").alias("n_unique"))


@query(f"WITH {tok()}, {WORDS} SELECT doc_id, term, min(idx)::BIGINT AS first_idx FROM words GROUP BY ALL")
def unique_first_pos(spark, d):
    return A.words(toks(spark, d)).groupBy("doc_id", "term").agg(F.min("idx").cast("long").alias("first_idx"))


@query(f"WITH {tok()}, p AS (SELECT lower(value) AS t1, lower(lead(value) OVER (PARTITION BY doc_id ORDER BY idx)) AS t2 FROM tok) SELECT t1, t2, count(*) AS freq FROM p WHERE t2 IS NOT NULL GROUP BY ALL")
def bigram_freq(spark, d):
    rows = docs(spark, d).select(T.tokens(F.col("text")).alias("own")).filter(F.size("own") > 1)
    pairs = F.arrays_zip(F.slice("own", 1, F.size("own") - 1).alias("a"), F.slice("own", 2, F.size("own") - 1).alias("b"))
    counts = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(count_of("freq"))
    return counts.groupBy(F.lower("a").alias("t1"), F.lower("b").alias("t2")).agg(F.sum("freq").alias("freq"))


@query(f"WITH {tok()} SELECT {TYPE} AS type, count(*) AS n FROM tok GROUP BY ALL")
def token_type_counts(spark, d):
    return by_value(spark, d).groupBy(T.type_of(F.col("value")).alias("type")).agg(F.sum("n").alias("n"))


@query(f'WITH {tok()} SELECT {CASE_} AS "case", count(*) AS n FROM tok GROUP BY ALL')
def token_case_counts(spark, d):
    return by_value(spark, d).groupBy(T.case_of(F.col("value")).alias("case")).agg(F.sum("n").alias("n"))


@query(f"WITH {tok()} SELECT {SHAPE} AS shape, count(*) AS n FROM tok GROUP BY ALL")
def token_shape_freq(spark, d):
    return by_value(spark, d).groupBy(T.shape_of(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"))


@query(f"WITH {tok()} SELECT left(value, 2) AS prefix, count(*) AS n FROM tok GROUP BY ALL")
def prefix_freq(spark, d):
    return toks(spark, d).groupBy(T.prefix_of(F.col("value")).alias("prefix")).agg(count_of())


@query(f"WITH {tok()} SELECT right(value, 3) AS suffix, count(*) AS n FROM tok GROUP BY ALL")
def suffix_freq(spark, d):
    return toks(spark, d).groupBy(T.suffix_of(F.col("value")).alias("suffix")).agg(count_of())


@query(f"WITH {tok()} SELECT {NORMAL} AS normal, count(*) AS freq FROM tok GROUP BY ALL")
def normal_freq(spark, d):
    return by_value(spark, d).groupBy(T.normal_of(F.col("value")).alias("normal")).agg(F.sum("n").alias("freq"))


@query(f"WITH {tok()}, {WORDS} SELECT doc_id, count(*) FILTER (term IN ({listed(L.STOP_WORDS)})) AS n_stop, count(*) AS n_words, round(count(*) FILTER (term IN ({listed(L.STOP_WORDS)}))::DOUBLE / count(*), 6) AS ratio FROM words GROUP BY ALL")
def stopword_ratio(spark, d):
    rows = A.words(toks(spark, d)).groupBy("doc_id").agg(F.count_if(F.col("term").isin(*L.STOP_WORDS)).alias("n_stop"), count_of("n_words"))
    return rows.withColumn("ratio", F.round(F.col("n_stop") / F.col("n_words"), 6))


@query(rf"WITH {tok()} SELECT value AS term, count(*) AS n FROM tok WHERE regexp_matches(value, '(?i)^[a-z].*\.$') GROUP BY ALL")
def abbrev_tokens(spark, d):
    return toks(spark, d).filter(T.is_abbreviation(F.col("value"))).groupBy(F.col("value").alias("term")).agg(count_of())


#: Texts with short forms, which the tables lack.
SHORT = ((1, "I can't go, they won't and it isn't what we'd say."), (2, "You'll see I'm late; she's DON'T-ing."), (3, "We've been; they're here, he'd gone. N't"), (4, "no short forms"), (5, None))


@query(f"WITH short(doc_id, text) AS (VALUES {', '.join(f"({i}, {'NULL' if t is None else f"'{q(t)}'"})" for i, t in SHORT)}), {tok('short')} SELECT lower(value) AS part, {NORMAL} AS normal, count(*) AS n FROM tok WHERE lower(value) IN ({listed(L.NORMALS)}) GROUP BY ALL")
def contraction_expand(spark, d):
    rows = A.tokenize(spark.createDataFrame(SHORT, "doc_id long, text string"))
    return rows.filter(F.lower("value").isin(*L.NORMALS)).groupBy(F.lower("value").alias("part"), T.normal_of(F.col("value")).alias("normal")).agg(count_of())


_OUTER = A.OUTER.replace("$", r"\z")


@query(f"SELECT doc_id, length(regexp_replace(text, '{_OUTER}', '', 'g')) AS text_len, md5(regexp_replace(text, '{_OUTER}', '', 'g')) AS digest FROM documents")
def detokenize_check(spark, d):
    return A.detokenize(docs(spark, d)).select("doc_id", F.length("text").cast("long").alias("text_len"), F.md5("text").alias("digest"))


KNOWN = sorted({*L.STOP_WORDS, *L.SENTIMENT, *(w for own in L.POS.values() for w in own)})


@query(f"WITH {tok()}, {WORDS} SELECT DISTINCT term FROM words WHERE term NOT IN ({listed(KNOWN)})")
def oov_terms(spark, d):
    known = spark.createDataFrame([(w,) for w in KNOWN], "term string")
    return A.words(toks(spark, d)).select("term").distinct().join(F.broadcast(known), "term", "left_anti")


@query(f"WITH {tok()}, {WORDS} SELECT DISTINCT term FROM words WHERE term IN ({listed(KNOWN)})")
def in_vocab_terms(spark, d):
    known = spark.createDataFrame([(w,) for w in KNOWN], "term string")
    return A.words(toks(spark, d)).select("term").distinct().join(F.broadcast(known), "term", "left_semi")


@query(f"WITH {tok()}, {SENT} SELECT doc_id, max(sent_idx) + 1 AS n_sentences FROM sent GROUP BY ALL")
def sentence_count(spark, d):
    # a filter would find the number twice
    return docs(spark, d).select("doc_id", F.explode(F.array_compact(F.array(A.n_sentences(F.col("text"))))).alias("n_sentences"))


@query(f"WITH {tok()}, {SENT} SELECT doc_id, sent_idx, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last, string_agg(value, ' ' ORDER BY idx) AS text FROM sent GROUP BY ALL")
def sentence_text(spark, d):
    return A.sentence_spans(docs(spark, d))


@query(f"WITH {tok()}, {SENT}, {NEG} SELECT doc_id, idx::BIGINT AS idx, lower(value) AS term FROM neg WHERE negated")
def negated_tokens(spark, d):
    return in_sentences(spark, d).filter("negated").select("doc_id", F.col("idx").cast("long").alias("idx"), F.lower("value").alias("term"))


@query(f"WITH {tok()}, {SENT}, {NEG} SELECT doc_id, count(*) FILTER (negated) AS n_negated FROM neg GROUP BY ALL")
def negated_docs(spark, d):
    return in_sentences(spark, d, numbered=False).groupBy("doc_id").agg(F.count_if("negated").alias("n_negated"))


@query(f"WITH {tok()}, {SENT}, {NEG}, {SENTIMENT} SELECT doc_id, sent_idx, round(sentiment, 6) AS score FROM sentiment")
def sentence_sentiment(spark, d):
    return A.sentence_sentiment(in_sentences(spark, d, numbered=False)).select("doc_id", "sent_idx", F.round("sentiment", 6).alias("score"))


@query(f"WITH {tok()}, {SENT}, {NEG}, {SENTIMENT} SELECT doc_id, round(sum(sentiment) / count(*) + 1e-9::DOUBLE, 5) AS score FROM sentiment GROUP BY ALL")
def doc_sentiment(spark, d):
    return A.document_sentiment(in_sentences(spark, d, numbered=False)).select("doc_id", F.round(F.col("sentiment") + F.lit(1e-9), 5).alias("score"))


ENT = f"ent AS (SELECT doc_id, idx, value, {ENTITY} AS entity FROM (SELECT *, {TYPE} AS type FROM tok) WHERE type IN ({listed(L.ENTITIES)}))"


@query(f"WITH {tok()}, {ENT} SELECT doc_id, idx::BIGINT AS idx, value, entity FROM ent")
def entity_values(spark, d):
    return A.entities(toks(spark, d)).select("doc_id", F.col("idx").cast("long").alias("idx"), "value", "entity")


@query(f"WITH {tok()}, {ENT} SELECT entity, count(*) AS n, count(DISTINCT value) AS n_values FROM ent GROUP BY ALL")
def entity_type_freq(spark, d):
    return A.entities(by_value(spark, d)).groupBy("entity").agg(F.sum("n").alias("n"), count_of("n_values"))


@query(f"WITH {tok()}, {SENT}, ent AS (SELECT * FROM (SELECT *, {TYPE} AS type FROM sent) WHERE type IN ({listed(L.ENTITIES)})) SELECT doc_id, idx::BIGINT AS idx, sent_idx FROM ent")
def parent_sentence(spark, d):
    """The sentence that spans each entity, by an interval join within documents."""
    spans = A.sentence_spans(docs(spark, d))
    found = A.entities(toks(spark, d))
    inside = (F.col("doc_id") == F.col("own")) & F.col("idx").between(F.col("first"), F.col("last"))
    return found.join(spans.withColumnRenamed("doc_id", "own"), inside).select("doc_id", F.col("idx").cast("long").alias("idx"), "sent_idx")


@query(f"WITH {tok()}, {SENT}, ent AS (SELECT *, {TYPE} AS type FROM sent) SELECT doc_id, sent_idx, count(*) FILTER (type IN ({listed(L.ENTITIES)})) AS n_entities FROM ent GROUP BY ALL")
def sentence_entities(spark, d):
    return A.typed(in_sentences(spark, d, numbered=False, negated=False)).groupBy("doc_id", "sent_idx").agg(F.count_if(F.col("type").isin(*L.ENTITIES)).alias("n_entities"))


@query(f"WITH {tok()}, m AS (SELECT *, {TYPE} AS type FROM tok) SELECT doc_id, string_agg(CASE WHEN type IN ({listed(L.ENTITIES)}) THEN '<mark>' || value || '</mark>' ELSE value END, ' ' ORDER BY idx) AS marked FROM m GROUP BY doc_id")
def marked_up_text(spark, d):
    return A.marked_up(docs(spark, d))


@query(f"""WITH {tok()}, {SENT}, r AS (SELECT doc_id, count(*) FILTER (regexp_matches(value, '^[\\p{{L}}]')) AS n_words, max(sent_idx) + 1 AS n_sentences,
 coalesce(sum({SYLLABLES}) FILTER (regexp_matches(value, '^[\\p{{L}}]')), 0)::BIGINT AS n_syllables, count(*) FILTER (regexp_matches(value, '^[\\p{{L}}]') AND {SYLLABLES} > 3) AS n_complex FROM sent GROUP BY doc_id)
SELECT *, floor(206.835::DOUBLE - 1.015::DOUBLE * (n_words::DOUBLE / n_sentences) - 84.6::DOUBLE * (n_syllables::DOUBLE / n_words) + 0.5)::BIGINT AS fres FROM r WHERE n_words > 0""")
def readability(spark, d):
    return A.readability(docs(spark, d))


@query(f"WITH {tok()} SELECT {POS} AS pos, count(*) AS n FROM tok GROUP BY ALL")
def pos_default_tags(spark, d):
    return by_value(spark, d).groupBy(A.pos_of(F.col("value")).alias("pos")).agg(F.sum("n").alias("n"))


_OPEN = listed(L.OPEN_CLASSES)


@query(f"""WITH {tok()}, {SENT}, tagged AS (SELECT * FROM (SELECT doc_id, sent_idx, idx, {POS} AS pos FROM sent) WHERE pos NOT IN ('SPACE', 'PUNCT')),
runs AS (SELECT doc_id, sent_idx, pos AS t0, lead(pos, 1) OVER w AS t1, lead(pos, 2) OVER w AS t2, lead(pos, 3) OVER w AS t3 FROM tagged WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY idx)),
weighed AS (SELECT doc_id, sent_idx, greatest(0, count(*) OVER (PARTITION BY doc_id, t0, t1, t2, t3) - (t0 NOT IN ({_OPEN}))::INT - (t1 NOT IN ({_OPEN}))::INT - (t2 NOT IN ({_OPEN}))::INT - (t3 NOT IN ({_OPEN}))::INT) AS w FROM runs WHERE t3 IS NOT NULL),
sums AS (SELECT doc_id, sent_idx, sum(w)::DOUBLE AS w FROM weighed GROUP BY ALL)
SELECT doc_id, sent_idx, round(w / CASE WHEN max(w) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE max(w) OVER (PARTITION BY doc_id) END, 4) AS importance FROM sums""")
def sentence_importance(spark, d):
    return A.sentence_importance(docs(spark, d))


@query(f"WITH {tok()}, {WORDS} SELECT {LEMMA} AS lemma, count(*) AS freq FROM words GROUP BY ALL")
def lemma_freq(spark, d):
    counts = A.words(toks(spark, d)).groupBy("value").agg(count_of())
    return counts.groupBy(A.lemma_of(F.col("value")).alias("lemma")).agg(F.sum("n").alias("freq"))


@query(f"WITH {tok()}, {WORDS}, {BM25} SELECT term, idf FROM idf")
def bm25_idf(spark, d):
    return C.bm25_idf(C.dealt(docs(spark, d)))


def _bm25(norm: str, size: str):
    def run(spark, d):
        return C.bm25_weights(C.dealt(docs(spark, d)), norm=norm)

    run.__name__ = f"bm25_{norm}"
    return query(f"WITH {tok()}, {WORDS}, {BM25} SELECT doc_id, term, round(w / coalesce(nullif({size}, 0), 1), 6) AS w FROM raw")(run)


for _norm, _size in (("none", "1.0::DOUBLE"), ("l1", "sum(abs(w)) OVER (PARTITION BY doc_id)"), ("l2", "sqrt(sum(w * w) OVER (PARTITION BY doc_id))")):
    _bm25(_norm, _size)


@query(f"""WITH {tok()}, {WORDS}, {BM25}, ranked AS (SELECT doc_id, round(sum(w), 4) AS score FROM raw WHERE term IN ('the', 'of', 'with', 'trash') GROUP BY ALL)
SELECT doc_id, score, rk FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM ranked) WHERE rk <= 50""")
def bm25_search_topk(spark, d):
    weights = C.bm25_weights(C.dealt(docs(spark, d)), precision=15).filter(F.col("term").isin("the", "of", "with", "trash"))
    best = weights.groupBy("doc_id").agg(F.round(F.sum("w"), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)
    return best.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


TURN = "conv_id * 100000 + turn"


@query(f"""WITH {tok('conversations', TURN, 'text')}, {WORDS}, tf AS (SELECT doc_id AS key, term, count(*) AS tf FROM words GROUP BY ALL), sz AS (SELECT key, sqrt(sum(tf * tf)::DOUBLE) AS s FROM tf GROUP BY ALL),
pairs AS (SELECT DISTINCT x.conv_id * 100000 + x.turn AS a, y.conv_id * 100000 + y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
d AS (SELECT a, b, coalesce(sum(l.tf * r.tf), 0)::DOUBLE AS dot FROM pairs LEFT JOIN tf l ON l.key = a LEFT JOIN tf r ON r.key = b AND r.term = l.term GROUP BY ALL)
SELECT a, b, CASE WHEN s1.s IS NULL AND s2.s IS NULL THEN 1.0 WHEN s1.s IS NULL OR s2.s IS NULL THEN 0.0 ELSE round(dot / (s1.s * s2.s), 6) END::DOUBLE AS similarity FROM d LEFT JOIN sz s1 ON s1.key = a LEFT JOIN sz s2 ON s2.key = b""")
def bow_cosine(spark, d):
    """Of each turn of a conversation and the next."""
    turns = read(spark, d, "conversations").withColumn("key", F.expr(TURN))
    bags = C.bag(A.words(A.tokenize(turns, "text", "key")), "doc_id").withColumnRenamed("doc_id", "key")
    x, y = turns.select("conv_id", "turn", F.col("key").alias("a")), turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("key").alias("b"))
    return C.bow_cosine(x.join(y, ["conv_id", "turn"]).select("a", "b").distinct(), bags)


def _set_sql(value: str) -> str:
    return f"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS s FROM conversations),
p AS (SELECT x.conv_id, x.turn, len(list_intersect(x.s, y.s))::DOUBLE AS i, len(x.s)::DOUBLE AS m, len(y.s)::DOUBLE AS n FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, (CASE WHEN m = 0 AND n = 0 THEN 1.0 WHEN m = 0 OR n = 0 THEN 0.0 ELSE round({value}, 6) END)::DOUBLE AS similarity FROM p"""


def _set(name: str, value: str, measure):
    def run(spark, d):
        turns = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("s"))
        after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("s2"))
        return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", measure(F.col("s"), F.col("s2")).alias("similarity"))

    run.__name__ = name
    return query(_set_sql(value))(run)


_set("sorensen_dice", "i / (i + 0.5 * (m - i) + 0.5 * (n - i))", C.tversky)
_set("jaccard", "i / (m + n - i)", lambda a, b: C.tversky(a, b, 1, 1))
_set("tversky", "i / (i + 0.75 * (m - i) + 0.25 * (n - i))", lambda a, b: C.tversky(a, b, 0.75, 0.25))
_set("otsuka_ochiai", "i / sqrt(m * n)", C.otsuka_ochiai)

MEAN = "parts AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, round(avg(x), 6) AS x FROM parts GROUP BY ALL), mean AS (SELECT label, list(x ORDER BY i) AS mean FROM m GROUP BY label)"


@query(f"WITH {MEAN} SELECT label, array_to_string(list_transform(mean, lambda x: round(x, 4)::VARCHAR), ' ') IS NOT NULL AS known, len(mean)::BIGINT AS dims, round(list_sum(mean), 4) AS total FROM mean")
def mean_vector_by_label(spark, d):
    means = C.mean_vector(read(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.lit(True).alias("known"), F.size("mean").cast("long").alias("dims"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {MEAN}, s AS (SELECT vec_id, mean.label AS near, round(list_dot_product(embedding::DOUBLE[], mean) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(mean, mean))), 4) AS similarity FROM embeddings, mean)
SELECT vec_id, near, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, near) AS rk FROM s) WHERE rk = 1""")
def vector_cosine_nearest(spark, d):
    """Each vector's nearest label by the cosine with the label's mean."""
    return C.nearest_mean(read(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query(f"WITH {tok('conversations', 'conv_id', 'text', ', role')}, {WORDS} SELECT role, term, count(*) AS n FROM words GROUP BY ALL")
def conversations_role_terms(spark, d):
    return A.words(A.tokenize(read(spark, d, "conversations"), "text", "conv_id", "role")).groupBy("role", "term").agg(count_of())


@query(f"WITH bare AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages), {tok('bare', 'page_id', 'text')}, {WORDS} SELECT term, count(*) AS n FROM words GROUP BY ALL")
def pages_text_terms(spark, d):
    bare = read(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return A.words(A.tokenize(bare, "text", "page_id")).groupBy("term").agg(count_of())


#: Patterns over parts of speech.
TAG_PATTERNS = [("noun phrase", "[DET] [|ADJ] [NOUN]"), ("name", "[PROPN] [PROPN]"), ("action", "[AUX] [|ADV] [VERB]")]
_WAYS = sorted(((way, name) for name, pattern in TAG_PATTERNS for way in P.compose(pattern)), key=lambda x: -len(x[0]))
TYPED = f"typed AS MATERIALIZED (SELECT *, {TYPE} AS type FROM tok)"
_POS_OF_TYPED = POS.replace(f"({TYPE})", "type")
TAGGED = f"{TYPED}, tagged AS MATERIALIZED (SELECT *, {_POS_OF_TYPED} AS pos FROM typed)"
_LETTERS = case([(f"pos = '{tag}'", f"'{letter}'") for tag, letter in A.TAGS.items()], "'?'")


@query(f"""WITH {tok()}, {TAGGED}, letters AS (SELECT doc_id, string_agg(({_LETTERS}), '' ORDER BY idx) AS s FROM tagged GROUP BY doc_id),
piece AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all(s, '{"|".join("".join(A.TAGS[x] for x in way) for way, _ in _WAYS)}|.') AS ps FROM letters)),
placed AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS last FROM piece)
SELECT doc_id, last - length(p) + 1 AS first, last, {case([(f"p = '{''.join(A.TAGS[x] for x in way)}'", f"'{name}'") for way, name in _WAYS], "NULL")} AS name FROM placed WHERE length(p) > 1""")
def custom_entities(spark, d):
    """Patterns over parts of speech, leftmost and longest, without overlaps."""
    return P.match_tags(docs(spark, d), TAG_PATTERNS)


_STEM_REGION = lambda w: f"(CASE WHEN regexp_extract({w}, '[aeiouy]+[^aeiouy](.+)', 1) = '' THEN '' WHEN regexp_matches({w}, '^({'|'.join(STEM.BEGINNINGS)})') THEN regexp_replace({w}, '^({'|'.join(STEM.BEGINNINGS)})', '') ELSE regexp_extract({w}, '[aeiouy]+[^aeiouy](.+)', 1) END)"
_STEM_SECOND = lambda w: f"regexp_extract({_STEM_REGION(w)}, '[aeiouy]+[^aeiouy](.+)', 1)"
_STEM_SHORT = lambda w: f"regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywx3]$|^[aeiouy][^aeiouy]?$')"


def _stem_step(w: str, suffixes, region, result) -> str:
    """The longest suffix that fits is tried, if the region holds it."""
    ordered = sorted(suffixes, key=len, reverse=True)
    return case([(f"ends_with({w}, '{x}')", f"CASE WHEN length({region(w)}) >= {len(x)} THEN {result(x)} ELSE {w} END") for x in ordered], w)


def _stem_sql() -> str:
    cut = lambda x, come="": f"left(w, length(w) - {len(x)}) || '{come}'"
    derived = lambda x: f"CASE WHEN regexp_matches(w, 'logi$') THEN {cut(x, 'og')} ELSE w END" if x == "ogi" else f"CASE WHEN regexp_matches(w, '[{STEM.BEFORE_LI}]li$') THEN {cut(x)} ELSE w END" if x == "li" else cut(x, STEM.STEP2[x])
    formed = lambda x: f"CASE WHEN length({_STEM_SECOND('w')}) >= 5 THEN {cut(x)} ELSE w END" if x == "ative" else cut(x, STEM.STEP3[x])
    ended = lambda x: f"CASE WHEN regexp_matches(w, '[st]ion$') THEN {cut(x)} ELSE w END" if x == "ion" else cut(x)
    steps = [
        "regexp_replace(regexp_replace(w, '^y', '3'), '([aeiou])y', '\\13')",
        "regexp_replace(regexp_replace(regexp_replace(w, '[’'']s$', ''), 's[’'']$', ''), '[’'']$', '')",
        case([("regexp_matches(w, '.sses$')", "left(w, length(w) - 2)"), ("regexp_matches(w, '..(ied|ies)$')", "left(w, length(w) - 2)"), ("regexp_matches(w, '.(ied|ies)$')", "left(w, length(w) - 1)"), ("regexp_matches(w, '.(us|ss)$')", "w"), ("regexp_matches(w, '[aeiouy].+s$')", "left(w, length(w) - 1)")], "w"),
    ]
    past = f"regexp_replace(w, '(ed|edly|ing|ingly)$', '')"
    later = [
        case([("regexp_matches(w, '(eed|eedly)$')", f"CASE WHEN regexp_matches({_STEM_REGION('w')}, '(eed|eedly)$') THEN regexp_replace(w, '(eedly|eed)$', 'ee') ELSE w END"), ("regexp_matches(w, '[aeiouy].*(ed|edly|ing|ingly)$')", f"'-' || {past}")], "w"),
        case([("left(w, 1) <> '-'", "w"), ("regexp_matches(w, '(at|bl|iz)$')", "substr(w, 2) || 'e'"), (f"regexp_matches(w, '({'|'.join(STEM.DOUBLES)})$')", "substr(w, 2, length(w) - 2)"), (f"{_STEM_SHORT('substr(w, 2)')} AND {_STEM_REGION('substr(w, 2)')} = ''", "substr(w, 2) || 'e'")], "substr(w, 2)"),
        "regexp_replace(w, '(.[^aeiouy])[y3]$', '\\1i')",
        _stem_step("w", STEM.STEP2, _STEM_REGION, derived),
        _stem_step("w", STEM.STEP3, _STEM_REGION, formed),
        _stem_step("w", STEM.STEP4, _STEM_SECOND, ended),
        case([("ends_with(w, 'e')", f"CASE WHEN {_STEM_SECOND('w')} <> '' OR {_STEM_REGION('w')} <> '' AND NOT {_STEM_SHORT('left(w, length(w) - 1)')} THEN left(w, length(w) - 1) ELSE w END"), (f"ends_with(w, 'll') AND {_STEM_SECOND('w')} <> ''", "left(w, length(w) - 1)")], "w"),
    ]
    whole = f"length(lower(term)) < 3 OR lower(term) IN ({listed(STEM.EXCEPTIONS)})"
    out = [f"st0 AS MATERIALIZED (SELECT term, n, {whole} AS done, CASE WHEN length(lower(term)) < 3 THEN lower(term) ELSE coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in STEM.EXCEPTIONS.items())}}}[lower(term)], lower(term)) END AS w FROM counted)"]
    for i, step in enumerate([*steps, None, *later]):
        if step is None:
            out.append(f"st{i + 1} AS MATERIALIZED (SELECT term, n, done OR w IN ({listed(STEM.KEPT)}) AS done, w FROM st{i})")
        else:
            out.append(f"st{i + 1} AS MATERIALIZED (SELECT term, n, done, CASE WHEN done THEN w ELSE {step} END AS w FROM st{i})")
    # what is done before the steps keeps its digits
    return ", ".join(out), f"st{len(steps) + len(later) + 1}"


_STEPS, _LAST_STEP = _stem_sql()


@query(f"WITH {tok()}, {WORDS}, counted AS (SELECT term, count(*) AS n FROM words GROUP BY term), {_STEPS} SELECT CASE WHEN {f'length(term) < 3 OR term IN ({listed(STEM.EXCEPTIONS)})'} THEN w ELSE replace(w, '3', 'y') END AS stem, sum(n)::BIGINT AS freq FROM {_LAST_STEP} GROUP BY 1")
def stem_freq(spark, d):
    return STEM.stems(A.words(toks(spark, d)).groupBy("term").agg(count_of())).groupBy("stem").agg(F.sum("n").alias("freq"))


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS near, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS distance
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT vec_id, near, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, near) AS rk FROM p) WHERE rk = 1""")
def manhattan_nn(spark, d):
    from textloom.operators.vectors import nearest

    rows = read(spark, d, "embeddings")
    return nearest(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding")


def _pos_chain() -> str:
    """One subquery a rule, each over the tags that the last one left."""
    out = [f"c0 AS (SELECT doc_id, sent_idx, idx, {POS} AS pos FROM sent)"]
    for i, (tag, to, before, after) in enumerate(L.POS_RULES):
        fits = f"pos = '{tag}'" + (f" AND coalesce(lag(pos) OVER w, '') = '{before}'" if before else "") + (f" AND coalesce(lead(pos) OVER w, '') = '{after}'" if after else "")
        out.append(f"c{i + 1} AS (SELECT doc_id, sent_idx, idx, CASE WHEN {fits} THEN '{to}' ELSE pos END AS pos FROM c{i} WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY idx))")
    return ", ".join(out)


@query(f"WITH {tok()}, {SENT}, {_pos_chain()} SELECT pos, count(*) AS n FROM c{len(L.POS_RULES)} GROUP BY ALL")
def pos_contextual_tags(spark, d):
    letters = docs(spark, d).select(F.explode(F.split(F.translate(A.tag_string(F.col("text"), contextual=True), "\n", ""), "")).alias("tag"))
    names = F.create_map(*[F.lit(x) for tag, letter in A.TAGS.items() for x in (letter, tag)])
    return letters.groupBy("tag").agg(count_of()).filter("tag <> ''").select(F.element_at(names, F.col("tag")).alias("pos"), "n")


HINT = case([(f"regexp_matches(lower(t), '{q(p)}')", f"'{h}'") for h, p in L.HINTS], "'x'")
PHRASE = case([(f"regexp_matches(shape, '^(?:{w})$')", f"'{n}'") for n, w in L.PHRASES], "NULL")
PHRASES = f"""pieces AS (SELECT doc_id, regexp_extract_all(array_to_string(list_transform(ts, lambda t: ({HINT}) || chr(1) || t || chr(2)), ''), '{L.phrase_pattern()}') AS ps FROM toks),
piece AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS piece FROM pieces),
placed AS (SELECT *, len(regexp_extract_all(piece, chr(2))) AS n, sum(len(regexp_extract_all(piece, chr(2)))) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS last, regexp_replace(piece, '\x01[^\x02]*\x02', '', 'g') AS shape FROM piece),
phrases AS (SELECT doc_id, (last - n + 1)::BIGINT AS first, last, array_to_string(regexp_extract_all(piece, '\x01([^\x02]*)\x02', 1), ' ') AS value, entity FROM (SELECT *, {PHRASE} AS entity FROM placed) WHERE entity IS NOT NULL)"""


@query(f"WITH {tok()}, {PHRASES} SELECT * FROM phrases")
def phrase_entity_values(spark, d):
    return A.phrase_entities(docs(spark, d))


def _sentence_spans(spark, d):
    return A.sentence_spans(docs(spark, d)).select("doc_id", F.col("sent_idx").alias("idx"), "first", "last")


SENT_SPANS = "spans AS (SELECT doc_id, sent_idx, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last FROM sent GROUP BY ALL)"


@query(f"WITH {tok()}, {SENT}, {SENT_SPANS}, {PHRASES} SELECT doc_id, sent_idx, p.first, value FROM spans s JOIN phrases p USING (doc_id) WHERE p.first <= s.last AND p.last >= s.first")
def sentence_phrases(spark, d):
    """The phrases that share a token with each sentence."""
    found = A.phrase_entities(docs(spark, d)).withColumn("idx", F.col("first"))
    pairs = S.overlap_join(_sentence_spans(spark, d), found)
    values = found.select("doc_id", F.col("first").alias("inner_idx"), "value")
    return pairs.join(values, ["doc_id", "inner_idx"]).select("doc_id", F.col("outer_idx").alias("sent_idx"), F.col("inner_idx").alias("first"), "value")


@query(f"""WITH {tok()}, {SENT}, {SENT_SPANS}, {PHRASES} SELECT s.doc_id, sent_idx, CASE WHEN count(p.first) = 0 THEN -1 ELSE count(*) FILTER (p.last < s.first)
 - CASE WHEN bool_or(p.first <= s.first AND p.last >= s.first) THEN 0 ELSE 0.5 END END::DOUBLE AS place FROM spans s LEFT JOIN phrases p ON p.doc_id = s.doc_id GROUP BY s.doc_id, sent_idx""")
def locate_sentence_starts(spark, d):
    """Where each sentence begins among its document's phrases."""
    spans = A.phrase_entities(docs(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    rows = _sentence_spans(spark, d).join(spans, "doc_id", "left")
    listed = F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return rows.select("doc_id", F.col("idx").alias("sent_idx"), S.locate(F.col("first"), listed).alias("place"))


@query(f"""WITH {tok()}, {SENT}, r AS (SELECT doc_id, count(*) FILTER (regexp_matches(value, '^[\\p{{L}}]')) AS n_words, max(sent_idx) + 1 AS n_sentences, coalesce(sum({SYLLABLES}) FILTER (regexp_matches(value, '^[\\p{{L}}]')), 0)::BIGINT AS n_syllables FROM sent GROUP BY doc_id),
t AS (SELECT doc_id, n_words / (200.0::DOUBLE + (206.835::DOUBLE - 1.015::DOUBLE * (n_words::DOUBLE / n_sentences) - 84.6::DOUBLE * (n_syllables::DOUBLE / n_words))) AS t FROM r WHERE n_words > 0)
SELECT doc_id, floor(t)::BIGINT AS mins, floor((t - floor(t)) * 60 + 0.5)::BIGINT AS secs FROM t""")
def reading_time(spark, d):
    return A.reading_time(A.readability(docs(spark, d))).select("doc_id", "mins", "secs")


@query(f"WITH {tok()}, w AS (SELECT DISTINCT doc_id, lower(value) AS value FROM tok WHERE regexp_matches(value, '^[\\p{{L}}]')) SELECT doc_id, value AS term, ({SYLLABLES} - 3)::BIGINT AS extra FROM w WHERE {SYLLABLES} > 3")
def complex_words(spark, d):
    return A.complex_words(docs(spark, d))


ASKED = ["the", "of", "trash", "the", "unseen-term"]
_asked = f"asked AS (SELECT term, count(*) AS tf FROM (SELECT unnest([{listed(ASKED)}]) AS term) GROUP BY ALL)"
_bound = f"(1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {len(ASKED)} / mean))"


def _model(spark, d, norm="none"):
    return C.Bm25.learn(C.dealt(docs(spark, d)), norm=norm)


@query(f"""WITH {tok()}, {WORDS}, {BM25}, {_asked}, own AS MATERIALIZED (SELECT term, idf * 2.2::DOUBLE * asked.tf / ({_bound} + asked.tf) AS w FROM asked JOIN idf USING (term), shape WHERE idf <> 0),
size AS (SELECT coalesce(nullif(sqrt(sum(w * w)), 0), 1) AS s FROM own)
SELECT idf.term, coalesce(round(own.w / s, 6), 0)::DOUBLE AS w FROM idf LEFT JOIN own USING (term) CROSS JOIN size""")
def bm25_vector_of(spark, d):
    """A list of words as a vector over the corpus's terms."""
    return _model(spark, d, "l2").vector_of(ASKED)


@query(f"""WITH {tok()}, {WORDS}, {BM25}, {_asked} SELECT term, round(coalesce(nullif(idf, 0), 1.0::DOUBLE) * 2.2::DOUBLE * asked.tf / ({_bound} + asked.tf), 6) AS w FROM asked LEFT JOIN idf USING (term), shape""")
def bm25_bow_of(spark, d):
    """A list of words as a bag, unknown ones included."""
    return _model(spark, d).bow_of(ASKED, process_oov=True)


@query(f"WITH {tok()}, {WORDS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM (SELECT DISTINCT term FROM words)")
def bm25_terms(spark, d):
    return _model(spark, d).terms()


@query(f"""WITH {tok()}, {WORDS}, {BM25}, p AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM idf)
SELECT doc_id, string_agg(position::VARCHAR, ' ' ORDER BY position) AS positions, round(sum(round(w, 6)), 3) AS total FROM raw JOIN p USING (term) GROUP BY doc_id""")
def bm25_doc_term_matrix(spark, d):
    """The sparse rows of the matrix: columns, and the sum of their weights."""
    counts = C.dealt(docs(spark, d))
    rows = C.doc_term_matrix(C.bm25_weights(counts), C.Bm25.learn(counts).terms())
    return rows.select("doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


EXAMPLES = [{"name": "noun phrase", "patterns": ["[|DET] [ADJ] [NOUN]"], "mark": [-2, -1]}, {"name": "amount", "patterns": ["[CARDINAL|MONEY] [of|NOUN]"]}, {"name": "title", "patterns": ["the [PROPN] [|PROPN]"]}]
_D, _A, _N, _P = (A.TAGS[x] for x in ("DET", "ADJ", "NOUN", "PROPN"))
#: The ways of EXAMPLES over one sign a symbol: letters of tags, t and o for the words, 1, 2 and 0 for entities; and from which symbol on they are marked.
_EXAMPLE_WAYS = ((f"{_D}{_A}{_N}", "noun phrase", 1), (f"t{_P}{_P}", "title", 0), (f"{_A}{_N}", "noun phrase", 0), *((f"{x}{y}", "amount", 0) for x in "12" for y in ("o", _N)), (f"t{_P}", "title", 0))


@query(f"""WITH {tok()}, {TAGGED}, {PHRASES}, ents AS MATERIALIZED (SELECT doc_id, first, last, entity FROM phrases UNION ALL SELECT doc_id, idx, idx, upper(type) FROM typed WHERE type IN ('email', 'url', 'mention', 'hashtag', 'emoji', 'emoticon')),
covered AS (SELECT doc_id, unnest(range(first, last + 1)) AS idx FROM ents),
syms AS MATERIALIZED (SELECT doc_id, first, last, CASE entity WHEN 'CARDINAL' THEN '1' WHEN 'MONEY' THEN '2' ELSE '0' END AS s FROM ents
 UNION ALL SELECT doc_id, idx, idx, CASE lower(value) WHEN 'the' THEN 't' WHEN 'of' THEN 'o' ELSE {_LETTERS} END FROM tagged ANTI JOIN covered USING (doc_id, idx)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS k FROM syms),
bit AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all(string_agg(s, '' ORDER BY first), '{"|".join(w for w, _, _ in _EXAMPLE_WAYS)}|.') AS ps FROM syms GROUP BY doc_id)),
put AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM bit),
found AS MATERIALIZED (SELECT doc_id, e, e - length(p) + 1 + {case([(f"p = '{w}'", str(m)) for w, _, m in _EXAMPLE_WAYS], "0")} AS b, {case([(f"p = '{w}'", f"'{n}'") for w, n, _ in _EXAMPLE_WAYS], "NULL")} AS name FROM put WHERE length(p) > 1)
SELECT f.doc_id, x.first::BIGINT AS first, y.last::BIGINT AS last, array_to_string(ts[x.first + 1:y.last + 1], ' ') AS value, name FROM found f JOIN numbered x ON x.doc_id = f.doc_id AND x.k = b JOIN numbered y ON y.doc_id = f.doc_id AND y.k = e JOIN toks ON toks.doc_id = f.doc_id""")
def custom_entities_by_example(spark, d):
    """Examples with words, parts of speech, entity types and a mark."""
    return P.custom_entities(docs(spark, d), EXAMPLES)


_SPACED = q(rf"([\s\x{{A0}}\x{{2002}}-\x{{2005}}\x{{2009}}\x{{200A}}\x{{202F}}\x{{205F}}]*?)({T.PATTERN})")


@query(f"""WITH {tok()}, {PHRASES}, parts AS (SELECT doc_id, regexp_extract_all(text, '{_SPACED}', 1) AS sp, regexp_extract_all(text, '{_SPACED}', 2) AS vs FROM documents),
pieces2 AS (SELECT doc_id, flatten(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN regexp_matches(vs[i], '{q(T.NEGATED)}') THEN [sp[i], ''] ELSE [sp[i]] END)) AS sp, ts FROM parts JOIN toks USING (doc_id)),
shown AS (SELECT doc_id, unnest(range(0, len(ts))) AS idx, unnest(sp) AS sp, unnest(ts) AS value FROM pieces2),
marked AS (SELECT s.doc_id, string_agg(sp || CASE WHEN b.first IS NULL THEN '' ELSE '<mark>' END || s.value || CASE WHEN e.last IS NULL THEN '' ELSE '</mark>' END, '' ORDER BY idx) AS m
 FROM shown s LEFT JOIN phrases b ON b.doc_id = s.doc_id AND b.first = idx LEFT JOIN phrases e ON e.doc_id = s.doc_id AND e.last = idx GROUP BY s.doc_id)
SELECT doc_id, coalesce(regexp_replace(m, '{_OUTER}', '', 'g'), '') AS marked FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN marked USING (doc_id)""")
def marked_phrases(spark, d):
    """Texts with a sign around every phrase."""
    found = A.phrase_entities(docs(spark, d)).withColumn("seq", F.col("first"))
    return S.apply_markings(docs(spark, d), found)


#: Contractions and lexemes as a user's tables would have them.
CONTRACTIONS = (("gonna", (("gon", "going", "go", "VERB"), ("na", "to", "to", "PART"))), ("cannot", (("can", "can", "can", "AUX"), ("not", "not", "not", "PART"))), ("of", (("o", "of", "of", "ADP"), ("f", "of", "of", "ADP"))))
LEXEMES = (("the", "the", ("DET",), "the", True), ("of", "of", ("ADP",), "of", True), ("trash", "trash", ("NOUN", "VERB"), "trash", False), ("idiot", "idiot", ("NOUN",), "idiot", False), ("colour", "color", ("NOUN",), "color", False))
_values = lambda rows: ", ".join(f"({', '.join(r)})" for r in rows)
_s = lambda x: f"'{x}'"


@query(f"""WITH {tok()}, parts(text, part, value2, normal, lemma, pos) AS (VALUES {_values((_s(t), str(i), *map(_s, p)) for t, ps in CONTRACTIONS for i, p in enumerate(ps))})
SELECT coalesce(part, 0)::BIGINT AS part, coalesce(value2, lower(value)) AS term, normal, pos, count(*) AS n FROM tok LEFT JOIN parts ON lower(value) = text GROUP BY ALL""")
def lexicon_expand(spark, d):
    """Tokens with a user's contractions in their parts, counted."""
    table = spark.createDataFrame([(t, ps) for t, ps in CONTRACTIONS], f"text string, parts {LEX.PART}")
    rows = LEX.expand(toks(spark, d), table)
    return rows.select(F.col("part").cast("long").alias("part"), F.when(F.col("normal").isNull(), F.lower("value")).otherwise(F.col("value")).alias("term"), "normal", "pos").groupBy("part", "term", "normal", "pos").agg(count_of())


@query(f"""WITH {tok()}, lex(lexeme, normal, tag, lemma, stop) AS (VALUES {_values((_s(w), _s(n), _s(t[0]) if len(t) == 1 else 'NULL', _s(m), str(k)) for w, n, t, m, k in LEXEMES)}),
counted AS (SELECT value, count(*) AS n FROM tok GROUP BY value),
found AS (SELECT c.value, c.n, coalesce(a.normal, b.normal, lower(c.value)) AS normal, coalesce(a.stop, b.stop, false) AS is_stop, a.lexeme IS NULL AND b.lexeme IS NULL AS is_oov,
 CASE WHEN a.lexeme IS NOT NULL THEN a.tag WHEN b.lexeme IS NOT NULL THEN CASE WHEN b.tag IN ('NOUN', 'ADJ') THEN 'PROPN' ELSE b.tag END ELSE {POS.replace('value', 'c.value')} END AS pos
 FROM counted c LEFT JOIN lex a ON a.lexeme = c.value LEFT JOIN lex b ON b.lexeme = lower(c.value))
SELECT is_oov, is_stop, pos, count(DISTINCT normal) AS n_normals, sum(n)::BIGINT AS n FROM found GROUP BY ALL""")
def lexicon_tags(spark, d):
    """What a user's lexicon tells of the tokens."""
    table = spark.createDataFrame(LEXEMES, "lexeme string, normal string, pos array<string>, lemma string, is_stop boolean")
    return LEX.annotate(toks(spark, d), table).groupBy("is_oov", "is_stop", "pos").agg(F.count_distinct("normal").alias("n_normals"), count_of())


@query(f"""WITH {tok()}, parts AS (SELECT doc_id, regexp_extract_all(text, '{_SPACED}', 1) AS sp, regexp_extract_all(text, '{_SPACED}', 2) AS vs FROM documents),
spaced AS (SELECT doc_id, unnest(flatten(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN regexp_matches(vs[i], '{q(T.NEGATED)}') THEN [sp[i], ''] ELSE [sp[i]] END))) AS sp FROM parts)
SELECT length(sp) AS n_spaces, count(*) AS n FROM spaced GROUP BY ALL""")
def preceding_spaces(spark, d):
    """How many spaces are before tokens."""
    return A.tokenize_spaced(docs(spark, d)).groupBy(F.length("spaces").cast("long").alias("n_spaces")).agg(count_of())


@query(f"WITH {tok()}, {TYPED} SELECT doc_id, {NORMAL} AS item, count(*) AS n FROM typed WHERE type = 'word' GROUP BY ALL")
def engine_freq_table(spark, d):
    """The fluent way: words by their normal form, and how often each document has them."""
    from textloom.engine import Engine, as_, its

    return Engine(()).read(docs(spark, d)).tokens().filter("type = 'word'").out(its.normal, as_.freq_table)


@query(f"""WITH {tok()}, {SENT}, {SENT_SPANS}, {PHRASES} SELECT s.doc_id, sent_idx, count(p.first) AS n_inside FROM spans s LEFT JOIN phrases p ON p.doc_id = s.doc_id AND p.first >= s.first AND p.last <= s.last GROUP BY ALL""")
def phrases_inside_sentences(spark, d):
    """How many phrases lie inside each sentence whole."""
    phrases = A.phrase_entities(docs(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    rows = _sentence_spans(spark, d).join(phrases, "doc_id", "left")
    listed = F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return rows.select("doc_id", F.col("idx").alias("sent_idx"), F.size(S.contained(F.col("first"), F.col("last"), listed)).cast("long").alias("n_inside"))


@query(f"""WITH {tok()}, {SENT}, {SENT_SPANS}, {PHRASES} SELECT p.doc_id, p.first, sent_idx AS parent FROM phrases p LEFT JOIN spans s ON p.doc_id = s.doc_id AND p.first BETWEEN s.first AND s.last""")
def phrase_parents(spark, d):
    """The sentence that each phrase begins in."""
    return S.parents(A.phrase_entities(docs(spark, d)), _sentence_spans(spark, d)).select("doc_id", F.col("first").cast("long").alias("first"), "parent")


#: Patterns over words: names, patterns, and what of a match is marked.
WORD_PATTERNS = [("of the", "[of|the] [the|and|of] [|and]"), ("and", "and"), ("0", "[and] [the]")]


@query(f"""WITH {tok()}, letters AS (SELECT doc_id, string_agg(CASE lower(value) WHEN 'the' THEN 't' WHEN 'of' THEN 'o' WHEN 'and' THEN 'a' ELSE '.' END, '' ORDER BY idx) AS s FROM tok GROUP BY doc_id),
bit AS (SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, regexp_extract_all(s, '[ot][tao]a|[ot][tao]|at|a|.') AS ps FROM letters)),
put AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS last FROM bit)
SELECT doc_id, last - length(p) + 1 AS first, last, CASE WHEN p = 'a' THEN 'and' ELSE 'of the' END AS name FROM put WHERE p NOT IN ('.', 'o', 't', 'at')""")
def word_patterns(spark, d):
    """Patterns over lower-cased tokens, leftmost and longest; what is named 0 is dropped."""
    symbols = F.transform(T.tokens(F.col("text")), F.lower)
    return P.match(docs(spark, d).select("doc_id", symbols.alias("symbols")), WORD_PATTERNS)


@query("""WITH asked AS (SELECT 'W' || (vec_id * 3) AS word FROM embeddings), v AS (SELECT 'w' || vec_id AS w, embedding FROM embeddings)
SELECT word, round(coalesce(list_sum(embedding[1:8]::DOUBLE[]), 4.0), 4) AS total FROM asked LEFT JOIN v ON lower(word) = w""")
def word_vectors(spark, d):
    """Words looked up in lower case in a table of vectors: the sum of their first eight numbers, halves for unknown ones."""
    from textloom.operators.vectors import vector_of

    rows = read(spark, d, "embeddings")
    asked = rows.select(F.concat(F.lit("W"), F.col("vec_id") * 3).alias("word"))
    found = vector_of(asked, rows.select(F.concat(F.lit("w"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec")), 8, unknown=[0.5] * 8)
    return found.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
