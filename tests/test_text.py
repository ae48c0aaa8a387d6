"""Golden texts of the tokenizer, features and annotators."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.stem import stem, stems
from textloom.operators import annotate as A
from textloom.operators import corpus as C
from textloom.operators import patterns as P


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(T.tokens(F.col("text"))).first()[0]


def value(spark, column, token):
    return spark.createDataFrame([(token,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("¡Hola! नमस्कार! Hi! Bonjour chéri", "¡|Hola|!|नमस्कार|!|Hi|!|Bonjour|chéri"),
        ("Hello   World🌎! How are you?", "Hello|World|🌎|!|How|are|you|?"),
        ("I can't go at 5pm, a@b.com", "I|ca|n't|go|at|5pm|,|a@b.com"),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, text) == expected.split("|")
    assert tokens(spark, None) is None and tokens(spark, " ") == []


def test_features(spark):
    for token, case in (("the", "lowerCase"), ("The", "titleCase"), ("THE", "upperCase"), ("ThE", "other"), ("1", "other")):
        assert value(spark, T.case_of, token) == case
    for token, shape in (("TheOne", "XxxXxx"), ("A1", "Xd"), ("Abcdef123456", "Xxxxxdddd"), ("Poincaré", "Xxxxx")):
        assert value(spark, T.shape_of, token) == shape
    assert value(spark, T.prefix_of, "prefix") == "pr" and value(spark, T.suffix_of, "prefix") == "fix"
    assert value(spark, T.normal_of, "N't") == "not" and value(spark, T.is_abbreviation, "I.")


STEMS = {
    "decisively": "decis", "wanted": "want", "ate": "ate", "ponies": "poni", "caresses": "caress", "skies": "sky", "skis": "ski", "news": "news", "dying": "die", "gently": "gentl", "hopelessly": "hopeless",
    "carefully": "care", "possibly": "possibl", "relational": "relat", "conditional": "condit", "rationalize": "ration", "formative": "format", "geology": "geolog", "happily": "happili", "ties": "tie", "gas": "gas",
    "this": "this", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed", "proceeds": "proceed", "inning": "inning", "say": "say", "by": "by", "cry": "cri", "dog's": "dog", "generate": "generat",
    "communism": "communism", "arsenal": "arsenal", "it": "it", "I": "i", "Running": "run", "falling": "fall", "controlled": "control", "rolled": "roll", "youth": "youth", "boyish": "boyish", "3rd": "yrd",
}


def test_stem(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    terms = spark.createDataFrame([("running", 1), (None, 2)], "term string, n int")
    assert [tuple(r) for r in stems(terms).collect()] == [("running", 1, "run"), (None, 2, None)]


@pytest.mark.parametrize(("word", "n"), [("a", 1), ("it", 1), ("people", 2), ("Wednesday", 2), ("dial", 2), ("table", 2), ("special", 2), ("nation", 2), ("hopes", 1), ("walked", 2), ("wanted", 2), ("prism", 3), ("queue", 1), ("readability", 5)])
def test_syllables(spark, word, n):
    assert value(spark, A.syllables_of, word) == n


def test_lemmas(spark):
    tokens = spark.createDataFrame([("Women", "NOUN"), ("boxes", "NOUN"), ("cats", "NOUN"), ("wolves", "NOUN"), ("mice", "NOUN"), ("liked", "VERB"), ("carries", "VERB"), ("runs", "VERB"), ("running", "VERB"), ("larger", "ADJ"), ("tallest", "ADJ"), ("cats", "ADV"), ("cats", "NOUN"), (None, "NOUN")], "value string, pos string")
    lexicon = spark.createDataFrame([("box", "NOUN"), ("cat", "NOUN"), ("wolf", "NOUN"), ("like", "VERB"), ("carry", "VERB"), ("run", "VERB"), ("large", "ADJ"), ("tall", "ADJ"), ("run", "VERB")], "word string, pos string")
    known = spark.createDataFrame([("mice", "NOUN", "mouse")], "word string, pos string, lemma string")
    got = {(r.value, r.pos): r.lemma for r in A.lemmas(tokens, lexicon, known).collect() if r.value}
    assert got == {("women", "NOUN"): "woman", ("boxes", "NOUN"): "box", ("cats", "NOUN"): "cat", ("wolves", "NOUN"): "wolf", ("mice", "NOUN"): "mouse", ("liked", "VERB"): "like", ("carries", "VERB"): "carry", ("runs", "VERB"): "run", ("running", "VERB"): "running", ("larger", "ADJ"): "large", ("tallest", "ADJ"): "tall", ("cats", "ADV"): "cats"}
    assert {r.value: r.lemma for r in A.lemmas(tokens, lexicon).collect()}["mice"] == "mice"


def test_quick_tokens(spark):
    """The quick pattern finds what the plain one does."""
    rng = random.Random(4)
    bits = ["the", "a", "Mr.", "Prof.", "I.", "word.", "x@y.com", "www.a.b", "http://x", "e-mail", "F-16", "AT&T", "can't", "N'T", "it's", "5pm", "21st", "'90s", "é", "naïve", "日本", "a\u0301b", "x1", "_", "#tag", "@me", ":-)", "🌎", " ", " ", "\n", "\t", "\u00a0", ".", ",", "!", "-", "'", "/", "&", "%", "3.5"]
    rows = [("".join(rng.choices(bits, k=rng.randint(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "text string")
    got = df.select("text", F.regexp_extract_all("text", F.lit(T.QUICK), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(T.PATTERN), F.lit(0)).alias("b")).filter("a <> b").collect()
    assert not got
    types = df.select(F.explode(T.tokens(F.col("text"))).alias("v")).distinct()
    plain = F.lit("punctuation")
    for name, pattern in reversed(T.TYPES):
        plain = F.when(F.col("v").rlike(pattern), F.lit(name)).otherwise(plain)
    assert types.filter(T.type_of(F.col("v")) != plain).count() == 0


def test_annotated(spark):
    """In the row, and over a table of tokens: the same."""
    rng = random.Random(7)
    bits = ["not", "n't", "No", "but", "and", ",", ".", "!", "?", "\n", "\n\n", "good", "Bad", "5", "cats", "a.b", "...", "can't", ";", "without", "however", "\ufdd0"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, ""), (401, None), (402, "not " * 20_000), (403, "x. " * 5000)], "doc_id long, text string")
    want = A.negation(A.sentences(A.tokenize(df.withColumn("text", F.translate("text", "\ufdd0", " ")))))
    columns = ["doc_id", "sent_idx", "idx", "value", "negated"]
    a, b = sorted(map(tuple, A.annotated(df).select(columns).collect())), sorted(map(tuple, want.select(columns).collect()))
    assert a == b
    assert A.annotated(df, numbered=False, negated=False).columns == ["doc_id", "sent_idx", "value"]
    counts = {r.doc_id: r.n for r in want.groupBy("doc_id").agg((F.max("sent_idx") + 1).alias("n")).collect()}
    assert {r.doc_id: r.n for r in df.select("doc_id", A.n_sentences(F.col("text")).alias("n")).collect() if r.n and r.n > 0} == counts
    spans = want.groupBy("doc_id", "sent_idx").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    assert sorted(map(tuple, A.sentence_spans(df).drop("text").collect())) == sorted(map(tuple, spans.collect()))
    tags = {r.doc_id: r.t for r in df.select("doc_id", A.tag_string(F.translate("text", "\ufdd0", " "), contextual=True).alias("t")).collect() if r.t}
    names = {v: k for k, v in A.TAGS.items()}
    listed = {}
    for r in A.contextual_pos(want).orderBy("doc_id", "idx").collect():
        listed.setdefault(r.doc_id, []).append(r.pos)
    assert {d: [names[c] for c in t if c != "\n"] for d, t in tags.items()} == listed


def test_sentences_and_negation(spark):
    df = spark.createDataFrame([(1, "I did not like. Not good but ok."), (2, ""), (3, None)], "doc_id long, text string")
    rows = A.negation(A.sentences(A.tokenize(df))).filter("negated").select("doc_id", "sent_idx", "value").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "like"), (1, 1, "good")]


def test_round_trip(spark):
    texts = ["  a  b\n c!", "x y z", "Hi 🌎 there. ", "", "\n a b \t\n", "\u00a0\u2003a\u3000", " \ufeff ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in A.detokenize(df).collect()} == {i: None if t is None else t.strip().strip("\ufeff").strip() for i, t in enumerate(texts)}


def test_bm25(spark):
    docs = ["rats are blue", "cats are white", "some rats rats are black"]
    bags = C.bag(spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in d.split()], "doc_id long, term string"))
    idf = {r.term: r.idf for r in C.bm25_idf(bags, 3).collect()}
    assert idf["rats"] == 0.470004 and idf["are"] == 0.133531 and idf["blue"] == 0.980829
    l2 = {(r.doc_id, r.term): r.w for r in C.bm25_weights(bags, norm="l2").collect()}
    assert (l2[0, "are"], l2[0, "blue"], l2[0, "rats"], l2[2, "rats"]) == (0.121858, 0.895087, 0.428917, 0.435158)
    l1 = {(r.doc_id, r.term): r.w for r in C.bm25_weights(bags, norm="l1").collect()}
    assert (l1[0, "are"], l1[2, "black"]) == (0.084281, 0.354256)
    with pytest.raises(ValueError):
        C.bm25_weights(bags, norm="l3")


def test_similarity(spark):
    a, b = F.array(*map(F.lit, ("dog", "chased", "cat"))), F.array(*map(F.lit, ("dog", "ate")))
    row = spark.range(1).select(C.tversky(a, b, 1, 0), C.tversky(a, b, 0.75, 0.25), C.tversky(a, b), C.tversky(a, b, 0, 1)).first()
    assert tuple(row) == (0.333333, 0.363636, 0.4, 0.5)
    c, d = F.array(*map(F.lit, ("the", "dog", "chased", "cat"))), F.array(*map(F.lit, ("the", "cat", "chased", "mouse")))
    assert spark.range(1).select(C.otsuka_ochiai(c, d)).first()[0] == 0.75
    with pytest.raises(ValueError):
        C.tversky(a, b, -1, 0)


def test_patterns(spark):
    assert len(P.compose("[$$DAY|$$MONTH_NUMBER|$$NUMBER] [|-] [$$TIME_UNITS.GE.DAY] [|ago]")) == 12
    assert P.compose("") == [] and P.compose("a b") == [["a b"]]
    found = P.Matcher([("ab", "[a] [b]"), ("abc", "[a] [b] [c]"), ("0", "[x]")]).find(list("abcxabx"))
    assert found == [(0, 2, "abc"), (4, 5, "ab")]
    df = spark.createDataFrame([(1, list("ab")), (2, None), (3, [])], "doc_id long, symbols array<string>")
    assert [tuple(r) for r in P.match(df, [("ab", "[a] [b]")]).collect()] == [(1, 0, 1, "ab")]
