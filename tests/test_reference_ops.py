"""Spans, marks, phrases, custom entities, the BM25 model, word vectors and the engine, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from textloom.engine import Engine, as_, its
from textloom.operators import annotate as A
from textloom.operators import corpus as C
from textloom.operators import lexicon as LX
from textloom.operators import patterns as P
from textloom.operators import spans as S
from textloom.operators import vectors as V

SPANS = [(2, 3), (8, 9), (17, 18), (21, 21), (24, 27), (33, 38)]


def one(spark, column):
    rows = spark.createDataFrame([(SPANS,)], "s array<struct<first:int,last:int>>")
    return rows.select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(("pos", "at"), [(1, -0.5), (2, 0), (4, 0.5), (9, 1), (50, 5.5)])
def test_locate(spark, pos, at):
    assert one(spark, lambda s: S.locate(F.lit(pos), s)) == at
    assert one(spark, lambda s: S.search(F.lit(pos), s)) == (at if at == int(at) else None)


@pytest.mark.parametrize(("first", "last", "found"), [(0, 1, []), (0, 6, [0]), (4, 7, []), (7, 19, [1, 2]), (30, 40, [5]), (40, 51, []), (25, 34, [4, 5])])
def test_overlap(spark, first, last, found):
    assert one(spark, lambda s: S.overlapping(F.lit(first), F.lit(last), s)) == found
    inside = [i for i, (a, b) in enumerate(SPANS) if a >= first and b <= last]
    assert one(spark, lambda s: S.contained(F.lit(first), F.lit(last), s)) == inside


@pytest.mark.parametrize(("mark", "area"), [((0, 5), (0, 0)), ((-6, -1), (0, 0)), ((2, 2), (2, 3)), ((-1, 5), (5, 0)), ((20, 500), (0, 0)), ((-10, 0), (0, 5)), ((-10, -7), (0, 0)), (None, (0, 0))])
def test_mark_area(mark, area):
    assert S.mark_area(mark, 6) == area


def test_markings(spark):
    df = spark.createDataFrame([(1, "  a b\n c "), (2, "d"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 0, 1, "<i>", "</i>"), (1, 1, 0, 0, None, None), (9, 0, 0, 0, None, None)], "doc_id long, seq int, first int, last int, begin string, end string")
    got = {r.doc_id: r.marked for r in S.apply_markings(df, marks).collect()}
    assert got == {1: "<mark><i>a</mark> b</i>\n c", 2: "d", 3: ""}


def test_phrases(spark):
    text = "On March 21st, 2020 I paid $ 30 for 5 days at 10:30 and 20 % of 7 on 2020-01-31; 21st March 1999 may"
    rows = A.phrase_entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("first").collect()
    assert [(r.value, r.entity) for r in rows] == [("March 21st , 2020", "DATE"), ("$ 30", "MONEY"), ("5 days", "DURATION"), ("10:30", "TIME"), ("20 %", "PERCENT"), ("7", "CARDINAL"), ("2020-01-31", "DATE"), ("21st March 1999", "DATE")]
    tokens = [r.value for r in A.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("idx").collect()]
    assert all(" ".join(tokens[r["first"] : r["last"] + 1]) == r.value for r in rows)


def test_contextual_pos(spark):
    rows = A.contextual_pos(A.sentences(A.tokenize(spark.createDataFrame([(1, "The building is. They dance. This is it.")], "doc_id long, text string"))))
    tags = {r.value: r.pos for r in rows.collect()}
    assert (tags["building"], tags["dance"], tags["This"], tags["The"]) == ("NOUN", "VERB", "PRON", "DET")


def entities(spark, text, examples, **options):
    rows = P.custom_entities(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), examples, **options).orderBy("first").collect()
    return [(r.value, r["name"]) for r in rows]


def test_custom_entities(spark):
    text = "My best friend has a good cat and $ 30 dogs. ^ ADJ"
    pairs = [{"name": "pair", "patterns": ["[|DET] [ADJ] [NOUN]"]}]
    assert entities(spark, text, pairs) == [("best friend", "pair"), ("a good cat", "pair")]
    assert entities(spark, text, [pairs[0] | {"mark": [-2, -1]}]) == [("best friend", "pair"), ("good cat", "pair")]
    assert entities(spark, text, pairs, use_pos=False) == []
    # a literal word has no part of speech anywhere
    assert entities(spark, text, [*pairs, {"name": "cat", "patterns": ["cat"]}]) == [("best friend", "pair"), ("cat", "cat")]
    assert entities(spark, text, [{"name": "sum", "patterns": ["MONEY [dogs]"]}]) == [("$ 30 dogs", "sum")]
    assert entities(spark, text, [{"name": "caret", "patterns": ["^^ ^ADJ"]}]) == [("^ ADJ", "caret")]
    assert entities(spark, text, [{"name": "my", "patterns": ["my"]}], match_value=True) == []
    assert entities(spark, text, [{"name": "0", "patterns": ["my"]}]) == []
    for bad in ({"name": "", "patterns": ["a"]}, {"name": "a", "patterns": []}, {"name": "a", "patterns": ["b"], "mark": [2, 1]}):
        with pytest.raises(ValueError):
            P.CustomEntities([bad])


def bags(spark, *texts):
    rows = [(i, t) for i, x in enumerate(texts) for t in x.split()]
    return C.bag(spark.createDataFrame(rows, "doc_id long, term string"))


def test_bm25_model(spark, tmp_path):
    rain = C.Bm25.learn(bags(spark, "rain rain go away"))
    assert {r.term: r.w for r in rain.vector_of("rain is going away".split()).collect()} == {"away": 0.287682, "go": 0.0, "rain": 0.287682}
    model = C.Bm25.learn(bags(spark, "rats are blue", "cats are white", "some rats rats are black"), norm="l2")
    assert {r.term: r.w for r in model.bow_of("rats were blue".split()).collect()} == {"blue": 0.901808, "rats": 0.432138}
    assert {r.term for r in model.bow_of("rats were blue".split(), process_oov=True).collect()} == {"blue", "rats", "were"}
    assert model.bow_of(["unseen"]).count() == 0 and all(r.w == 0 for r in model.vector_of(["unseen"]).collect())
    assert [r.term for r in model.terms().orderBy("position").collect()] == sorted(["rats", "are", "blue", "cats", "white", "some", "black"])
    assert sorted(r.position for r in model.terms().collect()) == list(range(7))
    model.save(f"file://{tmp_path}/model")
    back = C.Bm25.load(spark, f"file://{tmp_path}/model")
    assert sorted(back.vector_of(["rats"]).collect()) == sorted(model.vector_of(["rats"]).collect())
    for bad in ({"k": -1}, {"b": 2}, {"norm": "l3"}, {"precision": 0}):
        with pytest.raises(ValueError):
            C.Bm25.learn(bags(spark, "a"), **bad)


@pytest.fixture(scope="module")
def words(spark):
    rows = [("cat", 0, [1.0, 0.0]), ("dog", 1, [0.9, 0.0]), ("sun", 2, [0.0, 5.0]), ("nil", 3, [0.0, 0.0])]
    return spark.createDataFrame(rows, "word string, word_index int, vec array<double>")


def test_vectors(spark, words):
    asked = spark.createDataFrame([("Cat",), ("moon",), (None,)], "word string")
    assert {r.word: r.vec for r in V.vector_of(asked, words, 2).collect()} == {"Cat": [1.0, 0.0], "moon": [0.0, 0.0], None: [0.0, 0.0]}
    terms = spark.createDataFrame([(1, "cat"), (1, "cat"), (1, "sun"), (1, "nil"), (2, "moon")], "doc_id long, term string")
    got = {r.doc_id: (r.vec, r.l2) for r in V.document_vectors(terms, words, 2, 4).collect()}
    assert got == {1: ([0.6667, 1.6667], 1.7951), 2: ([0.0, 0.0], 0.0)}


def test_contextual_vectors(spark, words):
    terms = spark.createDataFrame([("Cat",), ("moon",), (None,)], "term string")
    listed = lambda **o: [r.word for r in V.contextual_vectors(terms, words, 2, **o).collect()]
    assert listed() == ["cat", "moon"]
    assert listed(specific=("sun", " ")) == ["cat", "sun", "moon"]
    assert listed(similar=True) == ["cat", "dog", "moon"]
    assert listed(limit=3) == ["cat", "dog", "moon"]
    with pytest.raises(ValueError):
        listed(limit=4)


def test_engine(spark):
    df = spark.createDataFrame([(1, "Not good. The cat saw the dog 🌎!"), (2, "")], "doc_id long, text string")
    doc = Engine().read(df)
    only = lambda rows: [tuple(r)[1:] for r in rows.filter("doc_id = 1").collect()]
    tokens = doc.tokens()
    assert only(tokens.length()) == [(10,)]
    assert only(tokens.out(its.value, as_.text)) == [("Not good. The cat saw the dog 🌎!",)]
    found = tokens.filter("type = 'word'").out(its.normal, as_.freq_table).collect()
    assert (found[0].item, found[0].n) == ("the", 2)
    assert [r.item for r in tokens.out(its.normal).filter(F.col("idx") == 1).collect()] == ["good"]
    assert only(tokens.out(its.normal, as_.unique))[0][0][:3] == ["not", "good", "."]
    assert tokens.out(its.value, as_.bigrams).count() == 9
    assert [r.value for r in tokens.item_at(1).collect()] == ["good"]
    assert [(r.value, r.negated, r.sentiment) for r in doc.sentences().rows.orderBy("idx").collect()] == [("Not good.", True, -0.5), ("The cat saw the dog 🌎!", False, 0.0)]
    assert [r.item for r in doc.entities().out(its.detail).collect()] == [("🌎", "EMOJI")]
    bare = Engine(pipe=()).read(df)
    assert bare.sentences().length().collect()[0].length == 1 and bare.entities().rows.count() == 0
    assert {r.pos for r in bare.tokens().rows.collect()} == {"UNK"}
    with pytest.raises(ValueError):
        Engine(("other",))
    with pytest.raises(TypeError):
        Engine().read(spark.createDataFrame([(1, 2)], "doc_id long, text int"))


def test_matcher(spark):
    marked = P.Matcher([("pair", "[a] [b] [c]", (1, 2), {"tag": "X"}), ("0", "[x]"), ("one", ["d"])])
    assert len(marked) == 3
    for matcher in (marked, P.Matcher.from_json(marked.to_json())):
        assert matcher.find(list("abcxd")) == [(1, 2, "pair"), (4, 4, "one")]
        assert matcher.find(list("abcd"), then=lambda a, b, name, held: held and (a, held["tag"])) == [(1, "X")]
    compiled = P.CustomEntities([{"name": "pair", "patterns": ["[|DET] [ADJ] [NOUN]"], "mark": [-2, -1]}, {"name": "x", "patterns": ["cat"]}])
    assert len(compiled) == 2
    again = P.CustomEntities.from_json(compiled.to_json())
    text = "My best friend has a good cat."
    assert entities(spark, text, again) == entities(spark, text, compiled) == [("best friend", "pair"), ("cat", "x")]


def test_match_tags(spark):
    df = spark.createDataFrame([(1, "The good cat. A dog"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in P.match_tags(df, [("phrase", "[DET] [|ADJ] [NOUN]"), ("none", "[OTHER]"), ("0", "[PUNCT]")]).orderBy("first").collect()]
    assert got == [(1, 0, 2, "phrase"), (1, 4, 5, "phrase")]


def test_bm25_document(spark):
    counts = bags(spark, "rats are blue", "cats are white", "some rats rats are black")
    model = C.Bm25.learn(counts, norm="l2")
    assert {r.term: r.w for r in model.document(counts, 0).collect()} == {"are": 0.121858, "blue": 0.895087, "rats": 0.428917}
    assert [r.term for r in model.document(counts, 0, "tf").collect()] == ["blue", "rats", "are"]
    whole = model.document(counts, 0, "vector").collect()
    assert [r.term for r in whole] == sorted(r.term for r in whole) and sum(r.w > 0 for r in whole) == 3 and len(whole) == 7
    with pytest.raises(ValueError):
        model.document(counts, 0, "other")


def test_vector_options(spark, words):
    asked = spark.createDataFrame([("Cat",), ("moon",)], "word string")
    got = {r.word: r.vec for r in V.vector_of(asked, words, 1, unknown=[7.0, 8.0]).collect()}
    assert got == {"Cat": [1.0], "moon": [7.0]}
    assert {r.word: r.vec for r in V.vector_of(asked, words, 1, unknown=[7.0, 8.0], safe=False).collect()} == {"Cat": [1.0, 0.0], "moon": [7.0, 8.0]}


def test_parents(spark):
    df = spark.createDataFrame([(1, "A cat sat. On 5 mats it sat.")], "doc_id long, text string")
    spans = A.sentence_spans(df).withColumnRenamed("sent_idx", "idx")
    found = A.phrase_entities(df)
    assert [(r.value, r.parent) for r in S.parents(found, spans).collect()] == [("5", 1)]
    assert S.parents(spark.createDataFrame([(1, 99)], "doc_id long, first long"), spans).first().parent is None
    tokens = S.tokens_of(A.tokenize(df), spans).filter("span_idx = 0").orderBy("idx").collect()
    assert [r.value for r in tokens] == ["A", "cat", "sat", "."]


def test_engine_more(spark, words, capsys):
    df = spark.createDataFrame([(1, "Cats running. The cat sat.")], "doc_id long, text string")
    engine = Engine(("sbd", "pos"))
    assert engine.pipe_config() == ["sbd", "pos"]
    doc = engine.read(df)
    assert {r.item for r in doc.stems().out(its.stem).collect()} >= {"cat", "run", "sat"}
    assert {r.value: r.vec for r in doc.vectors(words, 2).rows.collect()}["cat"] == [1.0, 0.0]
    doc.print_tokens(2)
    assert "running" in capsys.readouterr().out
    marks = spark.createDataFrame([(1, 0, 4, 4), (1, 1, 2, 3)], "doc_id long, seq int, first int, last int")
    assert [r.item for r in doc.marked_sentences(marks).out(its.marked_up_text).orderBy("idx").collect()] == ["Cats running.", "The <mark>cat</mark> sat."]


def test_streaming(spark, tmp_path):
    from textloom.streaming import annotate as ST

    folder = f"file://{tmp_path}/in"
    stream = lambda: ST.source(spark, folder, "doc_id long, text string, at timestamp", 1)
    rows = [(1, "Not good. A cat", "2024-01-01 00:10:00"), (2, None, "2024-01-01 00:20:00"), (3, "a cat", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    for i in range(2):
        df.filter(F.col("doc_id") % 2 == i).coalesce(1).write.mode("append").parquet(folder)
        ST.write(ST.tokens(stream()), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, A.annotated(df).collect()))
    query = ST.term_counts(stream(), "at").writeStream.outputMode("complete").trigger(availableNow=True).format("memory").queryName("term_counts").start()
    query.awaitTermination()
    assert {(r.start.hour, r.term): r.n for r in spark.table("term_counts").collect()} == {(0, "not"): 1, (0, "good"): 1, (0, "a"): 1, (0, "cat"): 1, (5, "a"): 1, (5, "cat"): 1}


@pytest.mark.parametrize("small", [100, 0])
def test_lexicon(spark, monkeypatch, small):
    monkeypatch.setattr(LX, "SMALL", small)
    tokens = A.tokenize_spaced(spark.createDataFrame([(1, "I'm gonna go. Colour it, Gonna")], "doc_id long, text string"))
    table = spark.createDataFrame([("gonna", [("gon", "going", "go", "VERB"), ("na", "to", "to", "PART")]), ("it", []), (None, None)], f"text string, parts {LX.PART}")
    rows = LX.expand(tokens, table).orderBy("idx", "part").collect()
    assert "".join(r.spaces + r.value for r in rows) == "I'm gonna go. Colour it, gonna"
    assert [(r.value, r.normal, r.pos) for r in rows if r.normal] == [("gon", "going", "VERB"), ("na", "to", "PART")] * 2
    lexemes = spark.createDataFrame([("colour", "color", ["NOUN"], "color", False), ("go", "go", ["VERB", "NOUN"], "go", False), ("it", "it", ["PRON"], "it", True)], "lexeme string, normal string, pos array<string>, lemma string, is_stop boolean")
    got = {r.value: (r.normal, r.lemma, r.pos, r.is_stop, r.is_oov) for r in LX.annotate(tokens, lexemes).collect()}
    assert got["Colour"] == ("color", "color", "PROPN", False, False) and got["it"] == ("it", "it", "PRON", True, False)
    assert got["go"] == ("go", "go", None, False, False) and got["gonna"][3:] == (False, True) and got["."][2] == "PUNCT"
    assert LX.annotate(tokens.filter("false"), lexemes).count() == 0


def test_unknown_pos(spark):
    words = {"running": "VERB", "walked": "VERB", "slowly": "ADV", "drinkable": "ADJ", "happier": "ADJ", "worker": "NOUN", "Hyderabad": "PROPN", "pakistan": "PROPN", "antibody": "ADJ", "crossword": "NOUN", "zzz": "NOUN", "THE": "PROPN", "nation": "NOUN", "été": "PROPN"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.unknown_pos(F.col("w")).alias("pos")).collect()
    assert {r.w: r.pos for r in rows} == words
