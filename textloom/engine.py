"""The fluent way in: an engine annotates a table, its collections filter, count and reduce.

    doc = Engine().read(df)
    doc.tokens().filter(F.col("type") == "word").out(its.normal, as_.freq_table)

A collection is a DataFrame of items with doc_id and their index; each verb only adds to its plan.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions import text as T
from textloom.operators import annotate as A

PIPE = ("sbd", "negation", "sentiment", "pos", "ner")

#: Properties of items: name -> expression of an item's columns.
its = SimpleNamespace(
    value=lambda: F.col("value"),
    normal=lambda: T.normal_of(F.col("value")),
    case=lambda: T.case_of(F.col("value")),
    shape=lambda: T.shape_of(F.col("value")),
    prefix=lambda: T.prefix_of(F.col("value")),
    suffix=lambda: T.suffix_of(F.col("value")),
    type=lambda: F.col("type"),
    pos=lambda: F.col("pos"),
    lemma=lambda: A.lemma_of(F.col("value")),
    preceding_spaces=lambda: F.col("spaces"),
    stop_word_flag=lambda: T.normal_of(F.col("value")).isin(*L.STOP_WORDS),
    abbrev_flag=lambda: T.is_abbreviation(F.col("value")),
    negation_flag=lambda: F.col("negated"),
    contraction_flag=lambda: F.lower("value").isin(*L.NORMALS),
    unique_id=lambda: F.xxhash64("value"),
    sentiment=lambda: F.col("sentiment"),
    span=lambda: F.array("first", "last"),
    detail=lambda: F.struct("value", "type"),
    stem=lambda: F.col("stem"),
    vector=lambda: F.col("vec"),
    marked_up_text=lambda: F.col("marked"),
)


def _ordered(rows: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("item")))), lambda x: x["item"])


def _freq_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_id", F.desc("n"), "item")


def _bigrams(rows: DataFrame) -> DataFrame:
    after = F.lead("item").over(A.by_doc())
    return rows.select("doc_id", "idx", F.col("item").alias("a"), after.alias("b")).filter("b is not null")


def _text(rows: DataFrame) -> DataFrame:
    spaced = rows.withColumn("item", F.concat("spaces", "item"))
    return spaced.groupBy("doc_id").agg(A.trimmed(F.array_join(_ordered(spaced), "")).alias("text"))


#: Reducers: rows (doc_id, idx, item) -> a DataFrame.
as_ = SimpleNamespace(
    array=lambda rows: rows.groupBy("doc_id").agg(_ordered(rows).alias("items")),
    set=lambda rows: rows.groupBy("doc_id").agg(F.collect_set("item").alias("items")),
    unique=lambda rows: rows.groupBy("doc_id").agg(F.array_distinct(_ordered(rows)).alias("items")),
    bow=lambda rows: rows.groupBy("doc_id", F.col("item").cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n")),
    freq_table=_freq_table,
    bigrams=_bigrams,
    text=_text,
)


class Collection:
    """Items of documents, and the verbs on them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def filter(self, test: Column | str) -> Collection:
        return Collection(self.rows.filter(test))

    def item_at(self, k: int) -> DataFrame:
        """Each document's k-th item of the collection, from 0; a document that has fewer gives no row."""
        return self.rows.withColumn("_at", F.row_number().over(A.by_doc())).filter(F.col("_at") == k + 1).drop("_at")

    def length(self) -> DataFrame:
        return self.rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("length"))

    def each(self, f) -> None:
        """Calls f with every row, where the rows are."""
        self.rows.foreach(f)

    def out(self, it=its.value, as_to=None) -> DataFrame:
        """(doc_id, idx, item), or what a reducer makes of it."""
        rows = self.rows.withColumn("item", it()).select("doc_id", "idx", "item", *(["spaces"] if "spaces" in self.rows.columns else []))
        return as_to(rows) if as_to else rows.select("doc_id", "idx", "item")


class Document:
    """A table's annotations. What the pipe leaves out keeps a default: one sentence, no negation, score 0, tag UNK."""

    def __init__(self, df: DataFrame, pipe: tuple[str, ...]):
        self.df, self.pipe = df, pipe

    def _annotated(self) -> DataFrame:
        rows = A.typed(A.tokenize_spaced(self.df))
        rows = A.sentences(rows) if "sbd" in self.pipe else rows.withColumn("sent_idx", F.lit(0).cast("long"))
        rows = A.negation(rows) if "negation" in self.pipe else rows.withColumn("negated", F.lit(False))
        return A.contextual_pos(rows) if "pos" in self.pipe else rows.withColumn("pos", F.lit("UNK"))

    def tokens(self) -> Collection:
        return Collection(self._annotated())

    def print_tokens(self, n: int = 20) -> None:
        """Prints the first tokens with what is known of them."""
        rows = self.tokens().rows.orderBy("doc_id", "idx")
        rows.select("doc_id", "idx", "value", "type", T.normal_of(F.col("value")).alias("normal"), "pos", "negated", F.length("spaces").alias("spaces")).show(n, truncate=False)

    def stems(self) -> Collection:
        """Tokens with a stem, found once for each distinct value."""
        from textloom.functions.stem import stems

        rows = self.tokens().rows
        known = stems(rows.select(F.col("value").alias("term")).distinct()).withColumnRenamed("term", "value")
        return Collection(rows.join(known, "value"))

    def vectors(self, vectors: DataFrame, dims: int, **options) -> Collection:
        """Tokens with their word's vector; options as of operators.vectors.vector_of."""
        from textloom.operators.vectors import vector_of

        rows = self.tokens().rows
        known = vector_of(rows.select(F.col("value").alias("word")).distinct(), vectors, dims, **options)
        return Collection(rows.join(known.withColumnRenamed("word", "value"), "value"))

    def marked_sentences(self, markings: DataFrame) -> Collection:
        """Sentences with their part of the marked text, as marked."""
        from textloom.operators.spans import sentence_markup

        return Collection(sentence_markup(self.df, markings).withColumn("idx", F.col("sent_idx")))

    def sentences(self) -> Collection:
        rows = self._annotated()
        score = A.score_of(F.col("value")) if "sentiment" in self.pipe else F.lit(None).cast("double")
        signed = F.when(F.col("negated"), -score).otherwise(score)
        ordered = F.array_sort(F.collect_list(F.struct("idx", F.concat("spaces", "value").alias("s"))))
        spans = rows.groupBy("doc_id", F.col("sent_idx").alias("idx")).agg(
            F.min("idx").alias("first"),
            F.max("idx").alias("last"),
            F.max("negated").alias("negated"),
            F.coalesce(F.sum(signed) / F.nullif(F.count(score), F.lit(0)), F.lit(0.0)).alias("sentiment"),
            A.trimmed(F.array_join(ordered["s"], "")).alias("value"),
        )
        return Collection(spans)

    def entities(self) -> Collection:
        """Phrases by several tokens' hints, and tokens that are an entity by their type."""
        if "ner" not in self.pipe:
            return Collection(A.phrase_entities(self.df.limit(0)).withColumnsRenamed({"entity": "type"}).withColumn("idx", F.col("first")))
        alone = A.typed(A.tokenize(self.df)).filter(F.col("type").isin("email", "url", "mention", "hashtag", "emoji", "emoticon"))
        alone = alone.select("doc_id", F.col("idx").cast("long").alias("first"), F.col("idx").cast("long").alias("last"), "value", F.upper("type").alias("type"))
        rows = A.phrase_entities(self.df).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "value", F.col("entity").alias("type")).unionByName(alone)
        from pyspark.sql import Window

        return Collection(rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1))

    def custom_entities(self, examples: list[dict], **options) -> Collection:
        from textloom.operators.patterns import custom_entities

        rows = custom_entities(self.df, examples, **options)
        return Collection(rows.select("doc_id", F.col("first").alias("idx"), "first", "last", "value", F.col("name").alias("type")))


class Engine:
    """Which annotators run: a subset of sbd, negation, sentiment, pos and ner; all by default. Others raise."""

    def __init__(self, pipe: tuple[str, ...] = PIPE):
        unknown = [x for x in pipe if x not in PIPE]
        if unknown:
            raise ValueError(f"pipe {unknown}")
        self.pipe = tuple(pipe)

    def pipe_config(self) -> list[str]:
        """A copy of the pipe."""
        return list(self.pipe)

    def read(self, df: DataFrame) -> Document:
        """df has doc_id and text, a string."""
        if dict(df.dtypes).get("text") != "string":
            raise TypeError("text must be a string")
        return Document(df, self.pipe)
