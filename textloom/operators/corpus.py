"""Corpus operators: BM25 weights, and similarity of bags, sets and vectors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bag(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf)."""
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(counts: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens of each document of (doc_id, term, tf)."""
    return counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def _shape(counts: DataFrame) -> Column:
    """How many documents there are, and their mean length: one value, found in the job that uses it."""
    return lengths(counts).agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("mean")).alias("shape")).scalar()


def bm25_idf(counts: DataFrame, n_docs: int | None = None, k: float = 1.0, precision: int = 6) -> DataFrame:
    """(term, idf) from (doc_id, term, tf), of ``n_docs`` documents or else of those that have a term."""
    size = F.lit(float(n_docs)) if n_docs is not None else _shape(counts)["n"]
    rows = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("term", F.round(F.log((size - F.col("n") + 0.5) / (F.col("n") + 0.5) + F.lit(float(k))), precision).alias("idf"))


def bm25_weights(counts: DataFrame, k: float = 1.0, k1: float = 1.2, b: float = 0.75, norm: str = "none", precision: int = 6) -> DataFrame:
    """(doc_id, term, w). Raises for a norm other than none, l1 and l2; an empty bag gives an empty result.

    Lengths and norms are windows over documents: counts that are dealt out by doc_id, as of ``dealt``, stay where
    they are.
    """
    if norm not in ("none", "l1", "l2"):
        raise ValueError(f"norm {norm}")
    own = Window.partitionBy("doc_id")
    mean = F.coalesce(F.nullif(_shape(counts)["mean"], F.lit(0.0)), F.lit(1.0))
    rows = counts.withColumn("dl", F.sum("tf").over(own)).join(bm25_idf(counts, None, k, precision), "term")
    bound = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * F.col("dl") / mean) + F.col("tf")
    rows = rows.withColumn("w", F.col("idf") * F.lit(k1 + 1.0) * F.col("tf") / bound)
    size = {"none": F.lit(1.0), "l1": F.sum(F.abs("w")).over(own), "l2": F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))}[norm]
    return rows.select("doc_id", "term", F.round(F.col("w") / F.when(size == 0, 1.0).otherwise(size), precision).alias("w"))


def dealt(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf) of the words of df's texts, dealt out by doc_id: tokens are found once, and move once, as one
    row a document, however many times a plan reads the counts."""
    from textloom.functions import text as T

    rows = df.select(F.col(key).alias("doc_id"), T.tokens(F.col(text)).alias("own")).repartition("doc_id").select("doc_id", F.explode("own").alias("value"))
    return rows.filter(F.col("value").rlike(r"[\p{L}]")).groupBy("doc_id", F.lower("value").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Bm25:
    """What a corpus taught: (term, idf), the number of documents and their mean length; and the settings of weights."""

    idf: DataFrame
    n_docs: int
    mean_length: float
    k: float = 1.0
    k1: float = 1.2
    b: float = 0.75
    norm: str = "none"
    precision: int = 6

    @classmethod
    def learn(cls, counts: DataFrame, k: float = 1.0, k1: float = 1.2, b: float = 0.75, norm: str = "none", precision: int = 6) -> Bm25:
        """From (doc_id, term, tf). Raises for settings out of bounds: 0 <= k, k1 <= 100, 0 <= b <= 1, 1 <= precision <= 12."""
        if norm not in ("none", "l1", "l2") or not (0 <= k <= 100 and 0 <= k1 <= 100 and 0 <= b <= 1 and 1 <= precision <= 12):
            raise ValueError("settings out of bounds")
        shape = counts.groupBy("doc_id").agg(F.sum("tf").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        return cls(bm25_idf(counts, shape.n, k, precision), shape.n, float(shape.mean or 0.0), k, k1, b, norm, precision)

    def terms(self) -> DataFrame:
        """(term, position) in ascending order; terms are numbered within their first two letters, so not in one task."""
        rows = self.idf.select("term", F.substring("term", 1, 2).alias("head"))
        # one row for each pair of letters
        starts = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
        starts = starts.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("start"))
        place = F.row_number().over(Window.partitionBy("head").orderBy("term")) - 1
        return rows.withColumn("place", place).join(starts, "head").select("term", (F.col("start") + F.col("place")).alias("position"))

    def _weights(self, tokens: list[str], keep_unknown: bool) -> DataFrame:
        spark = self.idf.sparkSession
        query = spark.createDataFrame(list(Counter(tokens).items()), "term string, tf long")
        bound = self.k1 * (1 - self.b + self.b * len(tokens) / (self.mean_length or 1.0))
        known = self.idf if keep_unknown else self.idf.filter("idf <> 0")
        rows = F.broadcast(query).join(known, "term", "inner") if not keep_unknown else query.join(known, "term", "left")
        rows = rows.withColumn("w", F.coalesce(F.nullif("idf", F.lit(0.0)), F.lit(1.0)) * F.lit(self.k1 + 1.0) * F.col("tf") / (F.lit(float(bound)) + F.col("tf")))
        # as many rows as the query has terms
        own = Window.partitionBy()
        size = {"none": F.lit(1.0), "l1": F.sum(F.abs("w")).over(own), "l2": F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))}[self.norm]
        return rows.select("term", F.round(F.col("w") / F.when(size == 0, 1.0).otherwise(size), self.precision).alias("w"))

    def bow_of(self, tokens: list[str], process_oov: bool = False) -> DataFrame:
        """(term, w) of a list of tokens; unknown terms, and terms of no weight, are left out, or else weigh as of idf 1."""
        return self._weights(tokens, process_oov)

    def vector_of(self, tokens: list[str]) -> DataFrame:
        """(term, w) for every term of the corpus, 0 where the tokens lack it."""
        return self.idf.select("term").join(F.broadcast(self._weights(tokens, False)), "term", "left").select("term", F.coalesce("w", F.lit(0.0)).alias("w"))

    def document(self, counts: DataFrame, doc_id: int, what: str = "bow") -> DataFrame:
        """A document of the corpus's (doc_id, term, tf) by its weights: ``bow`` (term, w), ``tf`` the same with the
        heaviest terms first, ``vector`` (term, w) of every term in ascending order, 0 where the document lacks it."""
        if what not in ("bow", "tf", "vector"):
            raise ValueError(f"what {what}")
        own = bm25_weights(counts, self.k, self.k1, self.b, self.norm, self.precision).filter(F.col("doc_id") == doc_id).select("term", "w")
        if what == "tf":
            return own.orderBy(F.desc("w"), "term")
        return own if what == "bow" else self.idf.select("term").join(own, "term", "left").select("term", F.coalesce("w", F.lit(0.0)).alias("w")).orderBy("term")

    def save(self, path: str) -> None:
        self.idf.write.parquet(f"{path}/idf")
        settings = (self.n_docs, self.mean_length, float(self.k), float(self.k1), float(self.b), self.norm, self.precision)
        self.idf.sparkSession.createDataFrame([settings], "n_docs long, mean_length double, k double, k1 double, b double, norm string, precision int").write.json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25:
        x = spark.read.schema("n_docs long, mean_length double, k double, k1 double, b double, norm string, precision int").json(f"{path}/settings").first()
        return cls(spark.read.parquet(f"{path}/idf").select("term", "idf"), *x)


def doc_term_matrix(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, positions, weights): each document's row of the matrix, sparse, in ascending positions."""
    rows = weights.join(terms, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "w"))).alias("cells"))
    return rows.select("doc_id", F.col("cells.position").alias("positions"), F.col("cells.w").alias("weights"))


def bow_cosine(pairs: DataFrame, bags: DataFrame, precision: int = 6) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) by bags (key, term, tf): 1 if both are empty, 0 if one is."""
    left = pairs.join(bags.select(F.col("key").alias("a"), "term", F.col("tf").alias("x")), "a", "left")
    right = bags.select(F.col("key").alias("b"), "term", F.col("tf").alias("y"))
    dot = left.join(right, ["b", "term"], "left").groupBy("a", "b").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("dot"))
    size = bags.groupBy("key").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("size"))
    rows = dot.join(size.select(F.col("key").alias("a"), F.col("size").alias("s")), "a", "left").join(size.select(F.col("key").alias("b"), F.col("size").alias("t")), "b", "left")
    return rows.select("a", "b", F.when(F.col("s").isNull() & F.col("t").isNull(), 1.0).when(F.col("s").isNull() | F.col("t").isNull(), 0.0).otherwise(F.round(F.col("dot") / (F.col("s") * F.col("t")), precision)).alias("similarity"))


def tversky(a: Column, b: Column, alpha: float = 0.5, beta: float = 0.5, precision: int = 6) -> Column:
    """Of two arrays as sets; 1 if both are empty, 0 if one is."""
    if alpha < 0 or beta < 0:
        raise ValueError("alpha and beta must not be negative")
    both, left, right = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    rest = both + F.lit(float(alpha)) * (left - both) + F.lit(float(beta)) * (right - both)
    return F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0).otherwise(F.round(both / F.nullif(rest, F.lit(0.0)), precision))


def otsuka_ochiai(a: Column, b: Column, precision: int = 6) -> Column:
    both, left, right = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((left == 0) & (right == 0), 1.0).when((left == 0) | (right == 0), 0.0).otherwise(F.round(both / F.sqrt((left * right).cast("double")), precision))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_cosine(a: Column, b: Column, precision: int = 6) -> Column:
    """Null if either has no length."""
    return F.round(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), precision)


def mean_vector(df: DataFrame, key: str, vector: str, precision: int = 6) -> DataFrame:
    """(key, mean): the mean of each component; vectors are summed where they lie, and one a key and task is dealt out."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.filter(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("mean"))
    return rows.select(key, F.transform(vector_to_array("mean"), lambda x: F.round(x, precision)).alias("mean"))


def nearest_mean(df: DataFrame, key: str, label: str, vector: str, most: int = 10_000, precision: int = 4) -> DataFrame:
    """(key, near, similarity): of each vector the label whose mean vector has the greatest cosine, the least of equals.

    The means are one value that goes to all tasks; more than ``most`` labels are an error when the rows are read.
    """
    means = mean_vector(df, label, vector).agg(F.collect_list(F.struct(F.col(label).alias("label"), "mean")).alias("means")).scalar()
    held = F.when(F.size(means) <= most, means).otherwise(F.raise_error(F.lit(f"more than {most} labels")).cast("array<struct<label:int,mean:array<double>>>"))
    rows = df.select(key, vector, held.alias("_means"))
    best = F.array_min(F.transform("_means", lambda m: F.struct((-vector_cosine(F.col(vector), m["mean"], precision)).alias("d"), m["label"].alias("near"))))
    return rows.select(key, best.alias("x")).select(key, "x.near", (-F.col("x.d")).alias("similarity"))
