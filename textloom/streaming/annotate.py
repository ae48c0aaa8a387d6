"""Structured Streaming: new files of texts become tokens, and counts by hour, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import annotate as A


def source(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_at_once: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def tokens(stream: DataFrame, *carry: str) -> DataFrame:
    """annotated() of a stream: each text is annotated by itself, so that no state is kept."""
    return A.annotated(stream, *carry)


def term_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, term, n): words by the window of a time column; rows that are later than ``late`` are left out."""
    rows = stream.withWatermark(time, late).select(time, F.explode(A.T.tokens(F.col("text"))).alias("value"))
    rows = rows.filter(F.col("value").rlike(r"[\p{L}]")).groupBy(F.window(time, window).alias("w"), F.lower("value").alias("term"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "term", "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts writing what has arrived as Parquet, and ends when that is done; started again, it goes on from there."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
