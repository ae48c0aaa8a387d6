"""Reading tables and storing annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder; only the columns and rows a query needs are read."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: A table of at most so many bytes a core is dealt to all cores before its texts are worked on.
SPREAD = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt evenly to all cores; a larger one as it is read.

    A small table is often one row group, which one task reads, however many splits its file has. Only what is read of
    it is moved. Tables beyond SPREAD bytes a core have row groups enough, and moving them would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD * cores else df


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of text files, one document a file; doc_id is a hash of the file's name."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a model or annotations as parquet or json, replacing nothing."""
    df.write.format(kind).save(path)
