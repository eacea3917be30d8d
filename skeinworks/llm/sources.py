"""Reading the tables that the operators of this package work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a table made on the driver may have to be broadcast.
BROADCAST_ROWS = 100_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of parameters: broadcast up to a checked number of rows, beyond it an ordinary side of a join."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def repository(path: Column) -> Column:
    """The first segment of a path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def current_files(files: DataFrame, *extra: str) -> DataFrame:
    """One row per path: the row with the greatest ``indexed_at`` (ties: greatest hash).  NULL paths are dropped."""
    picked = ["language", "content_hash", *extra]
    newest = F.max_by(F.struct(*picked), F.struct("indexed_at", "content_hash")).alias("f")
    return files.where("path IS NOT NULL").groupBy("path").agg(newest).select("path", *[f"f.{c}" for c in picked])


def files_with_text(files: DataFrame, source_texts: DataFrame, *extra: str) -> DataFrame:
    """``path, language, text`` and the extra columns of each current file; text is NULL where none is stored."""
    # the join's own partitioning, asked for: else a join with few files could leave all texts to the scan's few tasks
    texts = source_texts.where("path IS NOT NULL").select("path", "text").repartition("path")
    return current_files(files, *extra).join(texts, "path", "left").drop("content_hash")
