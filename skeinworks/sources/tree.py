"""Reading a source tree: listing, exclusion, content and hashes.

Spark lists and reads the files; the driver only holds the compiled rules.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import language_of
from . import gitignore

# Folders that a walk leaves out.
EXCLUDED_FOLDERS = (".git", "node_modules", "dist", "build", "coverage", ".cache", "vendor", "target", "__pycache__")


def available(root: str) -> bool:
    """Whether a folder can be read; never fails."""
    try:
        return os.path.isdir(root)
    except (OSError, ValueError):
        return False


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified_at`` (path below the root, epoch milliseconds) of every regular file, without reading content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").load(root)
    base = "file:" + os.path.realpath(root).rstrip("/") if "://" not in root else root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    return raw.select(F.substr(path, F.lit(len(base) + 2)).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), "content")


def discover(listed: DataFrame, rules: list[gitignore.Rule], excluded: tuple[str, ...] = EXCLUDED_FOLDERS, languages: list[str] | None = None, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The files a walk keeps -- of a known and enabled language, not excluded, not ignored, and where a caller sets
    ``max_files`` only the first so many by path -- and one row with how many were beyond that."""
    path = F.col("path")
    kept = listed.withColumn("language", language_of(path)).where("language IS NOT NULL")
    kept = kept.where(~gitignore.excluded_by_name(path, excluded) & ~gitignore.ignored(path, rules))
    kept = kept.where(F.col("language").isin(*languages)) if languages is not None else kept
    if max_files is None:
        return kept, listed.sparkSession.createDataFrame([(0,)], "overflow long")
    count = kept.agg(F.greatest(F.count("*") - max_files, F.lit(0)).alias("overflow"))
    # paths are chosen before any content is read: a sort of whole files would move them all
    chosen = kept.select("path").orderBy("path").limit(max_files)
    return kept.join(chosen, "path", "left_semi"), count


def file_text(content: Column) -> Column:
    """UTF-8 with replacement of bad bytes."""
    return F.make_valid_utf8(content.cast("string"))


def read_files(found: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, language, size, modified_at, text, content_hash, line_count`` of the files, where a caller sets ``max_bytes``
    only of those up to it, and one row with how many were larger."""
    text = file_text(F.col("content"))
    kept = found if max_bytes is None else found.where(F.col("size") <= max_bytes)
    skipped = found.sparkSession.createDataFrame([(0,)], "skipped long") if max_bytes is None else found.agg(F.count_if(F.col("size") > max_bytes).alias("skipped"))
    small = kept.select("path", "language", "size", "modified_at", text.alias("text"))
    return small.withColumn("content_hash", F.sha2("text", 256)).withColumn("line_count", F.size(F.split("text", "\n"))), skipped


def changed_files(read: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is new: only these are parsed again; resolution always sees the whole workspace."""
    return read.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


