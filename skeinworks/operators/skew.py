"""Problem 2: per-key results when a few keys hold most rows.

Every aggregate here is algebraic, so Spark's hash aggregation combines rows on
the map side: a task's bounded hash table keeps one mergeable state per key and
spills when it is full, and only these compact states are shuffled.  Distinct
sources are counted in two such steps -- states per (key, source) first, spread
by all columns, then states per key -- so that no task ever receives the rows
of a hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_profile(edges: DataFrame) -> DataFrame:
    """``target, kind, n_sites, n_sources, first_line, first_col, first_edge`` of every (target, kind) group.

    Rows count as stored, repeated ones too.  NULL and blank keys form groups of
    their own.  The earliest site has the least line, then column, then edge id,
    with NULLs last; a group without any line has NULL.  NULL sources are not
    counted as a source, blank ones are.
    """
    site = F.struct(F.col("line").isNull().alias("no_line"), "line", F.col("col").isNull().alias("no_col"), "col", F.col("id").isNull().alias("no_id"), "id")
    by_source = edges.groupBy("target", "kind", "source").agg(F.count("*").alias("n"), F.min(site).alias("site"))
    by_key = by_source.groupBy("target", "kind").agg(F.sum("n").alias("n_sites"), F.count("source").alias("n_sources"), F.min("site").alias("site"))
    return by_key.select("target", "kind", "n_sites", "n_sources", F.col("site.line").alias("first_line"), F.col("site.col").alias("first_col"), F.col("site.id").alias("first_edge"))


def hot_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """``target, kind, n_sites`` of the groups that hold at least ``share`` of all rows, without NULL and blank targets.

    A plain count: each task's hash table keeps one number per group, and only these numbers are shuffled.  The total is the
    table's own row count.
    """
    total = edges.count()
    named = F.col("target").rlike(r"[^\s\u00a0\u3000]")  # neither NULL nor blank
    counts = edges.where(named).groupBy("target", "kind").agg(F.count("*").alias("n_sites"))
    return counts.where(F.col("n_sites") >= math.ceil(total * share - 1e-6))
