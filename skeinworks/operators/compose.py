"""Explore and context: searches grouped by file, with source slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import STRUCTURAL_KINDS, kind_rank
from .relations import with_far_node


def drop_structural(df: DataFrame) -> DataFrame:
    return df.where(~F.col("kind").isin(*STRUCTURAL_KINDS))


def group_by_file(ranked: DataFrame, most_files: int) -> DataFrame:
    """``file_path, file_rank, span_start, span_end, symbols``: files in the order of their best symbol (column ``rank``), at
    most ``most_files``; the span runs from the first start to the last end, symbols in rank order."""
    g = ranked.groupBy("file_path").agg(F.min("rank").alias("best"), F.min("start_line").alias("span_start"), F.max("end_line").alias("span_end"), F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("s"))
    first = g.orderBy("best").limit(most_files)
    order = Window.partitionBy(F.lit(0)).orderBy("best")  # at most most_files rows
    return first.select("file_path", F.row_number().over(order).alias("file_rank"), "span_start", "span_end", F.array_join("s.name", ",").alias("symbols"))


def span_per_file(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind <> 'file'").groupBy("file_path").agg(F.count("*").alias("n"), F.min("start_line").alias("span_start"), F.max("end_line").alias("span_end"))


def slice_lines(body: Column, start: Column, end: Column, max_lines: int | None, max_chars: int | None) -> tuple[Column, Column, Column]:
    """``code, first line, truncated`` of lines start..end: first the lines are capped, then the characters; None is no cap.
    NULL text gives NULL code and is not truncated."""
    lines = F.split(body, "\n")
    first = F.greatest(F.lit(1), start)
    last = F.least(F.size(lines), F.greatest(first, end))
    count = F.greatest(F.lit(0), last - first + 1)
    cut = F.array_join(F.slice(lines, first, count if max_lines is None else F.least(count, F.lit(max_lines))), "\n")
    beyond_lines = F.lit(False) if max_lines is None else count > max_lines
    beyond_chars = F.lit(False) if max_chars is None else F.length(cut) > max_chars
    return cut if max_chars is None else F.left(cut, F.lit(max_chars)), first, F.coalesce(beyond_lines | beyond_chars, F.lit(False))


def source_slices(spans: DataFrame, source_texts: DataFrame, max_lines: int | None, max_chars: int | None) -> DataFrame:
    """Adds ``code, code_start_line, truncated`` to rows with ``file_path, span_start, span_end``."""
    joined = spans.join(source_texts.select(F.col("path").alias("file_path"), F.col("text").alias("_text")), "file_path", "left")
    code, first, truncated = slice_lines(F.col("_text"), F.col("span_start"), F.col("span_end"), max_lines, max_chars)
    return joined.withColumn("code", code).withColumn("code_start_line", first).withColumn("truncated", truncated).drop("_text")


def term_hits(nodes: DataFrame, terms: DataFrame, per_term: int) -> DataFrame:
    """``term, id, pos``: for every term the best ``per_term`` nodes whose name or qualified name contains it, ranked as in
    search; structural kinds are dropped after the limit.  ``terms (term)`` is a request's short list."""
    wanted = [r["term"] for r in terms.select("term").distinct().orderBy("term").collect()]
    hits = F.filter(F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>"), lambda t: F.contains(F.lower("qualified_name"), F.lower(t)) | F.contains(F.lower("name"), F.lower(t)))
    n = nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "is_exported", F.explode(hits).alias("term"))
    q, low = F.col("term"), F.lower("term")
    tier = F.when(F.col("name") == q, 0).when(F.lower("name") == low, 1).when(F.startswith(F.lower("name"), low), 2).when(F.contains(F.lower("qualified_name"), low), 3).otherwise(4)
    order = [tier, kind_rank(), F.coalesce("is_exported", F.lit(0)).desc(), F.col("file_path"), F.col("start_line"), F.col("id")]
    ranked = n.withColumn("pos", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("pos") <= per_term)
    return drop_structural(ranked).select("term", "id", "pos")


def merge_hits(hits: DataFrame) -> DataFrame:
    """``id, hits, best``: nodes by how many different terms found them and their best position."""
    return hits.groupBy("id").agg(F.count_distinct("term").alias("hits"), F.min("pos").alias("best"))


def related(entries: DataFrame, edges: DataFrame, nodes: DataFrame, per_entry: int, limit: int) -> DataFrame:
    """``seen, far, kind, site_count, line`` and the far node: callers, then callees, of each entry (``id, rank``; a few rows), at
    most ``per_entry`` of each, every (path, line, qualified name, kind) where it is seen first, at most ``limit`` in all."""
    calls, sides = edges.where("kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL"), []
    for side, (near, far) in enumerate((("target", "source"), ("source", "target"))):
        mine = calls.join(entries.select(F.col("id").alias(near), "rank"), near)
        order = F.struct(F.col("line").isNull().alias("a"), F.col("line").alias("b"), F.col("id").alias("c"))
        groups = mine.groupBy("rank", F.col(far).alias("far"), "kind").agg(F.count("*").alias("site_count"), F.min_by("line", order).alias("line"))
        found = with_far_node(groups, nodes)
        first = Window.partitionBy("rank").orderBy(F.col("far_path").asc_nulls_first(), F.col("line").asc_nulls_first(), F.col("far_line").asc_nulls_first(), "far", "kind")
        sides.append(found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= per_entry).withColumn("side", F.lit(side)))
    both = sides[0].unionByName(sides[1])
    again = F.row_number().over(Window.partitionBy("far_path", "far_line", "far_qualified_name", "kind").orderBy("rank", "side", "at"))
    kept = both.withColumn("again", again).where("again = 1").orderBy("rank", "side", "at").limit(limit)
    order = Window.partitionBy(F.lit(0)).orderBy("rank", "side", "at")  # at most limit rows
    return kept.withColumn("seen", F.row_number().over(order)).select("seen", "far", "kind", "site_count", "line", "far_name", "far_qualified_name", "far_kind", "far_path", "far_line")


def context_entries(nodes: DataFrame, tasks: DataFrame, most_terms: int, per_term: int, limit: int) -> DataFrame:
    terms = text.terms(tasks, "task_id", "task", most_terms)
    merged = merge_hits(term_hits(nodes, terms, per_term))
    return merged.orderBy(F.col("hits").desc(), "best", "id").limit(limit)
