"""Symbol resolution, ranked search, files and status."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import NODE_COLUMNS, kind_rank
from ..session import cut_lineage, cut_measured


EDGE_FIELDS = ("source", "target", "kind", "line", "col", "provenance")


def latest(table: DataFrame, key: str, at: str, columns: Iterable[str]) -> DataFrame:
    """One row per key: the one with the greatest ``at`` (ties: the greatest values of the columns asked for, in their order).

    Only the key and these columns are read and shuffled.  Rows without a key are dropped, extra columns too.
    """
    rest = [c for c in columns if c != key]
    newest = F.max(F.struct(F.col(at).alias("_at"), *rest)).alias("n")
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[f"n.{c}" for c in rest])


def latest_where(table: DataFrame, key: str, at: str, columns: Iterable[str], wanted: Column) -> DataFrame:
    """The rows of :func:`latest` that are wanted.

    The filter reaches the scan: it finds the keys of which any row is wanted, and only all rows of these keys are compared.
    """
    keys = cut_measured(table.where(wanted & F.col(key).isNotNull()).select(key).distinct())
    return latest(table.join(keys.side(), key, "left_semi"), key, at, columns).where(wanted)


def latest_of(table: DataFrame, key: str, at: str, columns: Iterable[str], keys: DataFrame) -> DataFrame:
    """The rows of :func:`latest` of the given keys."""
    written = cut_measured(keys.select(key).distinct())
    return latest(table.join(written.side(), key, "left_semi"), key, at, columns)


def settled(table: DataFrame, key: str, at: str, columns: Iterable[str]) -> DataFrame:
    """The rows of :func:`latest`, for many scans of one table: what repeated keys come to is written once; the rows of all other
    keys, nearly the whole table, are read where they lie, with filters and columns pushed to their scan."""
    columns = list(columns)
    rows = table.where(F.col(key).isNotNull())
    side = cut_measured(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)).side()
    again = cut_lineage(latest(rows.join(side, key, "left_semi"), key, at, columns))
    return rows.join(side, key, "left_anti").select(*again.columns).unionByName(again)


def current_nodes(nodes: DataFrame, columns: Iterable[str] = NODE_COLUMNS) -> DataFrame:
    """One row per id: the greatest ``updated_at``."""
    return latest(nodes, "id", "updated_at", columns)


def matches_symbol(symbol: str) -> Column:
    """The qualified name as written, or the name in any case."""
    return (F.col("qualified_name") == symbol) | (F.col("name") == symbol) | (F.lower("name") == symbol.lower())


def symbol_tier(symbol: str) -> Column:
    return F.when(F.col("qualified_name") == symbol, 0).when(F.col("name") == symbol, 1).otherwise(2)


def search_tier(query: str) -> Column:
    """Exact, exact in any case, prefix of the name, part of the qualified name, other; ``%`` and ``_`` of the query act as wildcards in the two pattern tiers."""
    return (
        F.when(F.col("name") == query, 0)
        .when(F.lower("name") == query.lower(), 1)
        .when(F.ilike(F.col("name"), F.lit(query + "%")), 2)
        .when(F.ilike(F.col("qualified_name"), F.lit("%" + query + "%")), 3)
        .otherwise(4)
    )


def by_rank(tier: Column) -> list[Column]:
    """A total order: tier, kind, exported first, path, line, id."""
    return [tier.asc(), kind_rank().asc(), F.coalesce("is_exported", F.lit(0)).desc(), F.col("file_path").asc_nulls_first(), F.col("start_line").asc_nulls_first(), F.col("id").asc()]


def resolve_symbol(nodes: DataFrame, symbol: str, limit: int) -> DataFrame:
    """The best ``limit`` nodes for a symbol; the first is the subject.  No match gives no row."""
    return nodes.where(matches_symbol(symbol)).orderBy(*by_rank(symbol_tier(symbol))).limit(limit)


def is_match(query: str, kind: str | None = None, language: str | None = None, full_text: bool = True) -> Column:
    """Part of the name or qualified name, or a phrase with an open end in id, names or documentation."""
    q = query.lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("qualified_name"), F.lit(q))
    if full_text:
        for c in ("id", "name", "qualified_name", "docstring", "signature"):
            hit = hit | F.coalesce(text.phrase_prefix(F.col(c), query), F.lit(False))
    hit = hit & (F.col("kind") == kind) if kind is not None else hit
    return hit & (F.col("language") == language) if language is not None else hit


def search_matches(nodes: DataFrame, query: str, kind: str | None = None, language: str | None = None, full_text: bool = True) -> DataFrame:
    """All nodes that match."""
    return nodes.where(is_match(query, kind, language, full_text))


def search(nodes: DataFrame, query: str, limit: int, kind: str | None = None, language: str | None = None, full_text: bool = True) -> DataFrame:
    """The best ``limit`` matches in order, as one TakeOrderedAndProject."""
    return search_matches(nodes, query, kind, language, full_text).orderBy(*by_rank(search_tier(query))).limit(limit)


def list_files(files: DataFrame, folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """The files below a folder and of a glob; the newest row of each path.  Both only look at the path and reach the scan."""
    found = latest(files, "path", "indexed_at", ("content_hash", "language", "size", "modified_at", "node_count", "indexed_at")).drop("content_hash")
    found = found.select("path", "language", "size", "modified_at", "indexed_at", "node_count")
    found = found.where(text.subtree(F.col("path"), folder)) if folder is not None else found
    return found.where(F.col("path").rlike(text.glob(pattern))) if pattern is not None else found


def status(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts and when the graph was last indexed (0 and none mean NULL)."""
    f = list_files(files).agg(F.count("*").alias("file_count"), F.nullif(F.max("indexed_at"), F.lit(0)).alias("indexed_at"))
    n, e = nodes.agg(F.count_distinct("id").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    one = F.lit(1).alias("one")
    joined = f.select("*", one).join(n.select("*", one), "one").join(e.select("*", one), "one")
    return joined.select("file_count", "node_count", "edge_count", "indexed_at")


def language_histogram(files: DataFrame) -> DataFrame:
    return list_files(files).groupBy("language").agg(F.count("*").alias("file_count"))


def stale_files(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed files that are gone or newer in ``live (path, modified_at)``."""
    on_disk = live.select("path", F.col("modified_at").alias("live_at"))
    return indexed.join(on_disk, "path", "left").where("live_at IS NULL OR live_at > modified_at").select("path")


def stale_count(files: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """Stale files among the first ``most`` by path, and whether there are more files."""
    probe = list_files(files).orderBy("path").limit(most + 1)
    checked = probe.orderBy("path").limit(most)
    n = stale_files(checked, live).agg(F.count("*").alias("stale_file_count"), F.lit(1).alias("one"))
    more = probe.agg((F.count("*") > most).alias("truncated"), F.lit(1).alias("one"))
    return n.join(more, "one").drop("one")


def current_edges(edges: DataFrame, columns: Iterable[str] = EDGE_FIELDS) -> DataFrame:
    """One row per edge id: the latest recorded one."""
    return latest(edges, "id", "recorded_at", columns)


def most_called(edges: DataFrame, nodes: DataFrame) -> str | None:
    """The node with the most call edges into it (ties: the least id); one value.  ``nodes`` may repeat an id."""
    called = edges.where("kind = 'calls'").groupBy("target").agg(F.count("*").alias("n"))
    top = called.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").orderBy(F.col("n").desc(), "target").first()
    return top["target"] if top else None


def commonest_name(nodes: DataFrame) -> str | None:
    """The name that most functions and methods have (ties: the least); one value."""
    top = nodes.where("kind IN ('function', 'method')").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").first()
    return top["name"] if top else None
