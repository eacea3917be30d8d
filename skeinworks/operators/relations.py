"""Callers, callees and all other relations of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _site() -> tuple[Column, Column]:
    site = F.struct("line", "col", "provenance", F.col("id").alias("edge_id"))
    return site, F.struct(F.col("line").isNull().alias("a"), F.col("line").alias("b"), F.col("id").alias("c"))


def grouped(edges: DataFrame, anchor: Column | str, incoming: bool, kind: str | None = None) -> DataFrame:
    """``far, kind, site_count, line, col, provenance, edge_id``: one row per far node and edge kind of an anchor node, with
    its earliest site (lines before none, then the smaller edge id).  Without an anchor: of all, with column ``near``."""
    near, far = ("target", "source") if incoming else ("source", "target")
    e = edges.where(F.col(near).isNotNull() & F.col(far).isNotNull())
    if anchor is not None:
        e = e.where(F.col(near) == anchor)
    e = e.where(F.col("kind") == kind) if kind is not None else e
    site, order = _site()
    g = e.groupBy(F.col(near).alias("near"), F.col(far).alias("far"), "kind").agg(F.count("*").alias("site_count"), F.min_by(site, order).alias("s"))
    return g.select("near", "far", "kind", "site_count", "s.line", "s.col", "s.provenance", "s.edge_id")


def with_far_node(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the far node; far ids without a node drop out here, though they count in the total."""
    n = nodes.select(F.col("id").alias("far"), F.col("name").alias("far_name"), F.col("qualified_name").alias("far_qualified_name"), F.col("kind").alias("far_kind"), F.col("file_path").alias("far_path"), F.col("start_line").alias("far_line"))
    return groups.join(n, "far")


def relations(edges: DataFrame, nodes: DataFrame, anchor: str, incoming: bool, kind: str | None, limit: int) -> DataFrame:
    found = with_far_node(grouped(edges, anchor, incoming, kind), nodes)
    return found.orderBy(F.col("far_path").asc_nulls_first(), F.col("line").asc_nulls_first(), F.col("far_line").asc_nulls_first(), "far", "kind").limit(limit)


def totals(edges: DataFrame, nodes: DataFrame, incoming: bool, kind: str | None) -> DataFrame:
    """``near, total, rendered``: per anchor, groups counted without and with a far node."""
    near, far = ("target", "source") if incoming else ("source", "target")
    e = edges.where(F.col(near).isNotNull() & F.col(far).isNotNull())
    e = e.where(F.col("kind") == kind) if kind is not None else e
    g = e.select(F.col(near).alias("near"), F.col(far).alias("far"), "kind").distinct()
    known = nodes.select(F.col("id").alias("far"), F.lit(1).alias("known"))
    return g.join(known, "far", "left").groupBy("near").agg(F.count("*").alias("total"), F.count("known").alias("rendered"))


def call_sites(edges: DataFrame, nodes: DataFrame, incoming: bool) -> DataFrame:
    """The callers (or callees) of every node at once: call edges grouped per pair, far nodes joined."""
    return with_far_node(grouped(edges, None, incoming, "calls"), nodes)
