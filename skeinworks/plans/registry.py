"""Registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans, skew
from . import build, graph, stored
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.hot_keys(table(spark, folder, "edges")).select("target", "kind")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return skew.key_profile(table(spark, folder, "edges"))


def _graph(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, x) for x in ("edges", "unresolved_refs", "nodes", "files")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.dangling_references(*_graph(spark, folder)).select("ref_table", "row_id", "field")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.dangling_report(*_graph(spark, folder))


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.dangling_periods(*_graph(spark, folder))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_report, p3_periods, *graph.QUERIES, *build.QUERIES, *stored.QUERIES)}
