"""Impact and trace: bounded breadth-first walks as a loop of joins.

A level is one join of the frontier with the edges, one aggregate that keeps
the first edge into each node, and one anti-join with what was seen.  The edges
are read where they lie, by each level's scan; only what a level found is
written, to the checkpoint folder, so plans stay shallow and executors may be
lost.  Frontiers and what was seen are broadcast as long as their measured size
is small, and joined by a shuffle beyond it.  All results stay distributed; the
driver learns only sizes, and whether the goal was reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_measured, join_side


def _usable(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    e = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("id").alias("edge_id"), "source", "target", "kind")
    return e.where(F.col("kind").isin(*kinds)) if kinds else e


def walk(edges: DataFrame, origins: DataFrame, depth: int, incoming: bool, kinds: list[str] | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """``id, distance, via, edge_id`` of every node within ``depth``, origins (``id``) included with distance 0, and whether
    the budget of nodes ran out.  Each node has its least distance and the kind of the first edge (least edge id) that
    reached it.  A budget is filled level by level, in the order of those edges; origins count."""
    seen, exhausted, _ = _walk(_usable(edges, kinds), origins, depth, incoming, budget)
    return seen, exhausted


def _walk(e: DataFrame, origins: DataFrame, depth: int, incoming: bool, budget: int | None, goal: str | None = None) -> tuple[DataFrame, bool, int | None]:
    """As :func:`walk`; ends with the level that reaches ``goal`` and tells its distance."""
    near, far = ("target", "source") if incoming else ("source", "target")
    last = cut_measured(origins.where("id IS NOT NULL").select("id").distinct().selectExpr("id", "0 AS distance", "CAST(NULL AS STRING) AS via", "CAST(NULL AS BIGINT) AS edge_id"))
    seen, total, size, exhausted = last.df, last.rows, last.size, False
    left = None if budget is None else budget - last.rows
    reached = {} if goal is None else {"goal": F.count_if(F.col("id") == goal)}
    for level in range(1, depth + 1):
        found = _step(e, last.side(last.df.select(F.col("id").alias(near))), near, far, join_side(seen.select("id"), total, size))
        if left is not None and left <= 0:
            exhausted = not found.isEmpty()
            break
        new = found.select("id", F.lit(level).alias("distance"), "via", "edge_id")
        last = cut_measured(new if left is None else new.orderBy("edge_id", "id").limit(left + 1), **reached)
        if left is not None and last.rows > left:
            exhausted, last = True, cut_measured(last.df.orderBy("edge_id", "id").limit(left), **reached)
        if not last.rows:
            break
        left = None if left is None else left - last.rows
        seen, total, size = seen.unionByName(last.df), total + last.rows, size + last.size
        if last.counted.get("goal"):
            return seen, exhausted, level
        if exhausted:
            break
    return seen, exhausted, None


def _step(e: DataFrame, frontier: DataFrame, near: str, far: str, seen: DataFrame) -> DataFrame:
    hit = e.join(frontier, near, "left_semi").groupBy(F.col(far).alias("id")).agg(F.min_by("kind", "edge_id").alias("via"), F.min("edge_id").alias("edge_id"))
    return hit.join(seen, "id", "left_anti")


def impact(edges: DataFrame, origins: DataFrame, depth: int, kinds: list[str] | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """What a change of the origins may reach: nodes with a path to an origin, nearest first; the origins are not listed."""
    seen, exhausted = walk(edges, origins, depth, True, kinds, budget)
    return seen.where("distance > 0").select("id", "distance", "via"), exhausted


def trace(edges: DataFrame, nodes: DataFrame, start: str, goal: str, max_depth: int, max_paths: int, budget: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """``path_no, hops``: at most ``max_paths`` shortest directed paths in the order of their edges.

    ``hops`` is an array of (node, edge, kind); the first has no edge.  Start and goal alike give one path without edges;
    of parallel edges the one with the least id stands for all; paths through ids without a node are dropped.
    """
    spark = edges.sparkSession
    schema = "path_no INT, hops ARRAY<STRUCT<node: STRING, edge_id: BIGINT, kind: STRING>>"
    if max_paths < 1 or start is None or goal is None:
        return spark.createDataFrame([], schema)
    if start == goal:
        return spark.createDataFrame([(1, [(start, None, None)])], schema)
    origin = spark.range(1).select(F.lit(start).alias("id"))
    e = _usable(edges, kinds)
    seen, _, length = _walk(e, origin, max_depth, False, budget, goal)
    if length is None:
        return spark.createDataFrame([], schema)
    all_seen = cut_measured(seen.select("id", "distance"))
    near = all_seen.side(all_seen.df.select(F.col("id").alias("source"), F.col("distance").alias("d")))
    after = all_seen.side(all_seen.df.select(F.col("id").alias("target"), F.col("distance").alias("d2")))
    between = e.join(near, "source").join(after, "target").where("d2 = d + 1")
    # parallel edges meet only after the layers have filtered them
    layered = cut_lineage(between.groupBy("source", "target", "d").agg(F.min("edge_id").alias("edge_id"), F.min_by("kind", "edge_id").alias("kind")))
    # backwards from the goal: only edges on a shortest path stay
    useful, at = [], spark.range(1).select(F.lit(goal).alias("target"))
    for level in range(length - 1, -1, -1):
        part = cut_lineage(layered.where(F.col("d") == level).join(at, "target", "left_semi"))
        useful.append(part)
        at = part.select(F.col("source").alias("target")).distinct()
    known = nodes.select("id").distinct()
    first = F.array(F.struct(F.lit(start).alias("node"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("string").alias("kind")))
    paths = spark.range(1).select(F.lit(start).alias("at")).withColumn("hops", first).withColumn("ids", F.array().cast("array<bigint>"))
    for part in reversed(useful):
        grown = paths.join(part.withColumnRenamed("source", "at"), "at")
        hop = F.array(F.struct(F.col("target").alias("node"), "edge_id", "kind"))
        paths = grown.select(F.col("target").alias("at"), F.concat("hops", hop).alias("hops"), F.concat("ids", F.array("edge_id")).alias("ids"))
        paths = paths.orderBy("ids").limit(max_paths)  # the best paths extend best prefixes
    paths = cut_lineage(paths)
    ends = paths.select("ids", "hops", F.explode("hops.node").alias("id")).join(known, "id", "left")
    kept = paths.join(ends.join(known, "id", "left_anti").select("ids").distinct(), "ids", "left_anti")
    numbered = kept.withColumn("path_no", F.expr("row_number() OVER (ORDER BY ids)"))  # at most max_paths rows
    return numbered.select("path_no", "hops")
