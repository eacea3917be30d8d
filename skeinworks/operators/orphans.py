"""Problem 3: references to records that do not exist.

Keys are cut into ranges by a hash, so that each range holds a bounded number
of distinct keys.  Within a range the keys are dictionary-encoded as integers;
for every (table, field, period) the referenced codes form a compressed bitmap
-- a sorted array of 16-bit codes where few are set, a bit set where many are --
and so do the codes of the parents.  ``reference AND NOT parent`` leaves the
orphans, whose surviving bits are decoded through the range's dictionary.

Before they reach a range, references are combined to one row per (key, table,
field, period) on the map side, so a key with a third of all rows is one row
per task.  The rows behind an orphan are found by an ordinary join.  What it
finds is dealt out by row before it is aggregated: without an exchange of its own
the aggregate would hold each key's rows together, and the adaptive planner could
not split the join where a key is hot.  Nor could it behind an aggregate of the
orphan keys, so these reach the join as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, cut_measured

#: Distinct (key, table, field, period) rows of a range, on average.
RANGE_ROWS = 32_768
#: A container of a bitmap spans so many codes; up to so many set codes stay an array.
SPAN, ARRAY_MOST = 65_536, 4_096
SCHEMA = "key string, ref_table string, field string, period string, n long"


def compress(codes: np.ndarray) -> list[np.ndarray]:
    """Containers of a sorted array of distinct codes: 16-bit arrays, or packed bits where they are smaller."""
    out = []
    for high in range(int(codes[-1]) // SPAN + 1 if len(codes) else 0):
        low = codes[np.searchsorted(codes, high * SPAN) : np.searchsorted(codes, (high + 1) * SPAN)] - high * SPAN
        if len(low) <= ARRAY_MOST:
            out.append(low.astype(np.uint16))
        else:
            bits = np.zeros(SPAN, bool)
            bits[low] = True
            out.append(np.packbits(bits))
    return out


def _bits(container: np.ndarray) -> np.ndarray:
    return np.unpackbits(container).astype(bool)


def and_not(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The codes of ``left AND NOT right``, sorted."""
    out = []
    for high, a in enumerate(left):
        b = right[high] if high < len(right) else np.zeros(0, np.uint16)
        if a.dtype == np.uint16 and b.dtype == np.uint16:
            rest = np.setdiff1d(a, b, assume_unique=True)
        elif a.dtype == np.uint16:
            rest = a[~_bits(b)[a]]
        elif b.dtype == np.uint16:
            bits = _bits(a)
            bits[b] = False
            rest = np.flatnonzero(bits)
        else:
            rest = np.flatnonzero(np.unpackbits(a & ~b))
        out.append(rest.astype(np.int64) + high * SPAN)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _encode(column: pa.ChunkedArray) -> pa.DictionaryArray:
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.dictionary_encode(null_encoding="encode")


def _surviving(rows: pa.Table) -> pa.Table:
    """One range of keys: the references whose key no parent has."""
    keys = _encode(rows["key"])
    codes = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parent = rows["is_parent"].to_numpy(zero_copy_only=False)
    parents = compress(np.unique(codes[parent]))
    name = np.zeros(len(codes), np.int64)
    for x in map(_encode, (rows["ref_table"], rows["field"], rows["period"])):
        name = name * (len(x.dictionary) + 1) + x.indices.to_numpy(zero_copy_only=False)
    found = [np.zeros(0, np.int64)]
    for one in np.unique(name[~parent]):
        mine = np.flatnonzero((name == one) & ~parent)
        order = np.argsort(codes[mine], kind="stable")
        mine = mine[order]
        left = and_not(compress(codes[mine]), parents)  # (key, table, field, period) is unique
        if len(left):
            found.append(mine[np.searchsorted(codes[mine], left)])
    return rows.select(["key", "ref_table", "field", "period", "n"]).take(pa.array(np.concatenate(found)))


def _usable(key: Column) -> Column:
    return key.isNotNull() & key.rlike(r"[^\s\u00a0\u3000]")


def _newest_runs(files: DataFrame) -> DataFrame:
    return files.where("path IS NOT NULL").groupBy(F.col("path").alias("file_path")).agg(F.max("indexed_at").alias("indexed_at"))


def references(edges: DataFrame, unresolved_refs: DataFrame, files: DataFrame) -> DataFrame:
    """``ref_table, row_id, field, key, period, at``: every reference that is neither NULL nor blank.

    ``at`` is ``recorded_at``, or the newest ``indexed_at`` of the reference's
    file, in epoch milliseconds, and ``period`` its month; NULL where there is none.
    """
    month = lambda t: F.date_format(t, "yyyy-MM")
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in ("source", "target")]))
    of_edges = edges.select(F.lit("edges").alias("ref_table"), F.col("id").cast("long").alias("row_id"), month("recorded_at").alias("period"), F.unix_millis(F.col("recorded_at").cast("timestamp")).alias("at"), sides.alias("s")).select("ref_table", "row_id", "s.field", "s.key", "period", "at")
    indexed = _newest_runs(files)
    refs = unresolved_refs.select("id", "source", "file_path").where(_usable(F.col("source"))).join(indexed, "file_path", "left")
    of_refs = refs.select(F.lit("unresolved_refs").alias("ref_table"), F.col("id").cast("long").alias("row_id"), F.lit("source").alias("field"), F.col("source").alias("key"), month(F.timestamp_millis("indexed_at")).alias("period"), F.col("indexed_at").alias("at"))
    return of_edges.where(_usable(F.col("key"))).unionByName(of_refs)


def orphan_keys(refs: DataFrame, nodes: DataFrame, expected_rows: int) -> DataFrame:
    """``key, ref_table, field, period, n``: keys that no ``nodes.id`` equals, with how many stored rows refer to them."""
    ranges = max(1, -(-expected_rows // RANGE_ROWS))
    combined = refs.groupBy("key", "ref_table", "field", "period").agg(F.count("*").alias("n"), F.lit(False).alias("is_parent"))
    parents = nodes.where("id IS NOT NULL").select(F.col("id").alias("key")).distinct().selectExpr("key", "CAST(NULL AS STRING) AS ref_table", "CAST(NULL AS STRING) AS field", "CAST(NULL AS STRING) AS period", "0L AS n", "true AS is_parent")
    ranged = combined.unionByName(parents).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    return bounded_batches(ranged).groupBy("range").applyInArrow(_surviving, SCHEMA)


def dangling_references(edges: DataFrame, unresolved_refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``ref_table, row_id, field, key, period`` of the dangling references; a repeated row is one case.

    A row repeated with another ``recorded_at`` keeps its earliest period.
    """
    refs = references(edges, unresolved_refs, files)
    keys = orphan_keys(refs, nodes, 2 * edges.count() + unresolved_refs.count() + nodes.count()).select("key")  # a semi-join needs no distinct keys
    found = refs.join(keys, "key", "left_semi").repartition("row_id", "field")
    return found.groupBy("ref_table", "row_id", "field", "key").agg(F.min("period").alias("period"))


def dangling_report(edges: DataFrame, unresolved_refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``ref_table, period, n_references, n_keys``: dangling references, as stored, and different dangling keys per table and month."""
    refs = references(edges, unresolved_refs, files)
    keys = orphan_keys(refs, nodes, 2 * edges.count() + unresolved_refs.count() + nodes.count())
    by_key = keys.groupBy("ref_table", "period", "key").agg(F.sum("n").alias("n"))
    return by_key.groupBy("ref_table", "period").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_keys"))


def late_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``key, since``: ids that are held only by rows with an ``updated_at`` after the newest run of their file, with the first of
    these times.  A row without a time or without a run of its file counts as held."""
    held = F.coalesce(F.col("updated_at") <= F.col("indexed_at"), F.lit(True))
    rows = nodes.where("id IS NOT NULL").select("id", "file_path", "updated_at").join(_newest_runs(files), "file_path", "left")
    return rows.groupBy(F.col("id").alias("key")).agg(F.bool_or(held).alias("held"), F.min("updated_at").alias("since")).where("NOT held").select("key", "since")


def dangling_periods(edges: DataFrame, unresolved_refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``ref_table, period, n_missing, n_missing_keys, n_later, n_later_keys``: references, as stored, and different keys per table
    and month, to ids that no node has, and to ids that a node has only from a later run.

    A node is of a later run if it came after the newest run of its file and
    after the reference; a reference without a time counts as before it.  Times
    are compared exactly, as a node and a reference may share their month.
    """
    missing = dangling_report(edges, unresolved_refs, nodes, files).select("ref_table", "period", F.col("n_references").alias("n_missing"), F.col("n_keys").alias("n_missing_keys"), F.lit(0).cast("long").alias("n_later"), F.lit(0).cast("long").alias("n_later_keys"))
    late_keys = cut_measured(late_nodes(nodes, files)).side()
    refs = references(edges, unresolved_refs, files).join(late_keys, "key").where("at IS NULL OR at < since").repartition("row_id", "field")
    later = refs.groupBy("ref_table", "period", "key").agg(F.count("*").alias("n")).groupBy("ref_table", "period").agg(F.sum("n").alias("n_later"), F.count("*").alias("n_later_keys"))
    both = missing.unionByName(later.withColumns({"n_missing": F.lit(0).cast("long"), "n_missing_keys": F.lit(0).cast("long")}))
    return both.groupBy("ref_table", "period").agg(*[F.sum(x).alias(x) for x in ("n_missing", "n_missing_keys", "n_later", "n_later_keys")])
