"""Stored graphs: immutable versioned folders of Parquet, and a table of the versions.

A writer fills a new version's folder and then appends one row to the table of
versions; readers take the newest row, so they see the old graph or the new one,
never half of one.  All of it is DataFrame writes and reads and works on any file
system that Spark knows.  Edges are stored in two layouts, sorted by source and
by target, so that a lookup from either side reads few row groups; nodes are
sorted by name.  Rows are checked and repeated ids settled once, when they are written.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..model import FORMAT_VERSION, GraphError
from ..operators import ranking

VERSIONS = "versions"
# Columns that every row must have, with their types.
REQUIRED = {
    "nodes": {"id": "string", "kind": "string", "name": "string", "qualified_name": "string", "file_path": "string", "language": "string", "start_line": "int", "end_line": "int", "start_column": "int", "end_column": "int"},
    "edges": {"id": "bigint", "source": "string", "target": "string", "kind": "string"},
    "files": {"path": "string", "language": "string", "size": "bigint", "modified_at": "bigint", "indexed_at": "bigint"},
    "unresolved_refs": {"source": "string", "callee_name": "string"},
    "schema_versions": {"version": "int"},
}
_NEWEST = {"nodes": ("id", "updated_at"), "edges": ("id", "recorded_at"), "files": ("path", "indexed_at")}


def checked(name: str, df: DataFrame) -> DataFrame:
    """The rows of a stored table; fails where a required column is missing or of another type, and on any row without its value."""
    types = dict(df.dtypes)
    for column, wanted in REQUIRED.get(name, {}).items():
        if types.get(column) != wanted:
            raise GraphError("MALFORMED_INDEX", f"{name}.{column} is {types.get(column, 'missing')}, expected {wanted}")
    return arrays.validated(df, list(REQUIRED.get(name, {})))


def _settled(name: str, df: DataFrame) -> DataFrame:
    """One row per id: the newest, where the table knows times."""
    key, at = _NEWEST.get(name, (None, None))
    if key is None:
        return df
    return ranking.latest(df, key, at, df.columns) if at in df.columns else df.dropDuplicates([key])


def write(root: str, tables: dict[str, DataFrame]) -> str:
    """Writes a whole graph as a new version and makes it the current one; on failure the old one stays current."""
    version = f"v={uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    versions = tables.get("schema_versions", spark.range(1).select(F.lit(FORMAT_VERSION).alias("version"), F.unix_millis(F.current_timestamp()).alias("applied_at"), F.lit(None).cast("string").alias("description")))
    written = []
    for name, df in {**tables, "schema_versions": versions}.items():
        df = checked(name, _settled(name, df))
        layouts = {name: df}
        if name == "edges":
            layouts = {f"{name}_by_target" if by == "target" else name: df.repartitionByRange(by).sortWithinPartitions(by) for by in ("target", "source")}
        elif name == "nodes":
            layouts = {name: df.repartitionByRange(F.lower("name")).sortWithinPartitions(F.lower("name"))}
        for layout, rows in layouts.items():
            rows.write.parquet(f"{root}/{version}/{layout}")
            written.append(layout)
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written_at"), F.array(*map(F.lit, written)).alias("tables"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/{VERSIONS}")
    return version


def current(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """The newest version and its tables."""
    try:
        newest = spark.read.parquet(f"{root}/{VERSIONS}").agg(F.max_by(F.struct("version", "tables"), F.struct("written_at", "version")).alias("v")).first()["v"]
    except AnalysisException as e:
        raise GraphError("UNAVAILABLE", f"no graph at {root}") from e
    if newest is None:
        raise GraphError("UNAVAILABLE", f"no graph at {root}")
    return newest["version"], list(newest["tables"])


@dataclass
class Snapshot:
    version: str
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def read(spark: SparkSession, root: str) -> Snapshot:
    """Opens the current version; refuses graphs without a format version, of another one, or with columns of other types.
    Rows were checked when they were written, so filters still reach the scan."""
    version, names = current(spark, root)
    tables = {x: spark.read.parquet(f"{root}/{version}/{x}") for x in names}
    for name, df in tables.items():
        checked(name, df)
    versions = tables["schema_versions"].agg(F.max("version")).first()[0]
    if versions is None:
        raise GraphError("MALFORMED_INDEX", "no format version is recorded")
    if versions != FORMAT_VERSION:
        raise GraphError("UNSUPPORTED_FORMAT", f"format {versions}, expected {FORMAT_VERSION}")
    return Snapshot(version, tables)


class Pool:
    """The last ``capacity`` graphs in use; reopened when a newer version was written, served on when it is missing for a moment."""

    def __init__(self, spark: SparkSession, capacity: int = 4) -> None:
        self.spark, self.capacity, self.open, self.closed = spark, capacity, OrderedDict(), False

    def get(self, root: str) -> Snapshot:
        if self.closed:
            raise GraphError("DISPOSED", "the pool is closed")
        known = self.open.get(root)
        try:
            version, _ = current(self.spark, root)
        except GraphError:
            if known is None:
                raise
            version = known.version
        if known is None or known.version != version:
            known = read(self.spark, root)
        self.open[root] = known
        self.open.move_to_end(root)
        while len(self.open) > self.capacity:
            self.open.popitem(last=False)
        return known

    def close(self) -> None:
        self.open.clear()
        self.closed = True
