"""Reading graphs stored in SQLite files, as a Python data source: each task reads a range of row ids, read-only."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The columns of a stored graph.
COLUMNS = {
    "nodes": "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string, is_exported int, is_async int, is_static int, is_abstract int, decorators string, type_parameters string, updated_at bigint",
    "edges": "id bigint, source string, target string, kind string, metadata string, line int, col int, provenance string",
    "files": "path string, content_hash string, language string, size bigint, modified_at bigint, indexed_at bigint, node_count int, errors string",
    "unresolved_refs": "id bigint, source string, file_path string, callee_name string, line int, col int",
    "schema_versions": "version int, applied_at bigint, description string",
}
ROWS_PER_TASK = 100_000


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class GraphReader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        return [RowRange(k, min(k + ROWS_PER_TASK, high + 1)) for k in range(low, high + 1, ROWS_PER_TASK)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = [x.split()[0] for x in COLUMNS[self.table].split(", ")]
        integers = [x.split()[1] in ("int", "bigint") for x in COLUMNS[self.table].split(", ")]
        c = self._connect()
        try:
            for row in c.execute(f"SELECT {', '.join(names)} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                for name, value, number in zip(names, row, integers, strict=True):
                    if value is not None and (number and not (isinstance(value, (int, float)) and value == int(value)) or not number and not isinstance(value, str)):
                        raise ValueError(f"MALFORMED_INDEX: {self.table}.{name} holds {type(value).__name__}")
                yield tuple(int(v) if n and v is not None else v for v, n in zip(row, integers, strict=True))
        finally:
            c.close()


class SqliteGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_graph"

    def schema(self) -> str:
        return COLUMNS[self.options["table"]]

    def reader(self, schema: object) -> DataSourceReader:
        return GraphReader(self.options["path"], self.options["table"])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteGraph)
    return spark.read.format("sqlite_graph").option("table", table).load(path)
