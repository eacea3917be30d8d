"""Changes of a source tree as a stream: each micro-batch compares the tree's listing with the one before.

A Python data source.  An offset is the listing's number, and what changed up to
it is kept until the engine has committed it, so a batch that is run again gives
the same rows.  The listing holds a path and a time per file of one watched
workspace; large collections are not watched but indexed.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .tree import EXCLUDED_FOLDERS

SCHEMA = "root string, path string, event_type string, ts timestamp"


def scan(root: str, excluded: tuple[str, ...] = EXCLUDED_FOLDERS) -> dict[str, int]:
    """Path below the root and time in nanoseconds of every file outside the excluded folders; vanishing files are left out."""
    found = {}
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in excluded)
        for name in names:
            full = os.path.join(folder, name)
            try:
                found[os.path.relpath(full, root).replace(os.sep, "/")] = os.stat(full).st_mtime_ns
            except OSError:
                continue
    return found


def compare(before: dict[str, int], after: dict[str, int]) -> list[tuple[str, str]]:
    """``(path, event type)`` of what was created, changed or deleted, by path."""
    kinds = {p: "create" for p in after.keys() - before.keys()} | {p: "delete" for p in before.keys() - after.keys()} | {p: "change" for p in after.keys() & before.keys() if after[p] != before[p]}
    return sorted(kinds.items())


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.number, self.listing = 0, scan(root)
        self.kept: dict[int, list[tuple]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"number": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        after = scan(self.root)
        found = compare(self.listing, after)
        if not found:
            return iter([]), start
        now = datetime.datetime.now()
        self.listing, self.number = after, max(self.number, start["number"]) + 1
        self.kept[self.number] = [(self.root, path, kind, now) for path, kind in found]
        return iter(self.kept[self.number]), {"number": self.number}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([row for n in range(start["number"] + 1, end["number"] + 1) for row in self.kept.get(n, [])])

    def commit(self, end: dict) -> None:
        self.kept = {n: rows for n, rows in self.kept.items() if n > end["number"]}


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options["path"])


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The changes of a tree from now on, as a stream of ``root, path, event_type, ts``."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").load(root)
