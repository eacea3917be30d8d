"""Change events: scope, debounced batches and the rebuild that follows them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import GraphError
from ..sources import gitignore
from ..sources.tree import EXCLUDED_FOLDERS

EVENT_SCHEMA = "root string, path string, event_type string, ts timestamp"


def in_scope(events: DataFrame, rules: list[gitignore.Rule], excluded: tuple[str, ...] = EXCLUDED_FOLDERS, path: str = "path") -> DataFrame:
    """The events of paths that a walk would keep: every folder above is tested like in a walk."""
    p = F.col(path)
    return events.where(p.isNotNull() & ~gitignore.excluded_by_name(p, excluded) & ~gitignore.ignored(p, rules))


def sessions(events: DataFrame, gap: str, root: str = "root", path: str = "path", ts: str = "ts") -> DataFrame:
    """Bursts of events of a root that are at most ``gap`` apart: start, end (last event plus gap), events, distinct paths.

    Works on batches and, with a watermark, on streams.  Events without a time are left out.
    """
    window = F.session_window(F.col(ts), gap)
    g = events.where(F.col(ts).isNotNull()).groupBy(F.col(root), window.alias("w")).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(path)).alias("paths"))
    return g.select(root, F.col("w.start").alias("started_at"), F.col("w.end").alias("flushed_at"), "n_events", "paths")


@dataclass
class Health:
    """Permanent degradation after a fatal condition or three failures in a row; a success resets the count."""

    most: int = 3
    failures: int = 0
    degraded: str | None = None

    def failed(self, reason: str, fatal: bool = False) -> bool:
        """Whether this failure degraded the watch; told once."""
        self.failures += 1
        if self.degraded is None and (fatal or self.failures >= self.most):
            self.degraded = reason
            return True
        return False

    def succeeded(self) -> None:
        self.failures = 0


def watch(events: DataFrame, gap: str, lateness: str, checkpoint: str, sync: Callable[[DataFrame], None], health: Health) -> StreamingQuery:
    """Runs ``sync`` on each micro-batch of finished bursts.  Micro-batches are sequential, so no two syncs overlap.

    A failed batch is counted and stops the query, so that its offsets are not committed: its paths come again with the retry
    of the batch after a restart.  Once degraded, no batch is taken any more, and none is lost.
    """

    def batch(df: DataFrame, _: int) -> None:
        if health.degraded:
            raise GraphError("UNAVAILABLE", f"the watch is degraded: {health.degraded}")
        if df.isEmpty():
            return
        try:
            sync(df)
        except Exception as e:
            health.failed(str(e))
            raise
        health.succeeded()

    found = sessions(events.withWatermark("ts", lateness), gap)
    return found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def watch_allowed(env: dict[str, str], config_on: bool, on_slow_mount: bool, prefix: str = "SKEINWORKS") -> bool:
    """Kill switch in the environment, then configuration, then force in the environment, then slow mounts."""
    if env.get(f"{prefix}_NO_WATCH"):
        return False
    if not config_on:
        return False
    return bool(env.get(f"{prefix}_FORCE_WATCH")) or not on_slow_mount
