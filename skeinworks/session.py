"""Session settings the operators rely on."""

from __future__ import annotations

import pathlib
import re
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import GraphError


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.  Where none is named, a session of one machine, as
    in tests, takes a folder of its own; a cluster gets an error, as no machine's folder is shared."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise GraphError("UNAVAILABLE", "spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: Rows and bytes up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 * 1024 * 1024


@dataclass
class Written:
    """A table that was written to the checkpoint folder, and what was counted on the way."""

    df: DataFrame
    rows: int
    size: int  # bytes of the values
    counted: dict[str, int]

    def side(self, columns: DataFrame | None = None) -> DataFrame:
        """The table, or some columns of it, as a side of a join: broadcast where the table is small, else as it is."""
        return join_side(self.df if columns is None else columns, self.rows, self.size)


def cut_measured(df: DataFrame, **more: Column) -> Written:
    """As :func:`cut_lineage`; rows, bytes and the caller's own aggregates are observed by the job that writes the table."""
    checkpoint_folder(df.sparkSession)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(8))
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("_size"), *[c.alias(name) for name, c in more.items()]).checkpoint()
    counted = dict(seen.get)
    return Written(out, counted.pop("_rows"), counted.pop("_size"), counted)


def join_side(df: DataFrame, rows: int, size: int) -> DataFrame:
    """A measured table as a side of a join: broadcast where it is small, else as it is, so that both sides are shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


#: Rows and bytes of one batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 32 * 1024 * 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; they reach Python in batches of bounded size, on workers that have this package.  Always the same values,
    so it does not matter which of several plans was built last."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder: later uses read them, and a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="package-")) / f"{folder.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(folder.rglob("*.py")):
            z.write(file, file.relative_to(folder.parent))
    context.addPyFile(str(archive))  # Spark serves it to the executors
    _SHIPPED.add(context.applicationId)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with work for every core: tables in few large files would keep most of them idle in a slow step.

    Only for scans -- the number of a shuffle's partitions is not known before it runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)
