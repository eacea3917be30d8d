"""Registered queries that resolve a stored graph again: imports, open references, bases, and the report of an indexing run.

The stored graph keeps which file imports which, not the statement.  The statement is derived: a specifier that climbs from
the importing file to the root and down to the imported one, without its suffix, and what it binds -- under the importing
file's open call names in order, the imported file's first name; under that name its default; and the whole module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import flag
from ..operators import ranking, resolution
from ..session import cut_lineage
from .graph import edges, files, nodes
from .tables import table


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    n = nodes(spark, folder, ("kind", "name", "file_path", "language", "is_exported")).where("kind <> 'file'")
    return n.withColumn("is_exported", flag("is_exported"))


def _file_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``path, target, k``: which file imports which other, numbered by the target within a file."""
    e = edges(spark, folder, ("source", "target", "kind")).where("kind = 'imports' AND startswith(target, 'file:')")
    path = F.regexp_replace(F.regexp_replace("source", "^file:", ""), r":\d+:\d+$", "")
    pairs = e.select(path.alias("path"), F.substr("target", F.lit(6)).alias("target")).where("path <> target").distinct()
    known = files(spark, folder).select("path")
    pairs = pairs.join(known, "path", "left_semi").join(known.withColumnRenamed("path", "target"), "target", "left_semi")
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("target")))


def imports_of(spark: SparkSession, folder: str) -> DataFrame:
    """``path, ord, local_name, imported_name, specifier`` of the derived statements."""
    called = table(spark, folder, "unresolved_refs").where("callee_name IS NOT NULL").select(F.col("file_path").alias("path"), "callee_name").distinct()
    called = called.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("callee_name")))
    first = _declared(spark, folder).groupBy(F.col("file_path").alias("target")).agg(F.min("name").alias("first"))
    p = _file_pairs(spark, folder).join(first, "target").join(called, ["path", "k"], "left")
    p = p.join(files(spark, folder).select("path", "language"), "path")
    depth = F.size(F.split("path", "/")) - 1
    stem = F.regexp_replace("target", r"\.[^./]*$", "")
    python = F.concat(F.repeat(F.lit("."), depth + 1), F.replace(stem, F.lit("/"), F.lit(".")))
    specifier = F.when(F.col("language") == "python", python).otherwise(F.concat(F.lit("./"), F.repeat(F.lit("../"), depth), stem))
    bound = F.array(*[F.struct(F.lit(j).alias("j"), local.alias("local_name"), imported.alias("imported_name")) for j, (local, imported) in enumerate([(F.coalesce("callee_name", "first"), F.col("first")), (F.col("first"), F.lit("default")), (text.basename(F.col("target")), F.lit("*"))])])
    flat = p.select("path", "k", specifier.alias("specifier"), F.explode(bound).alias("b"))
    return flat.select("path", (F.col("k") * 3 + F.col("b.j")).alias("ord"), "b.local_name", "b.imported_name", "specifier")


def stored_specifiers(spark, folder):
    """The paths that each import may mean, in the order in which they are tried."""
    return resolution.specifier_candidates(imports_of(spark, folder), files(spark, folder))


def _resolved(spark, folder) -> tuple[DataFrame, DataFrame]:
    imports = cut_lineage(imports_of(spark, folder))  # read for its files, its names and its bindings
    return imports, resolution.resolved_imports(imports, files(spark, folder))


def stored_imports(spark, folder):
    """Each import with the first of its paths that is a file."""
    return _resolved(spark, folder)[1]


def stored_imports_edges(spark, folder):
    return resolution.imports_edges(_resolved(spark, folder)[1]).select("source", "target", "kind")


def resolve_refs(spark, folder):
    """The stored open references, resolved again: by the imports of their file, else by a name that is unique in the workspace,
    else left open, as likely external where the file imports the name."""
    refs = table(spark, folder, "unresolved_refs").select(F.col("file_path").alias("path"), F.lit(None).cast("string").alias("caller_key"), "callee_name", "line", "col", F.lit(False).alias("is_member_call"))
    imports, resolved = _resolved(spark, folder)
    return resolution.resolved_calls(refs, _declared(spark, folder), resolved, imports).select("source", "callee_name", "target", "line", "col", "likely_external")


def stored_heritage(spark, folder):
    """The stored bases by their names, resolved again."""
    n = nodes(spark, folder, ("kind", "name", "file_path"))
    e = edges(spark, folder, ("source", "target", "kind")).where("kind IN ('extends', 'implements')").withColumnRenamed("kind", "relation")
    key = F.regexp_extract("source", r":(\d+:\d+)$", 1)
    named = e.join(n.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target").join(n.where("kind <> 'file'").select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source")
    heritage = named.select("path", key.alias("source_key"), "target_name", "relation").distinct()
    return resolution.heritage_edges(heritage, _declared(spark, folder), _resolved(spark, folder)[1]).select("source", "target", "kind")


def stored_report(spark, folder):
    """Per language, files and declarations of the stored graph; its edges and open references, of which a name declared in
    the workspace is likely internal."""
    declared = _declared(spark, folder)
    names = declared.select(F.col("name").alias("callee_name")).distinct().withColumn("known", F.lit(True))
    refs = table(spark, folder, "unresolved_refs").join(names, "callee_name", "left").withColumn("likely_external", F.col("known").isNull())
    return resolution.index_report(files(spark, folder), declared, ranking.current_edges(table(spark, folder, "edges"), ("kind",)), refs)


QUERIES = (stored_specifiers, stored_imports, stored_imports_edges, resolve_refs, stored_heritage, stored_report)
