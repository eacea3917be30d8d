"""Resolution of raw extractions -- definitions, calls, imports, heritage -- to a graph.

Everything is joins and aggregates: the file-local lookups join on (file, key),
the workspace-wide rule joins on a name that exactly one declaration has.
Inputs (one row each):

* files: ``path, language, line_count``
* definitions: ``path, key, parent_key, kind, name, container ARRAY, start_line, end_line, start_column, end_column, is_exported, is_async, is_static, decorators ARRAY``
* calls: ``path, caller_key, callee_name, line, col, is_member_call``
* imports: ``path, ord, local_name, imported_name, specifier``
* heritage: ``path, source_key, target_name, relation``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import NODE_COLUMNS

# What is tried after an import's path, in order, by the importing language.
SUFFIXES = {
    "typescript": [".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx"],
    "tsx": [".tsx", ".ts", "/index.tsx", "/index.ts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"],
    "jsx": [".jsx", ".js", "/index.jsx", "/index.js"],
    "python": [".py", "/__init__.py"],
}
HERITAGE_KINDS = ("class", "interface")


def node_id(path: Column, key: Column) -> Column:
    """``path:line:column``; ``key`` is ``line:column``."""
    return F.concat(path, F.lit(":"), key)


def file_nodes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.where("path IS NOT NULL").select(F.concat(F.lit("file:"), path).alias("id"), F.lit("file").alias("kind"), text.basename(path).alias("name"), path.alias("qualified_name"), path.alias("file_path"), "language", F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.coalesce("line_count", F.lit(1))).cast("int").alias("end_line"), F.lit(False).alias("is_exported"))


def declaration_nodes(definitions: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of the definitions; from the second declaration at one place on, ids get a suffix that depends on content only."""
    d = definitions.join(files.select("path", "language"), "path")
    order = Window.partitionBy("path", "key").orderBy("kind", "name", F.col("end_line").desc())
    number = F.row_number().over(order)
    id_ = node_id(F.col("path"), F.col("key"))
    qualified = F.concat(F.col("path"), F.lit("::"), F.concat_ws(".", F.concat(F.coalesce("container", F.array().cast("array<string>")), F.array("name"))))
    return d.withColumn("n", number).select(F.when(F.col("n") == 1, id_).otherwise(F.concat(id_, F.lit("#"), F.col("n"))).alias("id"), "kind", "name", qualified.alias("qualified_name"), F.col("path").alias("file_path"), "language", "start_line", "end_line", "start_column", "end_column", "is_exported", "is_async", "is_static", F.to_json("decorators").alias("decorators"))


def stored_nodes(nodes: DataFrame, updated_at: Column) -> DataFrame:
    """The nodes with all columns of a stored graph: flags as 0/1, what extraction does not know as NULL."""
    texts = {"docstring", "signature", "visibility", "decorators", "type_parameters"}
    out = []
    for c in NODE_COLUMNS:
        if c == "updated_at":
            out.append(updated_at.alias(c))
        elif c in nodes.columns:
            value = F.coalesce(F.col(c), F.lit(False)).cast("int") if c.startswith("is_") else F.coalesce(F.col(c), F.lit(0)) if c.endswith("_column") else F.col(c)
            out.append(value.alias(c))
        else:
            out.append(F.lit(None).cast("string" if c in texts else "int").alias(c))
    return nodes.select(*out)


def contains_edges(definitions: DataFrame) -> DataFrame:
    parent = F.when(F.col("parent_key").isNull(), F.concat(F.lit("file:"), F.col("path"))).otherwise(node_id(F.col("path"), F.col("parent_key")))
    return definitions.select(parent.alias("source"), node_id(F.col("path"), F.col("key")).alias("target"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))


def specifier_base(language: Column, path: Column, specifier: Column) -> Column:
    """The path that an import means, before suffixes; NULL where the language or form never resolves.

    ECMAScript: only relative forms.  Python: n dots climb n-1 folders, the rest is dotted; absolute imports stay open.
    """
    folder = text.dirname(path)
    relative = F.when(F.startswith(specifier, F.lit(".")), text.normalized(F.concat_ws("/", F.nullif(folder, F.lit("")), specifier)))
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    rest = F.translate(F.substr(specifier, dots + 1), ".", "/")
    climb = F.array_join(F.concat(F.array(folder), F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)))), "/")
    python = F.when(dots > 0, text.normalized(F.concat_ws("/", F.nullif(climb, F.lit("")), F.nullif(rest, F.lit("")))))
    return F.when(language.isin("typescript", "tsx", "javascript", "jsx"), relative).when(language == "python", python)


def specifier_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``path, ord, local_name, imported_name, candidate, priority``: the paths an import may mean, the exact one first."""
    langs = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), F.array(F.lit(""), *map(F.lit, v)))])
    i = imports.join(files.select("path", "language"), "path")
    based = i.withColumn("base", specifier_base(F.col("language"), F.col("path"), F.col("specifier"))).where("base IS NOT NULL")
    tried = based.select("path", "ord", "local_name", "imported_name", "base", F.posexplode(langs[F.col("language")]).alias("priority", "suffix"))
    return tried.select("path", "ord", "local_name", "imported_name", F.concat("base", "suffix").alias("candidate"), "priority")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``path, ord, local_name, imported_name, target``: the first candidate that is an indexed file."""
    known = files.select(F.col("path").alias("candidate"))
    hit = specifier_candidates(imports, files).join(known, "candidate")
    best = hit.groupBy("path", "ord").agg(F.min_by(F.struct("local_name", "imported_name", "candidate"), "priority").alias("b"))
    return best.select("path", "ord", "b.local_name", "b.imported_name", F.col("b.candidate").alias("target"))


def imports_edges(resolved: DataFrame) -> DataFrame:
    """One edge per pair of files."""
    ids = [F.concat(F.lit("file:"), F.col(c)) for c in ("path", "target")]
    return resolved.select(ids[0].alias("source"), ids[1].alias("target")).distinct().select("source", "target", F.lit("imports").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))


def unique_names(nodes: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``name, unique_id`` of the names that exactly one declaration of the workspace has."""
    n = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    return n.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("unique_id")).where("n = 1").select("name", "unique_id")


def bindings(resolved: DataFrame) -> DataFrame:
    """``path, local_name, imported_name, target``: the last binding of a name in a file; whole-module imports bind none."""
    own = resolved.where("imported_name <> '*'")
    return own.groupBy("path", "local_name").agg(F.max_by(F.struct("imported_name", "target"), "ord").alias("b")).select("path", "local_name", "b.*")


def _bound_ids(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """``path, name, bound_id``: what an imported name means in its target file, if exactly one declaration fits."""
    n = nodes.select(F.col("file_path").alias("target"), "name", "id", "is_exported")
    by_name = n.groupBy("target", "name").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("target", F.col("name").alias("imported_name"), "id")
    defaults = n.where("is_exported").groupBy("target").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("target", F.lit("default").alias("imported_name"), "id")
    named = by_name.where("imported_name <> 'default'").unionByName(defaults)
    return bound.join(named, ["target", "imported_name"]).select("path", F.col("local_name").alias("name"), F.col("id").alias("bound_id"))


def resolved_calls(calls: DataFrame, nodes: DataFrame, resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """``source, path, callee_name, target, line, col, likely_external``: target by the file's imports, else by a name that
    is unique in the workspace, else NULL.  A miss is likely external if it is a member call or the file imports the name."""
    bound = _bound_ids(nodes, bindings(resolved))
    imported = imports.select("path", F.col("local_name").alias("callee_name")).distinct().withColumn("imported", F.lit(True))
    c = calls.join(bound.withColumnRenamed("name", "callee_name"), ["path", "callee_name"], "left")
    c = c.join(unique_names(nodes).withColumnRenamed("name", "callee_name"), "callee_name", "left").join(imported, ["path", "callee_name"], "left")
    caller = F.when(F.col("caller_key").isNull(), F.concat(F.lit("file:"), F.col("path"))).otherwise(node_id(F.col("path"), F.col("caller_key")))
    external = F.col("is_member_call") | F.coalesce("imported", F.lit(False))
    return c.select(caller.alias("source"), "path", "callee_name", F.coalesce("bound_id", "unique_id").alias("target"), "line", "col", external.alias("likely_external"))


def call_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("target IS NOT NULL").select("source", "target", F.lit("calls").alias("kind"), "line", "col")


def unresolved_calls(resolved: DataFrame) -> DataFrame:
    return resolved.where("target IS NULL").select("source", F.col("path").alias("file_path"), "callee_name", "line", "col", "likely_external")


def heritage_edges(heritage: DataFrame, nodes: DataFrame, resolved: DataFrame, kinds: tuple[str, ...] = HERITAGE_KINDS) -> DataFrame:
    """Extends and implements; bases found neither by import nor as a unique name of ``kinds`` are dropped."""
    h = heritage.withColumnRenamed("target_name", "name").join(_bound_ids(nodes, bindings(resolved)), ["path", "name"], "left").join(unique_names(nodes, kinds), "name", "left")
    target = F.coalesce("bound_id", "unique_id")
    return h.where(target.isNotNull()).select(node_id(F.col("path"), F.col("source_key")).alias("source"), target.alias("target"), F.col("relation").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"))


def declarations_per_file(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, node_count``: declarations of each file, without the file's own node; 0 where it has none."""
    n = nodes.where("kind <> 'file'").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    return files.select("path").distinct().join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("node_count"))


def index_report(files: DataFrame, nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Per language: files and declarations; and for the whole run on every row: edges, open calls, likely internal ones."""
    per = files.groupBy("language").agg(F.count("*").alias("files")).join(nodes.groupBy("language").agg(F.count("*").alias("symbols")), "language", "left")
    one = F.lit(1).alias("one")
    e, u = edges.agg(F.count("*").alias("edges")), unresolved.agg(F.count("*").alias("unresolved"), F.count_if(~F.col("likely_external")).alias("likely_internal"))
    return per.select("*", one).join(e.select("*", one), "one").join(u.select("*", one), "one").drop("one")
