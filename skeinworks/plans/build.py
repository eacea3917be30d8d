"""Registered queries that build a graph from source text: extraction and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, resolution
from ..session import cut_lineage
from .graph import edges, nodes
from .tables import table


class Build:
    """One extraction of a workspace and everything resolved from it; what of it is wanted is computed and written once."""

    def __init__(self, source_texts: DataFrame, *parts: str) -> None:
        wanted = parts or ("definitions", "calls", "imports", "heritage")
        found = extract.extracted(source_texts)
        nothing = [F.lit(None).cast(found.schema[x].dataType).alias(x) for x in ("definitions", "calls", "imports", "heritage") if x not in wanted]
        self.extraction = cut_lineage(found.select("path", "language", *wanted)).select("*", *nothing)
        texts = source_texts.select("path", F.size(F.split("text", "\n")).alias("line_count"))
        self.files = self.extraction.select("path", "language").join(texts, "path", "left")
        self.definitions = extract.exploded(self.extraction, "definitions")
        self.calls = extract.exploded(self.extraction, "calls")
        self.imports = extract.exploded(self.extraction, "imports")
        self.heritage = extract.exploded(self.extraction, "heritage")
        self.declarations = resolution.declaration_nodes(self.definitions, self.files)
        self.resolved = resolution.resolved_imports(self.imports, self.files)
        self.resolved_calls = resolution.resolved_calls(self.calls, self.declarations, self.resolved, self.imports)

    def nodes(self) -> DataFrame:
        return resolution.file_nodes(self.files).unionByName(self.declarations, allowMissingColumns=True)

    def edges(self) -> DataFrame:
        parts = [resolution.contains_edges(self.definitions), resolution.imports_edges(self.resolved), resolution.call_edges(self.resolved_calls), resolution.heritage_edges(self.heritage, self.declarations, self.resolved)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def unresolved(self) -> DataFrame:
        return resolution.unresolved_calls(self.resolved_calls)


def _build(spark, folder, *parts: str) -> Build:
    return Build(table(spark, folder, "source_texts"), *parts)


def extract_definitions(spark, folder):
    d = extract.exploded(extract.extracted(table(spark, folder, "source_texts")), "definitions")
    return d.withColumn("container", F.array_join("container", ".")).withColumn("decorators", F.to_json("decorators"))


def extract_calls(spark, folder):
    return extract.exploded(extract.extracted(table(spark, folder, "source_texts")), "calls")


def extract_imports(spark, folder):
    return extract.exploded(extract.extracted(table(spark, folder, "source_texts")), "imports")


def specifier_candidates(spark, folder):
    b = _build(spark, folder, "imports")
    return resolution.specifier_candidates(b.imports, b.files)


def contains_edges(spark, folder):
    return resolution.contains_edges(_build(spark, folder, "definitions").definitions)


def imports_edges(spark, folder):
    return resolution.imports_edges(_build(spark, folder, "imports").resolved)


def call_edges(spark, folder):
    return resolution.call_edges(_build(spark, folder, "definitions", "calls", "imports").resolved_calls)


def unresolved_calls(spark, folder):
    return _build(spark, folder, "definitions", "calls", "imports").unresolved()


def heritage_edges(spark, folder):
    b = _build(spark, folder, "definitions", "imports", "heritage")
    return resolution.heritage_edges(b.heritage, b.declarations, b.resolved)


def build_nodes(spark, folder):
    return _build(spark, folder, "definitions").nodes()


def build_edges(spark, folder):
    return _build(spark, folder).edges()


def index_report(spark, folder):
    b = _build(spark, folder)
    return resolution.index_report(b.files, b.declarations, b.edges(), b.unresolved())


def declarations_found(spark, folder):
    """The stored declarations that extraction finds in the text, at their place and under their name."""
    b = _build(spark, folder, "definitions")
    found = b.definitions.select(resolution.node_id(F.col("path"), F.col("key")).alias("id"), "name").distinct()
    return nodes(spark, folder, ("kind", "name")).where("kind <> 'file'").join(found, ["id", "name"], "left_semi").select("id", "name")


def imports_found(spark, folder):
    """What each file imports, and from where."""
    return _build(spark, folder, "imports").imports.select("path", "specifier", "imported_name").distinct()


def unique_names(spark, folder):
    return resolution.unique_names(nodes(spark, folder, ("kind", "name")).where("kind <> 'file'"))


def stored_call_degree(spark, folder):
    """Calls into and out of every node of the stored graph."""
    e = edges(spark, folder, ("source", "target", "kind")).where("kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL")
    out, into = (e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n)) for c, n in (("source", "calls_out"), ("target", "calls_in")))
    n = table(spark, folder, "nodes").where("id IS NOT NULL").select("id").distinct()
    return n.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("calls_out", F.lit(0)).alias("calls_out"), F.coalesce("calls_in", F.lit(0)).alias("calls_in"))


QUERIES = (extract_definitions, extract_calls, extract_imports, specifier_candidates, contains_edges, imports_edges, call_edges, unresolved_calls, heritage_edges, build_nodes, build_edges, index_report, declarations_found, imports_found, unique_names, stored_call_degree)
