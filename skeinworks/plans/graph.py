"""Registered queries over a stored graph: search, relations, walks, files, status and composed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import arrays, text
from ..operators import compose, ranking, relations, resolution, traverse
from ..session import cut_lineage, cut_measured
from ..sources import gitignore, tree
from ..streaming import debounce
from .tables import table

# Arguments of the registered queries.
QUERY, PHRASE = "beacon", "keeps insertion or"
EXCLUDED = ("vendor", "node_modules", "third_party", "dist")
IGNORE_RULES = "# build output\ngen/\n*.min.js\n/public\nsrc/**/generated/\n!keep.min.js\n"
TASK = "Why does the beacon lose its harbor window when the ledger drains twice"


def nodes(spark: SparkSession, folder: str, columns=model.NODE_COLUMNS) -> DataFrame:
    """All nodes, with the columns that the query needs."""
    return ranking.current_nodes(table(spark, folder, "nodes"), columns)


def nodes_where(spark: SparkSession, folder: str, wanted: Column, columns=model.NODE_COLUMNS) -> DataFrame:
    """The nodes that a search wants; its filter reaches the scan."""
    return ranking.latest_where(table(spark, folder, "nodes"), "id", "updated_at", columns, wanted)


def edges(spark: SparkSession, folder: str, columns=ranking.EDGE_FIELDS) -> DataFrame:
    return ranking.current_edges(table(spark, folder, "edges"), columns)


def edges_where(spark: SparkSession, folder: str, wanted: Column) -> DataFrame:
    return ranking.latest_where(table(spark, folder, "edges"), "id", "recorded_at", ranking.EDGE_FIELDS, wanted)


def walked_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges for walks, which scan them once a level."""
    return ranking.settled(table(spark, folder, "edges"), "id", "recorded_at", ("source", "target", "kind"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.list_files(table(spark, folder, "files"))


def _subject(spark: SparkSession, folder: str, e: DataFrame | None = None) -> str:
    e = edges(spark, folder, ("target", "kind")) if e is None else e
    return ranking.most_called(e, table(spark, folder, "nodes")) or ""


VIEW = ["id", "kind", "name", "qualified_name", "file_path", "language", "start_line"]


def symbol_resolve(spark, folder):
    name = ranking.commonest_name(nodes(spark, folder, ("kind", "name"))) or ""
    found = nodes_where(spark, folder, ranking.matches_symbol(name), [*VIEW, "is_exported"])
    return ranking.resolve_symbol(found, name, model.LIMIT).select(*VIEW)


def _found(spark, folder, query, **choice) -> DataFrame:
    return nodes_where(spark, folder, ranking.is_match(query, **choice))


def search_like(spark, folder):
    return ranking.search(_found(spark, folder, QUERY, full_text=False), QUERY, model.MAX_LIMIT, full_text=False).select(*VIEW)


def search_fts(spark, folder):
    return _found(spark, folder, PHRASE).select(*VIEW)


def search_ranked(spark, folder):
    return ranking.search(_found(spark, folder, QUERY), QUERY, model.MAX_LIMIT).select(*VIEW)


def search_filtered(spark, folder):
    return ranking.search(_found(spark, folder, QUERY, kind="function", language="python"), QUERY, model.MAX_LIMIT).select(*VIEW)


def search_total(spark, folder):
    return _found(spark, folder, QUERY).agg(F.count("*").alias("total"))


RELATION = ["near", "far", "kind", "site_count", "line", "col", "provenance", "edge_id", "far_qualified_name", "far_kind", "far_path", "far_line"]


FAR = ("name", "qualified_name", "kind", "file_path", "start_line")


def relations_in(spark, folder):
    return relations.with_far_node(relations.grouped(edges(spark, folder), None, True), nodes(spark, folder, FAR)).select(*RELATION)


def relations_out(spark, folder):
    return relations.with_far_node(relations.grouped(edges(spark, folder), None, False), nodes(spark, folder, FAR)).select(*RELATION)


def _of_subject(spark, folder, subject: str, incoming: bool, kind: str | None, limit: int) -> DataFrame:
    """Relations of one node: only its edges and the nodes at their other ends are compared with their repeated rows."""
    near, far = ("target", "source") if incoming else ("source", "target")
    wanted = F.col(near) == subject
    e = cut_lineage(edges_where(spark, folder, wanted & (F.col("kind") == kind) if kind else wanted))
    n = ranking.latest_of(table(spark, folder, "nodes"), "id", "updated_at", FAR, e.where(F.col(far).isNotNull()).select(F.col(far).alias("id")))
    return relations.relations(e, n, subject, incoming, kind, limit).select(*RELATION)


def callers(spark, folder):
    return _of_subject(spark, folder, _subject(spark, folder), True, "calls", model.MAX_LIMIT)


def callees(spark, folder):
    return relations.call_sites(edges(spark, folder), nodes(spark, folder, FAR), False).select(*RELATION)


def node_neighbourhood(spark, folder):
    s = _subject(spark, folder)
    sides = [_of_subject(spark, folder, s, incoming, None, model.LIMIT).select(F.lit(side).alias("side"), *RELATION) for side, incoming in (("in", True), ("out", False))]
    return sides[0].unionByName(sides[1])


def relations_total_dangling(spark, folder):
    return relations.totals(edges(spark, folder, ("source", "target", "kind")), table(spark, folder, "nodes").where("id IS NOT NULL").select("id").distinct(), True, None)


def _impact(spark, folder, depth, kinds=None, budget=None):
    e = walked_edges(spark, folder)
    origin = spark.range(1).select(F.lit(_subject(spark, folder, e)).alias("id"))
    return traverse.impact(e, origin, depth, kinds, budget)[0]


def impact_d1(spark, folder):
    return _impact(spark, folder, 1)


def impact_d3(spark, folder):
    return _impact(spark, folder, 3)


def impact_calls_only(spark, folder):
    return _impact(spark, folder, 3, ["calls"])


def impact_truncated(spark, folder):
    return _impact(spark, folder, 3, None, 50)


def impact_rendered(spark, folder):
    """Impact entries with their nodes; ids without a node drop out."""
    hits = cut_lineage(_impact(spark, folder, 2))
    return hits.join(ranking.latest_of(table(spark, folder, "nodes"), "id", "updated_at", ("name", "kind", "file_path", "start_line"), hits), "id")


def _trace_ends(spark, folder, walked):
    """The most called node and the least id two edges before it."""
    e, goal = walked.where("source IS NOT NULL AND target IS NOT NULL"), _subject(spark, folder, walked)
    near = cut_measured(e.where(F.col("target") == goal).select("source").distinct()).side()
    first = e.join(near.select(F.col("source").alias("target")), "target", "left_semi").select("source").distinct().join(near, "source", "left_anti").where(F.col("source") != goal)
    start = first.join(table(spark, folder, "nodes").select(F.col("id").alias("source")), "source", "left_semi").agg(F.min("source")).first()[0]
    return start, goal


def _flat(paths: DataFrame) -> DataFrame:
    return paths.select("path_no", F.array_join("hops.node", " > ").alias("hops"), F.array_join(F.transform("hops.edge_id", lambda x: x.cast("string")), ",").alias("edge_ids"))


def trace_shortest(spark, folder):
    e = walked_edges(spark, folder)
    start, goal = _trace_ends(spark, folder, e)
    return _flat(traverse.trace(e, table(spark, folder, "nodes"), start, goal, model.MAX_DEPTH, 20))


def trace_self(spark, folder):
    s = _subject(spark, folder)
    return _flat(traverse.trace(edges(spark, folder), table(spark, folder, "nodes"), s, s, model.MAX_DEPTH, model.MAX_PATHS))


def files_all(spark, folder):
    return files(spark, folder)


def _largest_folder(spark, folder, depth: int) -> str | None:
    """The folder of so many segments that holds most files."""
    paths = table(spark, folder, "files").where("path IS NOT NULL").select("path").distinct()
    f = paths.withColumn("top", F.regexp_extract("path", "^([^/]+" + "/[^/]+" * (depth - 1) + ")/", 1)).where("top <> ''")
    top = f.groupBy("top").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "top").first()
    return top["top"] if top else None


def _below(spark, folder, name: str | None) -> DataFrame:
    return ranking.list_files(table(spark, folder, "files"), name) if name else files(spark, folder).where("false")


def files_subtree(spark, folder):
    """Below the repository that holds most files; as folders are patterns, its name in capitals finds the same."""
    name = _largest_folder(spark, folder, 1)
    return _below(spark, folder, name and name.upper())


def files_subtree_largest(spark, folder):
    """Below the folder of two segments that holds most files."""
    return _below(spark, folder, _largest_folder(spark, folder, 2))


def files_glob(spark, folder):
    return ranking.list_files(table(spark, folder, "files"), None, "*/core/*[a-m]*.py")


def status_counts(spark, folder):
    return ranking.status(*(table(spark, folder, x) for x in ("nodes", "edges", "files")))


def status_languages(spark, folder):
    return ranking.language_histogram(table(spark, folder, "files"))


def _live(spark, folder):
    """A listing to compare with: the files that have text, those with CRLF a second newer."""
    t = table(spark, folder, "source_texts").where("text <> ''").select("path", F.contains("text", F.lit("\r\n")).alias("crlf"))
    seen = t.join(files(spark, folder).select("path", "modified_at"), "path")
    return seen.select("path", (F.col("modified_at") + F.when(F.col("crlf"), 1000).otherwise(0)).alias("modified_at"))


def status_stale(spark, folder):
    return ranking.stale_files(files(spark, folder), _live(spark, folder))


def status_stale_runs(spark, folder):
    """The files as their earliest run left them, against the newest rows of the files that have a text."""
    first = table(spark, folder, "files").where("path IS NOT NULL AND indexed_at IS NOT NULL").groupBy("path").agg(F.min(F.struct("indexed_at", "modified_at")).alias("r")).select("path", "r.modified_at")
    live = files(spark, folder).select("path", "modified_at").join(table(spark, folder, "source_texts").select("path"), "path", "left_semi")
    return ranking.stale_files(first, live)


def status_stale_count(spark, folder):
    """How many of the first files by path are stale, and whether there are more files."""
    return ranking.stale_count(table(spark, folder, "files"), _live(spark, folder), model.STALENESS_CHECKS)


def file_records(spark, folder):
    t = F.col("text")
    return table(spark, folder, "source_texts").where("text IS NOT NULL").select("path", F.octet_length(t).cast("long").alias("size"), F.sha2(t, 256).alias("content_hash"), F.size(F.split(t, "\n")).cast("long").alias("line_count"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"))


def walk_kept(spark, folder):
    """The files that a walk over the indexed paths would keep, with their languages."""
    listed = table(spark, folder, "files").where("path IS NOT NULL").select("path").distinct()
    kept, _ = tree.discover(listed, gitignore.parse(IGNORE_RULES))
    return kept.select("path", "language")


def path_parts(spark, folder):
    """Names and folders of all paths, and the paths after a step into each folder and back."""
    p = F.col("path")
    return files(spark, folder).select("path", text.basename(p).alias("name"), text.dirname(p).alias("folder"), text.normalized(F.concat(text.dirname(p), F.lit("/./step/.././"), text.basename(p))).alias("again"))


def exclusion_filter(spark, folder):
    return files(spark, folder).where(~gitignore.excluded_by_name(F.col("path"), EXCLUDED)).select("path")


def gitignore_match(spark, folder):
    return files(spark, folder).select("path", gitignore.ignored(F.col("path"), gitignore.parse(IGNORE_RULES)).alias("ignored"))


def declarations_per_file(spark, folder):
    return resolution.declarations_per_file(files(spark, folder), nodes(spark, folder, ("kind", "file_path")))


def span_per_file(spark, folder):
    return compose.span_per_file(nodes(spark, folder, ("kind", "file_path", "start_line", "end_line")))


def _ranked(spark, folder):
    found = compose.drop_structural(ranking.search(_found(spark, folder, QUERY), QUERY, model.MAX_LIMIT))
    order = Window.partitionBy(F.lit(0)).orderBy(*ranking.by_rank(ranking.search_tier(QUERY)))  # at most MAX_LIMIT rows
    return found.withColumn("rank", F.row_number().over(order))


def explore_groups(spark, folder):
    return compose.group_by_file(_ranked(spark, folder), model.SOURCE_FILES)


def explore_slices(spark, folder):
    g = compose.group_by_file(_ranked(spark, folder), model.SOURCE_FILES)
    return compose.source_slices(g, table(spark, folder, "source_texts"), model.SOURCE_LINES, model.SOURCE_CHARS).select("file_path", "file_rank", "code", "code_start_line", "truncated")


def _spans(spark, folder) -> DataFrame:
    n = nodes(spark, folder, ("kind", "file_path", "start_line", "end_line")).where("kind <> 'file'")
    return n.select("id", "file_path", F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))


def source_slice(spark, folder):
    """The code of every declaration within the bounds of an answer."""
    return compose.source_slices(_spans(spark, folder), table(spark, folder, "source_texts"), model.SOURCE_LINES, model.SOURCE_CHARS).select("id", "code", "code_start_line", "truncated")


def source_whole(spark, folder):
    """All lines of every declaration."""
    return compose.source_slices(_spans(spark, folder), table(spark, folder, "source_texts"), None, None).select("id", "code", "code_start_line")


def clip_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.clip(F.col("text"), model.DOC_CHARS).alias("clipped"))


def context_terms(spark, folder):
    """Every document is a task, whatever its language."""
    return text.terms(table(spark, folder, "documents"), "doc_id", "text", model.CONTEXT_TERMS)


def context_terms_all(spark, folder):
    """All terms of every document, not only the best few."""
    return text.terms(table(spark, folder, "documents"), "doc_id", "text", None)


def _task(spark) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("task_id"), F.lit(TASK).alias("task"))


def context_ranked(spark, folder):
    return compose.context_entries(nodes(spark, folder, (*VIEW, "is_exported")), _task(spark), model.CONTEXT_TERMS, 50, model.MAX_LIMIT)


def _term_hits(spark, folder) -> DataFrame:
    terms = text.terms(_task(spark), "task_id", "task", model.CONTEXT_TERMS)
    return compose.term_hits(nodes(spark, folder, (*VIEW, "is_exported")), terms, model.LIMIT)


def merge_hits(spark, folder):
    """All nodes that the terms of a task find, by how many of them."""
    return compose.merge_hits(_term_hits(spark, folder))


def context_related(spark, folder):
    """Callers and callees of the best nodes of a task."""
    best = compose.merge_hits(_term_hits(spark, folder)).orderBy(F.col("hits").desc(), "best", "id").limit(model.SOURCE_FILES)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("hits").desc(), "best", "id")  # at most SOURCE_FILES rows
    entries = cut_lineage(best.select("id", F.row_number().over(order).alias("rank")))
    return compose.related(F.broadcast(entries), edges(spark, folder), nodes(spark, folder, FAR), model.LIMIT, model.LIMIT)


def relation_view(spark, folder):
    """Every caller of every node as it is shown: the symbol, the kind of relation, its sites and the first of them."""
    shown = [F.col("far_name").alias("name"), F.col("far_qualified_name").alias("qualified_name"), F.col("far_kind").alias("symbol_kind"), F.col("far_path").alias("path"), F.col("far_line").alias("symbol_line")]
    found = relations.call_sites(edges(spark, folder), nodes(spark, folder, FAR), True)
    return found.select("near", *shown, F.col("kind").alias("via"), "site_count", F.col("line").alias("site_line"))


def hop_view(spark, folder):
    """The hops of the shortest paths as they are shown."""
    e = walked_edges(spark, folder)
    start, goal = _trace_ends(spark, folder, e)
    paths = traverse.trace(e, table(spark, folder, "nodes"), start, goal, model.MAX_DEPTH, 20)
    hops = cut_lineage(paths.select("path_no", F.posexplode("hops").alias("hop", "h")).select("path_no", "hop", F.col("h.node").alias("id"), F.col("h.kind").alias("via")))
    shown = ranking.latest_of(table(spark, folder, "nodes"), "id", "updated_at", ("name", "kind", "file_path", "start_line"), hops)
    return hops.join(shown, "id").select("path_no", "hop", "via", "name", "kind", "file_path", "start_line")


def debounce_sessions(spark, folder):
    e = table(spark, folder, "events")
    return debounce.sessions(e, "2 hours", "user_id", "event_type").select("user_id", "started_at", "flushed_at", "n_events", F.array_join("paths", ",").alias("paths"))


def json_array_validate(spark, folder):
    n = table(spark, folder, "nodes").select(F.col("id"), F.col("decorators").alias("json"))
    f = table(spark, folder, "files").select(F.col("path").alias("id"), F.col("errors").alias("json"))
    e = table(spark, folder, "edges").select(F.col("id").cast("string").alias("id"), F.col("metadata").alias("json"))
    return n.unionByName(f).unionByName(e).groupBy(arrays.json_array_state(F.col("json")).alias("state")).agg(F.count("*").alias("n"))


def symbol_view(spark, folder):
    doc = text.clip(model.optional_text("docstring"), model.DOC_CHARS)
    wide = ("name", "qualified_name", "kind", "language", "file_path", "start_line", "docstring", "signature", "is_exported", "is_abstract")
    return nodes(spark, folder, wide).select("name", "qualified_name", "kind", "language", F.col("file_path").alias("path"), F.col("start_line").alias("line"), doc.alias("docstring"), text.clip(model.optional_text("signature"), model.SIGNATURE_CHARS).alias("signature"), model.flag("is_exported").alias("exported"), model.flag("is_abstract").alias("abstract"))


QUERIES = (symbol_resolve, search_like, search_fts, search_ranked, search_filtered, search_total, relations_in, relations_out, callers, callees, node_neighbourhood, relations_total_dangling, impact_d1, impact_d3, impact_calls_only, impact_truncated, impact_rendered, trace_shortest, trace_self, files_all, files_subtree, files_subtree_largest, files_glob, status_counts, status_languages, status_stale, status_stale_runs, status_stale_count, file_records, walk_kept, path_parts, exclusion_filter, gitignore_match, declarations_per_file, span_per_file, explore_groups, explore_slices, source_slice, source_whole, clip_text, context_terms, context_terms_all, context_ranked, merge_hits, context_related, relation_view, hop_view, debounce_sessions, json_array_validate, symbol_view)
