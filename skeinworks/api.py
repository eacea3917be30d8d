"""Requests and answers: the eleven operations over stored graphs.

Every answer is built by DataFrame operators and limited there; only the
rendered rows, at most a request's bounded limit, reach the driver.
"""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .operators import compose, ranking, relations, resolution, traverse
from .plans.build import Build
from .session import cut_lineage
from .sources import gitignore, snapshot, tree


class Providers:
    """Stores and indexers by id; exactly one may claim a root, whatever the order of registration."""

    def __init__(self) -> None:
        self.known: dict[str, Any] = {}

    def register(self, provider_id: str, provider: Any) -> Any:
        if not provider_id or not provider_id.strip() or provider_id in self.known:
            raise model.GraphError("INVALID_PROVIDER", f"id {provider_id!r} is empty or taken")
        self.known[provider_id] = provider
        return lambda: self.known.pop(provider_id, None)

    def select(self, root: str, none: str = "UNAVAILABLE") -> Any:
        claims = sorted(k for k, p in self.known.items() if p.claims(root))
        if not claims:
            raise model.GraphError(none, f"nobody serves {root}")
        if len(claims) > 1:
            raise model.GraphError("CONFLICT", ", ".join(claims))
        return self.known[claims[0]]

    def available(self, root: str) -> bool:
        return any(p.claims(root) for p in self.known.values())


def _view(row: dict) -> dict:
    """A symbol for callers: absent fields are left out."""
    out = {"name": row["name"], "qualified_name": row["qualified_name"], "kind": row["kind"], "language": row["language"], "path": row["file_path"], "line": row["start_line"], "exported": row["is_exported"] == 1}
    for key, most in (("docstring", model.DOC_CHARS), ("signature", model.SIGNATURE_CHARS)):
        if row.get(key):
            out[key] = row[key] if len(row[key]) <= most else row[key][:most] + "…"
    return out


class Graph:
    """The operations over one graph: ``nodes``, ``edges``, ``files`` and, for slices, ``source_texts (path, text)``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, source_texts: DataFrame | None = None, live: DataFrame | None = None, edges_by_target: DataFrame | None = None, **bounds: int) -> None:
        self.nodes, self.edges, self.files, self.texts, self.live = nodes, edges, files, source_texts, live
        self.incoming = edges if edges_by_target is None else edges_by_target  # lookups from the target read this layout
        self.limit, self.max_limit = bounds.get("limit", model.LIMIT), bounds.get("max_limit", model.MAX_LIMIT)
        self.depth, self.max_depth = bounds.get("depth", model.DEPTH), bounds.get("max_depth", model.MAX_DEPTH)
        self.max_paths, self.budget = bounds.get("max_paths", model.MAX_PATHS), bounds.get("budget", model.NODE_BUDGET)
        if min(self.limit, self.max_limit, self.depth, self.max_depth, self.max_paths, self.budget) < 1:
            raise model.GraphError("INVALID_REQUEST", "bounds must be positive")

    @classmethod
    def of(cls, stored: snapshot.Snapshot, source_texts: DataFrame | None = None, live: DataFrame | None = None, **bounds: int) -> Graph:
        """The operations over a stored graph."""
        return cls(stored["nodes"], stored["edges"], stored["files"], source_texts, live, stored["edges_by_target"], **bounds)

    def _edges(self, incoming: bool) -> DataFrame:
        return self.incoming if incoming else self.edges

    def _limit(self, value: float | None) -> int:
        return model.clamp(value, self.limit, self.max_limit)

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _subject(self, symbol: str) -> dict | None:
        return next(iter(self._rows(ranking.resolve_symbol(self.nodes, symbol, 1))), None)

    def search(self, query: str, limit: float | None = None, kind: str | None = None, language: str | None = None) -> dict:
        model.required(query, "query")
        rows = self._rows(ranking.search(self.nodes, query, self._limit(limit), kind, language))
        total = ranking.search_matches(self.nodes, query, kind, language).count()
        return {"operation": "search", "nodes": [_view(r) for r in rows], "total": total, "truncated": total > len(rows)}

    def _relations(self, anchor: str, incoming: bool, kind: str | None, limit: int) -> list[dict]:
        rows = relations.relations(self._edges(incoming), self.nodes, anchor, incoming, kind, limit)
        return self._shown(self._rows(rows.select("far", F.col("kind").alias("via"), "line", "site_count")))

    def _shown(self, full: list[dict]) -> list[dict]:
        """Relations as callers see them; at most a request's limit of rows."""
        by = {r["id"]: r for r in self._rows(self.nodes.where(F.col("id").isin([r["far"] for r in full])))} if full else {}
        out = []
        for r in full:
            one = {"symbol": _view(by[r["far"]]), "via": r["via"], "site_count": r["site_count"]}
            out.append(one | ({"site_line": r["line"]} if r["line"] is not None else {}))
        return out

    def node(self, symbol: str, limit: float | None = None, include_code: bool = False) -> dict:
        n = self._limit(limit)
        found = self._rows(ranking.resolve_symbol(self.nodes, model.required(symbol, "symbol"), n + 1))
        if not found:
            return {"operation": "node", "incoming": [], "outgoing": [], "alternatives": []}
        s = found[0]
        out = {"operation": "node", "node": _view(s), "incoming": self._relations(s["id"], True, None, n), "outgoing": self._relations(s["id"], False, None, n), "alternatives": [_view(r) for r in found[1:]]}
        if include_code and self.texts is not None:
            span = self.nodes.where(F.col("id") == s["id"]).select("file_path", F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))
            code = compose.source_slices(span, self.texts, model.SOURCE_LINES, model.SOURCE_CHARS).first()
            out["code"] = code["code"]
        return out

    def _calls(self, operation: str, symbol: str, incoming: bool, limit: float | None) -> dict:
        s, n = self._subject(model.required(symbol, "symbol")), self._limit(limit)
        if s is None:
            return {"operation": operation, "relations": [], "total": 0, "truncated": False}
        found = self._relations(s["id"], incoming, "calls", n)
        total = relations.grouped(self._edges(incoming), s["id"], incoming, "calls").count()
        return {"operation": operation, "subject": _view(s), "relations": found, "total": total, "truncated": total > len(found)}

    def callers(self, symbol: str, limit: float | None = None) -> dict:
        return self._calls("callers", symbol, True, limit)

    def callees(self, symbol: str, limit: float | None = None) -> dict:
        return self._calls("callees", symbol, False, limit)

    def impact(self, symbol: str, depth: float | None = None, limit: float | None = None) -> dict:
        s = self._subject(model.required(symbol, "symbol"))
        if s is None:
            return {"operation": "impact", "entries": [], "total": 0, "truncated": False}
        origin = self.nodes.sparkSession.range(1).select(F.lit(s["id"]).alias("id"))
        hits, exhausted = traverse.impact(self.incoming, origin, model.clamp(depth, self.depth, self.max_depth), None, self.budget)
        total = hits.count()
        best = hits.orderBy("distance", "id").limit(self._limit(limit)).join(self.nodes, "id").orderBy("distance", "id")
        rows = self._rows(best)
        return {"operation": "impact", "subject": _view(s), "entries": [{"symbol": _view(r), "distance": r["distance"], "via": r["via"]} for r in rows], "total": total, "truncated": exhausted or total > len(rows)}

    def trace(self, start: str, goal: str, depth: float | None = None, max_paths: int | None = None) -> dict:
        a, b = self._subject(model.required(start, "from")), self._subject(model.required(goal, "to"))
        out: dict[str, Any] = {"operation": "trace", "paths": []} | ({"from": _view(a)} if a else {}) | ({"to": _view(b)} if b else {})
        if a and b:
            paths = self._rows(traverse.trace(self.edges, self.nodes, a["id"], b["id"], model.clamp(depth, self.max_depth, self.max_depth), self.max_paths if max_paths is None else max_paths, self.budget).orderBy("path_no"))
            ids = sorted({h["node"] for p in paths for h in p["hops"]})
            by = {r["id"]: r for r in self._rows(self.nodes.where(F.col("id").isin(ids)))} if ids else {}
            out["paths"] = [[{"symbol": _view(by[h["node"]])} | ({"via": h["kind"]} if h["kind"] else {}) for h in p["hops"]] for p in paths]
        return out

    def list_files(self, path: str | None = None, pattern: str | None = None, limit: float | None = None) -> dict:
        found = ranking.list_files(self.files, path, pattern)
        rows, total = self._rows(found.orderBy("path").limit(self._limit(limit))), found.count()
        return {"operation": "files", "files": rows, "total": total, "truncated": total > len(rows)}

    def status(self) -> dict:
        one = self._rows(ranking.status(self.nodes, self.edges, self.files))[0]
        languages = self._rows(ranking.language_histogram(self.files).orderBy(F.col("file_count").desc(), "language"))
        stale = self._rows(ranking.stale_count(self.files, self.live, model.STALENESS_CHECKS))[0] if self.live is not None else {"stale_file_count": 0, "truncated": False}
        out = {"operation": "status", "indexed": True, "format_version": model.FORMAT_VERSION, "languages": languages, "stale_file_count": stale["stale_file_count"], "stale_file_count_truncated": stale["truncated"]}
        return out | {k: v for k, v in one.items() if v is not None}

    def _ranked(self, query: str, limit: int) -> DataFrame:
        found = ranking.search(self.nodes, query, limit)
        order = Window.partitionBy(F.lit(0)).orderBy(*ranking.by_rank(ranking.search_tier(query)))  # at most a request's limit of rows
        numbered = found.withColumn("rank", F.row_number().over(order))
        return compose.drop_structural(numbered)

    def explore(self, query: str, limit: float | None = None, files: int = model.SOURCE_FILES) -> dict:
        ranked = self._ranked(model.required(query, "query"), self._limit(limit))
        out = self._explored(ranked, files)
        total = ranked.agg(F.count_distinct("file_path")).first()[0]
        return {"operation": "explore", "files": out, "total": total, "truncated": total > len(out)}

    def _explored(self, ranked: DataFrame, files: int) -> list[dict]:
        """The files of ranked nodes with their slices."""
        grouped = compose.group_by_file(ranked, files)
        sliced = compose.source_slices(grouped, self.texts, model.SOURCE_LINES, model.SOURCE_CHARS) if self.texts is not None else grouped
        rows = self._rows(sliced.orderBy("file_rank"))
        return [{"path": r["file_path"], "symbols": r["symbols"].split(","), "truncated": bool(r.get("truncated"))} | ({"code": r["code"], "code_start_line": r["code_start_line"]} if r.get("code") is not None else {}) for r in rows]

    def context(self, task: str, limit: float | None = None) -> dict:
        spark = self.nodes.sparkSession
        tasks = spark.range(1).select(F.lit(1).alias("task_id"), F.lit(model.required(task, "task")).alias("task"))
        entries = compose.context_entries(self.nodes, tasks, model.CONTEXT_TERMS, self._limit(None), self._limit(limit))
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("hits").desc(), "best", "id")  # at most a request's limit of rows
        ranked = cut_lineage(entries.join(self.nodes, "id").withColumn("rank", F.row_number().over(order)))
        near = compose.related(F.broadcast(ranked.where(F.col("rank") <= model.SOURCE_FILES).select("id", "rank")), self.edges, self.nodes, self.limit, self.limit)
        related = self._shown(self._rows(near.select("seen", "far", F.col("kind").alias("via"), "line", "site_count").orderBy("seen")))
        rows = self._rows(ranked.orderBy("rank"))
        return {"operation": "context", "task": task, "entry_points": [_view(r) for r in rows], "related": related, "files": self._explored(ranked, model.SOURCE_FILES)}


def status(spark: SparkSession, store: str, **given: Any) -> dict:
    """The status of a stored graph; where there is none, only that nothing is indexed -- every other operation fails then."""
    try:
        stored = snapshot.read(spark, store)
    except model.GraphError as e:
        if e.code != "UNAVAILABLE":
            raise
        return {"operation": "status", "indexed": False}
    return Graph.of(stored, **given).status()


def index(spark: SparkSession, root: str, store: str, max_files: int | None = None, max_bytes: int | None = None) -> dict:
    """Walks a source tree, extracts, resolves and stores its graph; reports what was done.  Every file counts, unless a caller
    bounds their number or size."""
    if not tree.available(root):
        raise model.GraphError("NO_INDEXER", f"{root} is no folder")
    found, overflow = tree.discover(tree.listing(spark, root), gitignore.load(root), max_files=max_files)
    read, skipped = tree.read_files(found, max_bytes)
    build = Build(read)
    now = F.unix_millis(F.current_timestamp())
    nodes, edges, unresolved = resolution.stored_nodes(build.nodes(), now), build.edges(), build.unresolved()
    numbered = edges.withColumn("id", F.monotonically_increasing_id()).withColumn("provenance", F.lit("lexer"))
    counts = nodes.where("kind <> 'file'").groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count"))
    files = read.join(counts, "path", "left").select("path", "content_hash", "language", "size", "modified_at", now.alias("indexed_at"), F.coalesce("node_count", F.lit(0)).alias("node_count"), F.lit(None).cast("string").alias("errors"))
    snapshot.write(store, {"nodes": nodes, "edges": numbered, "files": files, "unresolved_refs": unresolved})
    g = snapshot.read(spark, store)
    languages = {r["language"]: r["n"] for r in g["files"].groupBy("language").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "language").collect()}
    left = overflow.first()[0] + skipped.first()[0]
    open_calls = g["unresolved_refs"].agg(F.count("*"), F.count_if(~F.col("likely_external"))).first()
    return {"operation": "index", "files_indexed": g["files"].count(), "files_skipped": left, "symbol_count": g["nodes"].count(), "edge_count": g["edges"].count(), "unresolved_count": open_calls[0], "unresolved_likely_internal_count": open_calls[1], "languages": languages}


# -- text form ---------------------------------------------------------------
def _line(s: dict) -> str:
    tail = "" if s.get("exported") else " (local)"
    signature = "  " + " ".join(s["signature"].split()) if s.get("signature") else ""
    return f"{s['path']}:{s['line']}  {s['kind']} {s['name']}{tail}{signature}"


def _plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def render(answer: dict) -> str:
    """One text form per operation."""
    op = answer["operation"]
    shown = lambda k: f" ({len(answer[k])} of {answer['total']} shown)" if answer.get("truncated") else ""
    out: list[str] = []
    if op == "search":
        out = [f"{_plural(answer['total'], 'match')}{shown('nodes')}".replace("matchs", "matches"), *map(_line, answer["nodes"])]
    elif op in ("callers", "callees"):
        if "subject" not in answer:
            return "no such symbol"
        out = [f"{op} of {_line(answer['subject'])}{shown('relations')}"]
        out += [f"  {_line(r['symbol'])}{f' ×{r["site_count"]}' if r['site_count'] > 1 else ''}" for r in answer["relations"]]
    elif op == "node":
        if "node" not in answer:
            return "no such symbol"
        out = [_line(answer["node"])] + [f"  <- {r['via']} {_line(r['symbol'])}" for r in answer["incoming"]] + [f"  -> {r['via']} {_line(r['symbol'])}" for r in answer["outgoing"]] + [f"  also {_line(a)}" for a in answer["alternatives"]]
    elif op == "impact":
        if "subject" not in answer:
            return "no such symbol"
        out = [f"impact of {_line(answer['subject'])}{shown('entries')}"] + [f"  {_plural(e['distance'], 'hop')} via {e['via']}: {_line(e['symbol'])}" for e in answer["entries"]]
    elif op == "trace":
        out = [_plural(len(answer["paths"]), "path")] + ["  " + " -> ".join(h["symbol"]["name"] for h in p) for p in answer["paths"]]
    elif op == "files":
        out = [f"{_plural(answer['total'], 'file')}{shown('files')}"] + [f"  {f['path']}  {f['language']}" for f in answer["files"]]
    elif op == "status":
        if not answer.get("indexed"):
            return "not indexed"
        at = answer.get("indexed_at")
        when = datetime.datetime.fromtimestamp(at / 1000, datetime.UTC).isoformat() if at else "never"
        out = [f"{_plural(answer['file_count'], 'file')}, {_plural(answer['node_count'], 'node')}, {_plural(answer['edge_count'], 'edge')}; indexed {when}; {answer['stale_file_count']}{'+' if answer['stale_file_count_truncated'] else ''} stale"]
        out += [f"  {x['language']}: {x['file_count']}" for x in answer["languages"]]
    elif op == "explore":
        for f in answer["files"]:
            out += [f["path"] + ": " + ", ".join(f["symbols"])] + ([f["code"]] if f.get("code") else [])
    elif op == "context":
        out = [answer["task"], *map(_line, answer["entry_points"])] + [f"  {r['via']} {_line(r['symbol'])}" for r in answer["related"]]
        for f in answer["files"]:
            out += [f["path"] + ": " + ", ".join(f["symbols"])] + ([f["code"]] if f.get("code") else [])
    elif op == "index":
        out = [f"{_plural(answer['files_indexed'], 'file')}, {_plural(answer['symbol_count'], 'symbol')}, {_plural(answer['edge_count'], 'edge')}, {answer['unresolved_count']} unresolved"]
    return "\n".join(out)


def title(arguments: dict) -> str | None:
    """What a call is about: symbol, query, task, both ends of a trace, pattern or path, in this order."""
    ends = f"{arguments['from']} → {arguments['to']}" if arguments.get("from") and arguments.get("to") else None
    return arguments.get("symbol") or arguments.get("query") or arguments.get("task") or ends or arguments.get("pattern") or arguments.get("path")
