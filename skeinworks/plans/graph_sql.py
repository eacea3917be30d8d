"""SQL of the registered graph queries."""

from __future__ import annotations

import re

# The contract's bounds, kinds and words, and the queries' arguments.  They are written here once more, so that a
# wrong one on either side shows.
CONTEXT_TERMS, DOC_CHARS, SIGNATURE_CHARS = 6, 400, 200
LIMIT, MAX_LIMIT, MAX_DEPTH = 20, 200, 6
SOURCE_FILES, SOURCE_LINES, SOURCE_CHARS = 5, 200, 8000
NODE_COLUMNS = "id kind name qualified_name file_path language start_line end_line start_column end_column docstring signature visibility is_exported is_async is_static is_abstract decorators type_parameters updated_at".split()
KIND_RANKS = [["function", "method"], ["class", "component", "struct"], ["interface", "trait", "protocol"], ["type_alias", "enum", "route"], ["constant", "variable"], ["property", "field", "enum_member"], ["parameter", "namespace", "module"], ["import", "export"], ["file"]]
UNKNOWN_KIND_RANK = 6
STRUCTURAL_KINDS = ["import", "export", "file", "module"]
STOPWORDS = "a an and are as at be but by can do does for from how in into is it its not of on or that the their then there this to was what when where which why will with work works add fix bug code file files need make use used using".split()
QUERY, PHRASE = "beacon", "keeps insertion or"
EXCLUDED = ["vendor", "node_modules", "third_party", "dist"]
EXCLUDED_FOLDERS = [".git", "node_modules", "dist", "build", "coverage", ".cache", "vendor", "target", "__pycache__"]
EXTENSIONS = {"typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "python": "py pyi", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "php": "php", "rust": "rs", "ruby": "rb", "zig": "zig", "kotlin": "kt kts", "swift": "swift", "dart": "dart", "scala": "scala sc"}
KNOWN = "known AS (SELECT * FROM (VALUES " + ", ".join(f"('.{x}', '{language}')" for language, all_ in EXTENSIONS.items() for x in all_.split()) + ") AS x(extension, language))"
TASK = "Why does the beacon lose its harbor window when the ledger drains twice"


def _latest(table: str, key: str, at: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [at, *columns])
    return f"SELECT {', '.join([key, *columns])} FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


NODES = _latest("nodes", "id", "updated_at", [c for c in NODE_COLUMNS if c != "id"])
EDGES = _latest("edges", "id", "recorded_at", ["source", "target", "kind", "line", "col", "provenance"])
FILES = _latest("files", "path", "indexed_at", ["content_hash", "language", "size", "modified_at", "node_count"]).replace("SELECT path,", "SELECT path, indexed_at,")
WITH = f"WITH RECURSIVE n AS ({NODES}), e AS ({EDGES}), f AS (SELECT path, language, size, modified_at, indexed_at, node_count FROM ({FILES})), subject AS (SELECT target AS id FROM e JOIN n ON n.id = e.target WHERE e.kind = 'calls' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
VIEW = "id, kind, name, qualified_name, file_path, language, start_line"
KIND_RANK = "CASE " + " ".join(f"WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {i}" for i, kinds in enumerate(KIND_RANKS)) + f" ELSE {UNKNOWN_KIND_RANK} END"
REST = f"{KIND_RANK}, coalesce(is_exported, 0) DESC, file_path NULLS FIRST, start_line NULLS FIRST, id"
TIER = f"CASE WHEN name = '{QUERY}' THEN 0 WHEN lower(name) = '{QUERY}' THEN 1 WHEN name ILIKE '{QUERY}%' THEN 2 WHEN qualified_name ILIKE '%{QUERY}%' THEN 3 ELSE 4 END"


def _norm(x: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"


def _match(q: str, full_text: bool = True) -> str:
    like = f"contains(lower(name), '{q}') OR contains(lower(qualified_name), '{q}')"
    if not full_text:
        return f"({like})"
    wanted = " " + " ".join(re.findall(r"\w+", q.lower()))
    return "(" + like + "".join(f" OR coalesce(contains({_norm(c)}, '{wanted}'), false)" for c in ("id", "name", "qualified_name", "docstring", "signature")) + ")"


def _relations(incoming: bool, where: str = "") -> str:
    near, far = ("target", "source") if incoming else ("source", "target")
    best = "ROW(line IS NULL, line, id)"
    return f"""SELECT g.near, g.far, g.kind, g.site_count, g.line, g.col, g.provenance, g.edge_id, n.qualified_name AS far_qualified_name, n.kind AS far_kind, n.file_path AS far_path, n.start_line AS far_line
    FROM (SELECT near, far, kind, site_count, line, col, provenance, id AS edge_id FROM (
      SELECT {near} AS near, {far} AS far, kind, line, col, provenance, id, count(*) OVER w AS site_count, row_number() OVER (PARTITION BY {near}, {far}, kind ORDER BY line NULLS LAST, id) AS rn
      FROM e WHERE source IS NOT NULL AND target IS NOT NULL {where} WINDOW w AS (PARTITION BY {near}, {far}, kind)) WHERE rn = 1) g JOIN n ON n.id = g.far"""


ORDER = "ORDER BY far_path NULLS FIRST, line NULLS FIRST, far_line NULLS FIRST, far, kind"


def _impact(depth: int, kinds: str = "") -> str:
    return f""", ue AS (SELECT id AS edge_id, source, target, kind FROM e WHERE source IS NOT NULL AND target IS NOT NULL {kinds}),
    reach AS (SELECT id, 0 AS d FROM subject UNION SELECT ue.source, reach.d + 1 FROM reach JOIN ue ON ue.target = reach.id WHERE reach.d < {depth}),
    dist AS (SELECT id, min(d) AS distance FROM reach GROUP BY id),
    hits AS (SELECT d.id, CAST(d.distance AS INTEGER) AS distance, arg_min(ue.kind, ue.edge_id) AS via, min(ue.edge_id) AS edge_id
      FROM dist d JOIN ue ON ue.source = d.id JOIN dist p ON p.id = ue.target AND p.distance = d.distance - 1 WHERE d.distance > 0 GROUP BY ALL)"""


def _budget(depth: int, most: int) -> str:
    """A walk level by level: each takes the first nodes of its order until the budget is used up, and only these are walked on."""
    parts = [f", ue AS (SELECT id AS edge_id, source, target, kind FROM e WHERE source IS NOT NULL AND target IS NOT NULL), l0 AS (SELECT id, CAST(NULL AS VARCHAR) AS via FROM subject)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))
        parts.append(f"""l{k} AS (SELECT source AS id, arg_min(kind, edge_id) AS via FROM ue WHERE target IN (SELECT id FROM l{k - 1}) AND source NOT IN ({seen})
          GROUP BY source ORDER BY min(edge_id), source LIMIT (SELECT {most} + 1 - count(*) FROM ({seen})))""")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id, {k} AS distance, via FROM l{k}" for k in range(1, depth + 1))


TRACE_WITH = f"""{WITH}, ue AS (SELECT id AS edge_id, source, target, kind FROM e WHERE source IS NOT NULL AND target IS NOT NULL),
near AS (SELECT DISTINCT source AS id FROM ue WHERE target = (SELECT id FROM subject)),
start AS (SELECT min(ue.source) AS id FROM ue JOIN near ON near.id = ue.target WHERE ue.source NOT IN (SELECT id FROM near) AND ue.source <> (SELECT id FROM subject) AND ue.source IN (SELECT id FROM n)),
reach AS (SELECT id, 0 AS d FROM start UNION SELECT ue.target, reach.d + 1 FROM reach JOIN ue ON ue.source = reach.id WHERE reach.d < {MAX_DEPTH} AND reach.id <> (SELECT id FROM subject)),
dist AS (SELECT id, min(d) AS d FROM reach GROUP BY id),
step AS (SELECT ue.source, ue.target, min(ue.edge_id) AS edge_id FROM ue JOIN dist a ON a.id = ue.source JOIN dist b ON b.id = ue.target AND b.d = a.d + 1 WHERE b.d <= (SELECT d FROM dist WHERE id = (SELECT id FROM subject)) GROUP BY ALL),
paths AS (SELECT id AS here, CAST([id] AS VARCHAR[]) AS nodes, CAST([] AS BIGINT[]) AS ids FROM start
  UNION ALL SELECT step.target, list_append(paths.nodes, step.target), list_append(paths.ids, step.edge_id) FROM paths JOIN step ON step.source = paths.here),
best AS (SELECT * FROM paths WHERE here = (SELECT id FROM subject) ORDER BY ids LIMIT 20)"""
PATHS = "SELECT CAST(row_number() OVER (ORDER BY ids) AS INTEGER) AS path_no, nodes, ids FROM best WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(nodes) AS x) WHERE x NOT IN (SELECT id FROM n))"
TRACE = f"{TRACE_WITH}, p AS ({PATHS}) SELECT path_no, array_to_string(nodes, ' > ') AS hops, array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ',') AS edge_ids FROM p"

RANKED = f"r AS (SELECT *, row_number() OVER (ORDER BY {TIER}, {REST}) AS rank FROM (SELECT * FROM n WHERE {_match(QUERY)} ORDER BY {TIER}, {REST} LIMIT {MAX_LIMIT}) WHERE kind NOT IN ({', '.join(repr(k) for k in STRUCTURAL_KINDS)}))"
GROUPS = f"g AS (SELECT file_path, CAST(row_number() OVER (ORDER BY min(rank)) AS INTEGER) AS file_rank, min(start_line) AS span_start, max(end_line) AS span_end, string_agg(name, ',' ORDER BY rank, name) AS symbols FROM r GROUP BY file_path ORDER BY min(rank) LIMIT {SOURCE_FILES})"


def _slice(body: str, first: str, last: str, lines: int, chars: int) -> str:
    return f"""SELECT *, greatest(1, {first}) AS a, least(len(string_split({body}, chr(10))), greatest(greatest(1, {first}), {last})) AS b,
      array_to_string(list_slice(string_split({body}, chr(10)), greatest(1, {first}), least(greatest(1, {first}) + {lines} - 1, greatest(greatest(1, {first}), {last}))), chr(10)) AS cut"""


STOP = ", ".join(repr(w) for w in STOPWORDS)


def _terms(source: str, key: str, body: str, most: int | None = CONTEXT_TERMS) -> str:
    return f"""w AS (SELECT {key}, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM (SELECT {key}, regexp_split_to_array({body}, '[^\\p{{L}}\\p{{N}}_$]+') AS words FROM {source})),
    first AS (SELECT {key}, lower(term) AS lc, arg_min(term, pos) AS term, min(pos) AS pos FROM w WHERE length(term) >= 3 AND lower(term) NOT IN ({STOP}) GROUP BY ALL),
    t AS (SELECT {key}, term, CAST(row_number() OVER (PARTITION BY {key} ORDER BY length(term) DESC, pos) AS INTEGER) AS ord FROM first{f" QUALIFY ord <= {most}" if most else ""})"""


LIVE = "live AS (SELECT s.path, CASE WHEN contains(s.text, chr(13) || chr(10)) THEN f.modified_at + 1000 ELSE f.modified_at END AS modified_at FROM source_texts s JOIN f ON f.path = s.path WHERE s.text <> '')"
HIT_TIER = "CASE WHEN name = term THEN 0 WHEN lower(name) = lower(term) THEN 1 WHEN starts_with(lower(name), lower(term)) THEN 2 WHEN contains(lower(qualified_name), lower(term)) THEN 3 ELSE 4 END"
_PARTS = "list_transform(range(1, len(string_split(path, '/')) + 1), lambda k: array_to_string(list_slice(string_split(path, '/'), 1, k), '/'))"
_DEPTH = "len(string_split(path, '/'))"


def _ignored() -> str:
    """Every prefix of the path, decided by the last rule that matches it; the rules of the query, spelt out."""
    decide = "CASE WHEN regexp_full_match(p, '(?:.*/)?keep\\.min\\.js') THEN false WHEN regexp_full_match(p, 'src/[^/]*[^/]*/generated') AND isdir THEN true WHEN regexp_full_match(p, 'public') THEN true WHEN regexp_full_match(p, '(?:.*/)?[^/]*\\.min\\.js') THEN true WHEN regexp_full_match(p, '(?:.*/)?gen') AND isdir THEN true ELSE false END"
    return f"SELECT path, bool_or({decide}) AS ignored FROM (SELECT path, unnest({_PARTS}) AS p, unnest(range(1, {_DEPTH} + 1)) < {_DEPTH} AS isdir FROM f) GROUP BY path"


def _hits(per_term: int) -> str:
    """The best nodes of each term of the task, and what they come to per node."""
    order = f"{HIT_TIER}, {KIND_RANK}, coalesce(is_exported, 0) DESC, file_path NULLS FIRST, start_line NULLS FIRST, id"
    found = "contains(lower(qualified_name), lower(term)) OR contains(lower(name), lower(term))"
    return f"""task AS (SELECT 1 AS task_id, '{TASK}' AS task), {_terms('task', 'task_id', 'task')},
    hits AS (SELECT term, id, kind, CAST(row_number() OVER (PARTITION BY term ORDER BY {order}) AS INTEGER) AS pos FROM n JOIN t ON {found} QUALIFY pos <= {per_term}),
    merged AS (SELECT id, CAST(count(DISTINCT term) AS BIGINT) AS hits, min(pos) AS best FROM hits WHERE kind NOT IN ({', '.join(repr(k) for k in STRUCTURAL_KINDS)}) GROUP BY id)"""


def _side(side: int, near: str, far: str) -> str:
    return f"""SELECT {side} AS side, entries.rank, e.{far} AS far, e.kind, CAST(count(*) AS BIGINT) AS site_count, arg_min(e.line, ROW(e.line IS NULL, e.line, e.id)) AS line
      FROM entries JOIN e ON e.{near} = entries.id WHERE e.kind = 'calls' AND e.{far} IS NOT NULL GROUP BY ALL"""


RELATED = f"""entries AS (SELECT id, row_number() OVER (ORDER BY hits DESC, best, id) AS rank FROM merged QUALIFY rank <= {SOURCE_FILES}),
  sides AS ({_side(0, 'target', 'source')} UNION ALL {_side(1, 'source', 'target')}),
  placed AS (SELECT s.*, n.name AS far_name, n.qualified_name AS far_qualified_name, n.kind AS far_kind, n.file_path AS far_path, n.start_line AS far_line,
    row_number() OVER (PARTITION BY s.rank, s.side ORDER BY n.file_path NULLS FIRST, s.line NULLS FIRST, n.start_line NULLS FIRST, s.far) AS pos FROM sides s JOIN n ON n.id = s.far QUALIFY pos <= {LIMIT}),
  once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY far_path, far_line, far_qualified_name, kind ORDER BY rank, side, pos) = 1)"""

SQL = {
    "symbol_resolve": f"{WITH}, s AS (SELECT name FROM n WHERE kind IN ('function', 'method') GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) SELECT {', '.join('n.' + x for x in VIEW.split(', '))} FROM n, s WHERE n.qualified_name = s.name OR n.name = s.name OR lower(n.name) = lower(s.name) ORDER BY CASE WHEN n.qualified_name = s.name THEN 0 WHEN n.name = s.name THEN 1 ELSE 2 END, {REST} LIMIT {LIMIT}",
    "search_like": f"{WITH} SELECT {VIEW} FROM n WHERE {_match(QUERY, False)} ORDER BY {TIER}, {REST} LIMIT {MAX_LIMIT}",
    "search_fts": f"{WITH} SELECT {VIEW} FROM n WHERE {_match(PHRASE)}",
    "search_ranked": f"{WITH} SELECT {VIEW} FROM n WHERE {_match(QUERY)} ORDER BY {TIER}, {REST} LIMIT {MAX_LIMIT}",
    "search_filtered": f"{WITH} SELECT {VIEW} FROM n WHERE {_match(QUERY)} AND kind = 'function' AND language = 'python' ORDER BY {TIER}, {REST} LIMIT {MAX_LIMIT}",
    "search_total": f"{WITH} SELECT CAST(count(*) AS BIGINT) AS total FROM n WHERE {_match(QUERY)}",
    "relations_in": f"{WITH} {_relations(True)}",
    "relations_out": f"{WITH} {_relations(False)}",
    "callers": f"{WITH} {_relations(True, 'AND kind = ' + repr('calls') + ' AND target = (SELECT id FROM subject)')} {ORDER} LIMIT {MAX_LIMIT}",
    "callees": f"{WITH} {_relations(False, 'AND kind = ' + repr('calls'))}",
    "node_neighbourhood": f"{WITH} SELECT 'in' AS side, * FROM ({_relations(True, 'AND target = (SELECT id FROM subject)')} {ORDER} LIMIT {LIMIT}) UNION ALL SELECT 'out', * FROM ({_relations(False, 'AND source = (SELECT id FROM subject)')} {ORDER} LIMIT {LIMIT})",
    "relations_total_dangling": f"{WITH} SELECT g.target AS near, CAST(count(*) AS BIGINT) AS total, CAST(count(n.id) AS BIGINT) AS rendered FROM (SELECT DISTINCT target, source, kind FROM e WHERE source IS NOT NULL AND target IS NOT NULL) g LEFT JOIN n ON n.id = g.source GROUP BY g.target",
    "impact_d1": f"{WITH}{_impact(1)} SELECT id, distance, via FROM hits",
    "impact_d3": f"{WITH}{_impact(3)} SELECT id, distance, via FROM hits",
    "impact_calls_only": f"{WITH}{_impact(3, 'AND kind = ' + repr('calls'))} SELECT id, distance, via FROM hits",
    "impact_truncated": f"{WITH}{_budget(3, 49)}",
    "impact_rendered": f"{WITH}{_impact(2)} SELECT hits.id, distance, via, name, kind, file_path, start_line FROM hits JOIN n ON n.id = hits.id",
    "trace_shortest": TRACE,
    "trace_self": f"{WITH} SELECT 1 AS path_no, id AS hops, '' AS edge_ids FROM subject",
    "files_all": f"{WITH} SELECT * FROM f",
    "files_subtree": f"{WITH} SELECT * FROM f WHERE path ILIKE (SELECT upper(top) || '/%' FROM (SELECT regexp_extract(path, '^([^/]+)/', 1) AS top FROM f) WHERE top <> '' GROUP BY top ORDER BY count(*) DESC, top LIMIT 1)",
    "files_subtree_largest": f"{WITH} SELECT * FROM f WHERE path ILIKE (SELECT top || '/%' FROM (SELECT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS top FROM f) WHERE top <> '' GROUP BY top ORDER BY count(*) DESC, top LIMIT 1)",
    "files_glob": f"{WITH} SELECT * FROM f WHERE path GLOB '*/core/*[a-m]*.py'",
    "status_counts": f"{WITH} SELECT (SELECT CAST(count(*) AS BIGINT) FROM f) AS file_count, (SELECT CAST(count(*) AS BIGINT) FROM n) AS node_count, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS edge_count, (SELECT nullif(max(indexed_at), 0) FROM f) AS indexed_at",
    "status_languages": f"{WITH} SELECT language, CAST(count(*) AS BIGINT) AS file_count FROM f GROUP BY language",
    "status_stale": f"{WITH}, {LIVE} SELECT f.path FROM f LEFT JOIN live ON live.path = f.path WHERE live.path IS NULL OR live.modified_at > f.modified_at",
    "status_stale_runs": f"{WITH}, o AS (SELECT path, modified_at FROM files WHERE path IS NOT NULL AND indexed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at, modified_at) = 1), live AS (SELECT f.path, f.modified_at FROM f WHERE f.path IN (SELECT path FROM source_texts)) SELECT o.path FROM o LEFT JOIN live ON live.path = o.path WHERE live.path IS NULL OR live.modified_at > o.modified_at",
    "status_stale_count": f"{WITH}, {LIVE}, c AS (SELECT * FROM f ORDER BY path LIMIT 2000) SELECT CAST(count(*) FILTER (live.path IS NULL OR live.modified_at > c.modified_at) AS BIGINT) AS stale_file_count, (SELECT count(*) FROM f) > 2000 AS truncated FROM c LEFT JOIN live ON live.path = c.path",
    "file_records": "SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS content_hash, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM source_texts WHERE text IS NOT NULL",
    "walk_kept": f"{WITH}, {KNOWN}, g AS ({_ignored()}) SELECT f.path, k.language FROM f JOIN known k ON k.extension = regexp_extract(f.path, '([.][^./]*)$', 1) JOIN g ON g.path = f.path WHERE NOT g.ignored AND NOT list_has_any(string_split(f.path, '/'), [{', '.join(repr(x) for x in EXCLUDED_FOLDERS)}])",
    "path_parts": f"{WITH} SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path AS again FROM f",
    "exclusion_filter": f"{WITH} SELECT path FROM f WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(repr(x) for x in EXCLUDED)}])",
    "gitignore_match": f"{WITH} {_ignored()}",
    "declarations_per_file": f"{WITH} SELECT f.path, CAST(count(n.id) AS BIGINT) AS node_count FROM f LEFT JOIN n ON n.file_path = f.path AND n.kind <> 'file' GROUP BY f.path",
    "span_per_file": f"{WITH} SELECT file_path, CAST(count(*) AS BIGINT) AS n, min(start_line) AS span_start, max(end_line) AS span_end FROM n WHERE kind <> 'file' GROUP BY file_path",
    "explore_groups": f"{WITH}, {RANKED}, {GROUPS} SELECT * FROM g",
    "explore_slices": f"{WITH}, {RANKED}, {GROUPS}, x AS ({_slice('text', 'span_start', 'span_end', SOURCE_LINES, SOURCE_CHARS)} FROM g LEFT JOIN source_texts s ON s.path = g.file_path) SELECT file_path, file_rank, left(cut, {SOURCE_CHARS}) AS code, CAST(a AS INTEGER) AS code_start_line, coalesce(b - a + 1 > {SOURCE_LINES} OR length(cut) > {SOURCE_CHARS}, false) AS truncated FROM x",
    "source_slice": f"{WITH}, d AS (SELECT id, file_path, start_line AS span_start, end_line AS span_end FROM n WHERE kind <> 'file'), x AS ({_slice('text', 'span_start', 'span_end', SOURCE_LINES, SOURCE_CHARS)} FROM d LEFT JOIN source_texts s ON s.path = d.file_path) SELECT id, left(cut, {SOURCE_CHARS}) AS code, CAST(a AS INTEGER) AS code_start_line, coalesce(b - a + 1 > {SOURCE_LINES} OR length(cut) > {SOURCE_CHARS}, false) AS truncated FROM x",
    "source_whole": f"{WITH}, d AS (SELECT id, file_path, greatest(1, start_line) AS a, greatest(1, start_line, end_line) AS b FROM n WHERE kind <> 'file') SELECT id, array_to_string(list_slice(string_split(text, chr(10)), a, b), chr(10)) AS code, CAST(a AS INTEGER) AS code_start_line FROM d LEFT JOIN source_texts s ON s.path = d.file_path",
    "clip_text": f"SELECT doc_id, CASE WHEN length(text) > {DOC_CHARS} THEN left(text, {DOC_CHARS}) || '…' ELSE text END AS clipped FROM documents",
    "context_terms": f"WITH {_terms('documents', 'doc_id', 'text')} SELECT * FROM t",
    "context_terms_all": f"WITH {_terms('documents', 'doc_id', 'text', None)} SELECT * FROM t",
    "context_ranked": f"{WITH}, {_hits(50)} SELECT * FROM merged ORDER BY hits DESC, best, id LIMIT {MAX_LIMIT}",
    "merge_hits": f"{WITH}, {_hits(LIMIT)} SELECT * FROM merged",
    "context_related": f"{WITH}, {_hits(LIMIT)}, {RELATED} SELECT CAST(row_number() OVER (ORDER BY rank, side, pos) AS INTEGER) AS seen, far, kind, site_count, line, far_name, far_qualified_name, far_kind, far_path, far_line FROM once ORDER BY rank, side, pos LIMIT {LIMIT}",
    "relation_view": f"{WITH} SELECT r.near, n.name, r.far_qualified_name AS qualified_name, r.far_kind AS symbol_kind, r.far_path AS path, r.far_line AS symbol_line, r.kind AS via, r.site_count, r.line AS site_line FROM ({_relations(True, 'AND kind = ' + repr('calls'))}) r JOIN n ON n.id = r.far",
    "hop_view": f"{TRACE_WITH}, p AS ({PATHS}), h AS (SELECT path_no, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS hop, ids FROM p) SELECT path_no, CAST(hop - 1 AS INTEGER) AS hop, ue.kind AS via, n.name, n.kind, n.file_path, n.start_line FROM h JOIN n ON n.id = h.id LEFT JOIN ue ON ue.edge_id = h.ids[hop - 1]",
    "debounce_sessions": "WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM m) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 2 HOURS AS flushed_at, CAST(count(*) AS BIGINT) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, session",
    "json_array_validate": "WITH j AS (SELECT decorators AS json FROM nodes UNION ALL SELECT errors FROM files UNION ALL SELECT metadata FROM edges), c AS (SELECT CASE WHEN json IS NULL OR json = '' THEN 'empty' WHEN NOT json_valid(json) THEN 'unparseable' WHEN json_type(json) <> 'ARRAY' THEN 'not_array' WHEN len(list_filter(json_extract(json, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'bad_element' ELSE 'ok' END AS state FROM j) SELECT state, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY state",
    "symbol_view": f"{WITH} SELECT name, qualified_name, kind, language, file_path AS path, start_line AS line, CASE WHEN length(docstring) > {DOC_CHARS} THEN left(docstring, {DOC_CHARS}) || '…' ELSE nullif(docstring, '') END AS docstring, CASE WHEN length(signature) > {SIGNATURE_CHARS} THEN left(signature, {SIGNATURE_CHARS}) || '…' ELSE nullif(signature, '') END AS signature, coalesce(is_exported = 1, false) AS exported, coalesce(is_abstract = 1, false) AS abstract FROM n",
    "unique_names": f"{WITH} SELECT name, min(id) AS unique_id FROM n WHERE kind <> 'file' GROUP BY name HAVING count(*) = 1",
    "stored_call_degree": f"{WITH}, c AS (SELECT * FROM e WHERE kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL), o AS (SELECT source AS id, CAST(count(*) AS BIGINT) AS k FROM c GROUP BY 1), i AS (SELECT target AS id, CAST(count(*) AS BIGINT) AS k FROM c GROUP BY 1) SELECT n.id, coalesce(o.k, 0) AS calls_out, coalesce(i.k, 0) AS calls_in FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id",
}
