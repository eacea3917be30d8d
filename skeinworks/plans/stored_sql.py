"""SQL of the queries that resolve a stored graph again."""

from __future__ import annotations

from .graph_sql import WITH

# What is tried after an import's path, in order, by the importing language.
SUFFIXES = {
    "typescript": ["", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx"],
    "tsx": ["", ".tsx", ".ts", "/index.tsx", "/index.ts"],
    "javascript": ["", ".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"],
    "jsx": ["", ".jsx", ".js", "/index.jsx", "/index.js"],
    "python": ["", ".py", "/__init__.py"],
}
_ROWS = ", ".join(f"('{language}', {i}, '{suffix}')" for language, all_ in SUFFIXES.items() for i, suffix in enumerate(all_))

BASE = f"""{WITH}, suffixes AS (SELECT * FROM (VALUES {_ROWS}) AS x(language, priority, suffix)),
decl AS (SELECT * FROM n WHERE kind <> 'file'),
firsts AS (SELECT file_path AS target, min(name) AS first FROM decl GROUP BY 1),
pairs AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY target) AS k FROM (
  SELECT DISTINCT regexp_replace(regexp_replace(source, '^file:', ''), ':\\d+:\\d+$', '') AS path, substr(target, 6) AS target FROM e WHERE kind = 'imports' AND target LIKE 'file:%')
  WHERE path <> target AND path IN (SELECT path FROM f) AND target IN (SELECT path FROM f)),
called AS (SELECT path, callee_name, row_number() OVER (PARTITION BY path ORDER BY callee_name) AS k FROM (SELECT DISTINCT file_path AS path, callee_name FROM unresolved_refs WHERE callee_name IS NOT NULL)),
said AS (SELECT p.path, p.k, f.language, regexp_replace(p.target, '\\.[^./]*$', '') AS stem, p.target, firsts.first, coalesce(called.callee_name, firsts.first) AS local
  FROM pairs p JOIN firsts ON firsts.target = p.target JOIN f ON f.path = p.path LEFT JOIN called ON called.path = p.path AND called.k = p.k),
based AS (SELECT path, k, language, first, local, regexp_extract(target, '([^/]*)$', 1) AS module, CASE WHEN language = 'python' THEN replace(stem, '.', '/') ELSE stem END AS base FROM said),
imports AS (SELECT path, language, CAST(k * 3 AS INTEGER) AS ord, local AS local_name, first AS imported_name, base FROM based
  UNION ALL SELECT path, language, CAST(k * 3 + 1 AS INTEGER), first, 'default', base FROM based
  UNION ALL SELECT path, language, CAST(k * 3 + 2 AS INTEGER), module, '*', base FROM based),
candidates AS (SELECT path, ord, local_name, imported_name, base || suffix AS candidate, CAST(priority AS INTEGER) AS priority FROM imports JOIN suffixes USING (language)),
resolved AS (SELECT path, ord, local_name, imported_name, candidate AS target FROM candidates WHERE candidate IN (SELECT path FROM f) QUALIFY row_number() OVER (PARTITION BY path, ord ORDER BY priority) = 1),
bindings AS (SELECT * FROM resolved WHERE imported_name <> '*' QUALIFY row_number() OVER (PARTITION BY path, local_name ORDER BY ord DESC) = 1),
means AS (SELECT file_path AS target, name AS imported_name, min(id) AS id FROM decl WHERE name <> 'default' GROUP BY 1, 2 HAVING count(*) = 1
  UNION ALL SELECT file_path, 'default', min(id) FROM decl WHERE is_exported = 1 GROUP BY 1 HAVING count(*) = 1),
bound AS (SELECT b.path, b.local_name AS name, m.id FROM bindings b JOIN means m ON m.target = b.target AND m.imported_name = b.imported_name)"""

_UNIQUE = "SELECT name, min(id) AS id FROM decl {} GROUP BY name HAVING count(*) = 1"

SQL = {
    "stored_specifiers": f"{BASE} SELECT * FROM candidates",
    "stored_imports": f"{BASE} SELECT * FROM resolved",
    "stored_imports_edges": f"{BASE} SELECT DISTINCT 'file:' || path AS source, 'file:' || target AS target, 'imports' AS kind FROM resolved",
    "resolve_refs": f"""{BASE}, u AS ({_UNIQUE.format("")}), imported AS (SELECT DISTINCT path, local_name FROM imports)
      SELECT 'file:' || r.file_path AS source, r.callee_name, coalesce(b.id, u.id) AS target, r.line, r.col, i.path IS NOT NULL AS likely_external
      FROM unresolved_refs r LEFT JOIN bound b ON b.path = r.file_path AND b.name = r.callee_name LEFT JOIN u ON u.name = r.callee_name LEFT JOIN imported i ON i.path = r.file_path AND i.local_name = r.callee_name""",
    "stored_heritage": f"""{BASE}, u AS ({_UNIQUE.format("WHERE kind IN ('class', 'interface')")}),
      h AS (SELECT DISTINCT s.file_path AS path, regexp_extract(e.source, ':(\\d+:\\d+)$', 1) AS source_key, t.name, e.kind FROM e JOIN decl s ON s.id = e.source JOIN n t ON t.id = e.target WHERE e.kind IN ('extends', 'implements'))
      SELECT h.path || ':' || h.source_key AS source, coalesce(b.id, u.id) AS target, h.kind FROM h LEFT JOIN bound b ON b.path = h.path AND b.name = h.name LEFT JOIN u ON u.name = h.name WHERE coalesce(b.id, u.id) IS NOT NULL""",
    "stored_report": f"""{WITH}, decl AS (SELECT * FROM n WHERE kind <> 'file')
      SELECT f.language, CAST(count(*) AS BIGINT) AS files, max(s.symbols) AS symbols, (SELECT CAST(count(*) AS BIGINT) FROM e) AS edges, (SELECT CAST(count(*) AS BIGINT) FROM unresolved_refs) AS unresolved,
        (SELECT CAST(count(*) AS BIGINT) FROM unresolved_refs WHERE callee_name IN (SELECT name FROM decl)) AS likely_internal
      FROM f LEFT JOIN (SELECT language, CAST(count(*) AS BIGINT) AS symbols FROM decl GROUP BY 1) s ON s.language = f.language GROUP BY f.language""",
}
