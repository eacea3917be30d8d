"""SQL of the registered queries."""

from __future__ import annotations

from .build_sql import SQL as BUILD_SQL
from .graph_sql import SQL
from .stored_sql import SQL as STORED_SQL

P2_FOUND = """
SELECT target, kind FROM edges
WHERE target IS NOT NULL AND trim(target) <> ''
GROUP BY target, kind HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)
"""

P2_GROUPS = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target, kind ORDER BY line NULLS LAST, col NULLS LAST, id NULLS LAST) AS rn FROM edges)
SELECT target, kind, CAST(count(*) AS BIGINT) AS n_sites, CAST(count(DISTINCT source) AS BIGINT) AS n_sources,
  max(line) FILTER (rn = 1) AS first_line, max(col) FILTER (rn = 1) AS first_col, max(id) FILTER (rn = 1) AS first_edge
FROM ranked GROUP BY target, kind
"""

_REFS = """
WITH newest AS (SELECT path, max(indexed_at) AS indexed_at FROM files WHERE path IS NOT NULL GROUP BY path),
refs AS (
  SELECT 'edges' AS ref_table, id AS row_id, 'source' AS field, source AS key, strftime(recorded_at, '%Y-%m') AS period FROM edges
  UNION ALL SELECT 'edges', id, 'target', target, strftime(recorded_at, '%Y-%m') FROM edges
  UNION ALL SELECT 'unresolved_refs', u.id, 'source', u.source, strftime(make_timestamp(n.indexed_at * 1000), '%Y-%m')
  FROM unresolved_refs u LEFT JOIN newest n ON n.path = u.file_path),
dangling AS (
  SELECT * FROM refs WHERE key IS NOT NULL AND trim(key) <> '' AND NOT EXISTS (SELECT 1 FROM nodes WHERE nodes.id = refs.key))
"""
P3_FOUND = _REFS + "SELECT DISTINCT ref_table, row_id, field FROM dangling"
P3_REPORT = _REFS + "SELECT ref_table, period, CAST(count(*) AS BIGINT) AS n_references, CAST(count(DISTINCT key) AS BIGINT) AS n_keys FROM dangling GROUP BY ref_table, period"
P3_PERIODS = """
WITH newest AS (SELECT path, max(indexed_at) AS indexed_at FROM files WHERE path IS NOT NULL GROUP BY path),
refs AS (
  SELECT 'edges' AS ref_table, source AS key, strftime(recorded_at, '%Y-%m') AS period, epoch_ms(recorded_at) AS moment FROM edges
  UNION ALL SELECT 'edges', target, strftime(recorded_at, '%Y-%m'), epoch_ms(recorded_at) FROM edges
  UNION ALL SELECT 'unresolved_refs', u.source, strftime(make_timestamp(n.indexed_at * 1000), '%Y-%m'), n.indexed_at
  FROM unresolved_refs u LEFT JOIN newest n ON n.path = u.file_path),
held AS (SELECT nodes.id, bool_or(coalesce(nodes.updated_at <= newest.indexed_at, true)) AS in_run, min(nodes.updated_at) AS since
  FROM nodes LEFT JOIN newest ON newest.path = nodes.file_path WHERE nodes.id IS NOT NULL GROUP BY nodes.id),
cases AS (
  SELECT refs.*, held.id IS NULL AS missing FROM refs LEFT JOIN held ON held.id = refs.key
  WHERE key IS NOT NULL AND trim(key) <> '' AND (held.id IS NULL OR (NOT in_run AND (moment IS NULL OR moment < since))))
SELECT ref_table, period, CAST(count(*) FILTER (missing) AS BIGINT) AS n_missing, CAST(count(DISTINCT key) FILTER (missing) AS BIGINT) AS n_missing_keys,
  CAST(count(*) FILTER (NOT missing) AS BIGINT) AS n_later, CAST(count(DISTINCT key) FILTER (NOT missing) AS BIGINT) AS n_later_keys
FROM cases GROUP BY ref_table, period
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p3_periods": P3_PERIODS} | SQL | BUILD_SQL | STORED_SQL
