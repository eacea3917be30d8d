"""SQL for the queries of this package that SQL can express: what the results of the operators must come to, whatever they are.

Parsing, packing, mixing and sentences themselves are tested against brute force and on labelled texts.
"""

from __future__ import annotations

_FILES = "SELECT f.language, count(*) AS n FROM (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1) f JOIN source_texts s ON s.path = f.path WHERE s.text IS NOT NULL GROUP BY f.language"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_checks": "SELECT CAST(count(*) AS BIGINT) AS functions, 0 AS repeated, 0 AS strangers, 0 AS uncoded FROM (SELECT kind FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1) WHERE kind IN ('function', 'method')",
        "p4_checks": f"SELECT language, CAST(n AS BIGINT) AS files, 0 AS unjudged, 0 AS unplaced FROM ({_FILES})",
        "p5_checks": f"SELECT language, CAST(n AS BIGINT) AS files, 0 AS unsigned FROM ({_FILES})",
        "p6_checks": "SELECT container, (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE text IS NOT NULL) AS texts, 0 AS cut, 0 AS overfull, 0 AS skipped FROM container_sizes",
        "p7_checks": "SELECT lower(trim(source)) AS source, target_share, max_repeats, true AS repeats_kept, true AS share_kept FROM source_targets",
        "p8_checks": r"SELECT CAST(count(*) AS BIGINT) AS texts, 0 AS disordered, 0 AS unfinished FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')",
    }
