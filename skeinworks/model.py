"""Schemas, vocabularies, bounds and errors of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns of a stored graph and the known, open vocabularies.
NODE_COLUMNS = "id kind name qualified_name file_path language start_line end_line start_column end_column docstring signature visibility is_exported is_async is_static is_abstract decorators type_parameters updated_at".split()
EDGE_COLUMNS = "id source target kind metadata line col provenance".split()
FILE_COLUMNS = "path language size modified_at indexed_at node_count".split()
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
KIND_RANKS = [("function", "method"), ("class", "component", "struct"), ("interface", "trait", "protocol"), ("type_alias", "enum", "route"), ("constant", "variable"), ("property", "field", "enum_member"), ("parameter", "namespace", "module"), ("import", "export"), ("file",)]
UNKNOWN_KIND_RANK = 6
STRUCTURAL_KINDS = ("import", "export", "file", "module")
FORMAT_VERSION = 4

# Default bounds of requests.
LIMIT, MAX_LIMIT = 20, 200
DEPTH, MAX_DEPTH = 2, 6
MAX_PATHS = 5
SOURCE_FILES, SOURCE_LINES, SOURCE_CHARS = 5, 200, 8000
DOC_CHARS, SIGNATURE_CHARS = 400, 200
CONTEXT_TERMS = 6
NODE_BUDGET = 20_000
STALENESS_CHECKS = 2_000
MAX_FILE_BYTES, MAX_FILES = 2_000_000, 50_000
DEBOUNCE_MS = 2_000


class GraphError(Exception):
    """One error class; ``code`` says which of the fixed conditions holds."""

    CODES = "INVALID_PROVIDER CONFLICT UNAVAILABLE UNSUPPORTED_FORMAT MALFORMED_INDEX DISPOSED NO_INDEXER WORKSPACE_REQUIRED INVALID_REQUEST".split()

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def clamp(value: float | None, default: int, most: int) -> int:
    """A caller's bound: absent or not finite gives the default as configured, anything else is cut to 1..most."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return default
    return min(most, max(1, int(value)))


def required(value: str | None, name: str) -> str:
    if value is None or not value.strip():
        raise GraphError("INVALID_REQUEST", f"{name} is required")
    return value


def flag(column: str) -> Column:
    """0/1 as a boolean; NULL and anything else than 1 are false."""
    return F.coalesce(F.col(column) == 1, F.lit(False))


def optional_text(column: str) -> Column:
    """NULL, '' and absent mean the same."""
    return F.nullif(F.col(column), F.lit(""))


def kind_rank(column: str = "kind") -> Column:
    rank = F.lit(UNKNOWN_KIND_RANK)
    for i, kinds in reversed(list(enumerate(KIND_RANKS))):
        rank = F.when(F.col(column).isin(*kinds), F.lit(i)).otherwise(rank)
    return rank
