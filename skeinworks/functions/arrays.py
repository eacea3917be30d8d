"""JSON arrays of strings, and the checks that stored rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_array_state(column: Column) -> Column:
    """'empty' (NULL or ''), 'ok', 'unparseable', 'not_array' or 'bad_element' of a JSON text that should hold an array of strings."""
    parsed = F.try_parse_json(column)
    kind = F.schema_of_variant(parsed)
    elements = F.from_json(column, "array<variant>")
    bad = F.exists(elements, lambda x: F.coalesce(F.schema_of_variant(x) != "STRING", F.lit(True)))
    return (
        F.when(column.isNull() | (column == ""), "empty")
        .when(parsed.isNull(), "unparseable")
        .when(~F.startswith(kind, F.lit("ARRAY<")), "not_array")
        .when(bad, "bad_element")
        .otherwise("ok")
    )


def string_array(column: Column) -> Column:
    """The array; empty for NULL and ''; an error for anything else than an array of strings."""
    state = json_array_state(column)
    empty = F.array().cast("array<string>")
    return F.when(state == "empty", empty).when(state == "ok", F.from_json(column, "array<string>")).otherwise(F.raise_error(F.concat(F.lit("MALFORMED_INDEX: "), state)))


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """The rows, failing loudly where a required column is NULL."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"MALFORMED_INDEX: {c} is missing"))).otherwise(F.col(c)) for c in required})
