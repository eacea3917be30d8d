"""Problem 4: source files that do not parse.

Bundled grammars (:mod:`.grammars`) are compiled to tables and run by a
chart-like recogniser (:mod:`.chart`) over the full token stream of each file.
The first token that no derivation can take is the file's first unrecoverable
error.  For Python a reported error is confirmed by the interpreter's own
parser, which also knows the exact line.

NULL texts and languages without a bundled grammar give ``valid`` = NULL;
empty and comment-only texts are valid.  Paths are unique in the result.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from . import chart, grammars, lexing
from .sources import files_with_text, repository

SCHEMA = "path string, language string, valid boolean, error_line int"
_CLASSES = "ID NUM STR CHR TPL RE BAD LIFE CONST VAR SYM INDENT DEDENT END MODIFIER".split()


@cache
def parser(language: str) -> tuple[chart.Recogniser, lexing.Classes]:
    """The language's tables; built once per Python worker."""
    terminals = chart.Terminals()
    grammar = chart.Grammar(grammars.GRAMMARS[language], terminals)
    for name in (*lexing.KEYWORDS[language].split(), *_CLASSES):
        terminals[name]
    skip = terminals["NL"] if language in grammars.SKIP_NL else ""
    return chart.Recogniser(grammar, skip), lexing.Classes(language, terminals)


def token_lines(text: str, language: str, table: lexing.Classes) -> list[str]:
    if language == "python":
        return lexing.python_lines(text, table)
    if language == "ruby":
        return lexing.ruby_lines(text, table)
    if language == "go":
        return lexing.go_lines(text, table)
    lines = lexing.classes_by_line(text, language, table)
    return [x + "\n" for x in lines] if language in grammars.SKIP_NL else lines


def first_error(text: str, language: str) -> int:
    """Line (from 1) of the first error, 0 for a valid text."""
    recogniser, table = parser(language)
    line = recogniser.first_error(token_lines(text, language, table))
    if line and language == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(text)
            except SyntaxError as e:
                return e.lineno or line
            except (ValueError, RecursionError, MemoryError):
                return line
            return 0
    return line


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, languages = b.column("path").to_pylist(), b.column("language").to_pylist()
        valid: list[bool | None] = []
        lines: list[int | None] = []
        for language, text in zip(languages, b.column("text"), strict=True):
            text = text.as_py()
            if text is None or language not in grammars.GRAMMARS:
                valid.append(None)
                lines.append(None)
                continue
            line = first_error(text, language)
            valid.append(line == 0)
            lines.append(line or None)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(languages, pa.string()), pa.array(valid, pa.bool_()), pa.array(lines, pa.int32())], names=["path", "language", "valid", "error_line"])


def parsed_files(files: DataFrame, source_texts: DataFrame) -> DataFrame:
    """``path, language, valid, error_line`` of each current file."""
    return bounded_batches(files_with_text(files, source_texts)).mapInArrow(_parse, SCHEMA)


def invalid_rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language; files that could not be judged are not counted."""
    return (
        parsed.where("valid IS NOT NULL")
        .groupBy(repository(F.col("path")).alias("repository"), "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .withColumn("invalid_rate", F.col("invalid") / F.col("files"))
    )
