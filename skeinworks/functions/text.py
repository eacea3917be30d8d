"""Text functions as columns: normal forms for phrase search, globs, terms, clips and paths."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that say nothing about a task.
STOPWORDS = "a an and are as at be but by can do does for from how in into is it its not of on or that the their then there this to was what when where which why will with work works add fix bug code file files need make use used using".split()


def _folded() -> tuple[str, str]:
    """The Latin small letters with marks, and the letters without them."""
    marked, plain = "", ""
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.islower():
            marked, plain = marked + chr(code), plain + base
    return marked, plain


FOLDED = _folded()


def norm(column: Column) -> Column:
    """Tokens (letters and digits, case-folded, Latin letters without their marks) with single spaces before, between and after."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(_plain(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def _plain(column: Column) -> Column:
    return F.translate(F.lower(column), *FOLDED)


def phrase_prefix(column: Column, phrase: str) -> Column:
    """The phrase's tokens stand next to each other and in order in the column, the last one as a prefix."""
    wanted = F.rtrim(norm(F.lit(phrase)))
    hit = F.length(wanted) > 0
    # no pattern is tried where a part of the phrase is missing altogether
    for part in set(re.findall("[a-z0-9]{3,}", phrase.lower())):
        hit = hit & F.contains(_plain(column), F.lit(part))
    return hit & F.contains(norm(column), wanted)


def glob(pattern: str) -> str:
    """A glob as a regular expression: ``*`` crosses ``/``, ``?`` is one character, ``[a-z]`` and ``[^a-z]`` are sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close]
            negated = inner.startswith("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&~^])", r"\\\1", inner[negated:]) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def subtree(column: Column, folder: str) -> Column:
    """Below a folder.  As stored graphs do, the folder is a pattern: ``%`` and ``_`` are wildcards and case is ignored."""
    return F.ilike(column, F.lit(folder.rstrip("/") + "/%"))


def clip(column: Column, most: int) -> Column:
    return F.when(F.length(column) > most, F.concat(F.left(column, F.lit(most)), F.lit("…"))).otherwise(column)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normalized(path: Column) -> Column:
    """``.`` and ``..`` resolved, as far as the path allows."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    empty = F.array().cast("array<string>")
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(F.aggregate(parts, empty, up), "/"))


def terms(tasks: DataFrame, key: str, text: str, most: int | None) -> DataFrame:
    """``key, term, ord``: the search terms of each task -- words of at least three characters that are no stopwords, each
    once in its first spelling, longest first, at most ``most`` (None: all).  ``ord`` counts from 1.  NULL tasks have none."""
    words = tasks.select(key, F.posexplode(F.split(F.col(text), r"[^\p{L}\p{N}_$]+")).alias("pos", "term"))
    kept = words.where((F.length("term") >= 3) & ~F.lower("term").isin(*STOPWORDS))
    first = kept.groupBy(key, F.lower("term").alias("lc")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    order = Window.partitionBy(key).orderBy(F.length("term").desc(), "pos")
    ranked = first.withColumn("ord", F.row_number().over(order)).select(key, "term", "ord")
    return ranked if most is None else ranked.where(F.col("ord") <= most)
