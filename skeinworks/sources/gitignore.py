"""Exclusion rules: folder names, and gitignore patterns as columns.

Rules are ordered and the last match wins; ``!`` takes a path back, a leading
or inner ``/`` anchors, a trailing ``/`` means folders only, ``*`` stays within
a segment, every other character -- ``?`` and brackets too -- is literal.  A path
is ignored if it or a folder above it is; nothing below an ignored folder comes
back.  A rule that cannot be read is skipped alone.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str  # over a whole path
    negated: bool
    folders_only: bool


def parse(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = re.sub(r"\\\*", "[^/]*", re.escape(line.lstrip("/")))
        rules.append(Rule(("" if anchored else "(?:.*/)?") + body, negated, folders))
    return rules


def load(root: str) -> list[Rule]:
    """The rules of a tree; none without a readable file."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return parse(f.read())
    except OSError:
        return []


def decide(path: Column, is_folder: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches this very path ignores it."""
    out = F.lit(False)
    for r in rules:
        hit = path.rlike(f"^(?:{r.regex})$")
        out = F.when(hit & is_folder if r.folders_only else hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file's path or any folder above it is ignored."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.exists(F.sequence(F.lit(1), depth), lambda k: decide(F.array_join(F.slice(parts, F.lit(1), k), "/"), k < depth, rules))


def excluded_by_name(path: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(*names))
