"""Problem 1: functions and methods paired with their documentation.

Each source file is lexed once by the string- and comment-aware tables of
:mod:`.lexing`.  A state machine walks the tokens by line: brackets are matched
to delimit each function, lines are told apart as code, comment or blank, and
the comment that stands directly above a definition (annotations, attributes
and decorators may stand between) is attached to it; in Python the docstring.
``nodes.docstring`` is used where it is filled.  Each question about a place in
a file is answered by a search, so a file costs about as much as it is long,
however many functions it has.

Of several rows with one id the one with the greatest ``updated_at`` counts
(ties: the row with documentation, then the greatest text).  Nodes without an
id or of other kinds are left out.  A node whose file has no text keeps what
its row says and has NULL code; a NULL name removes no words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from . import lexing

SCHEMA = "id string, kind string, name string, language string, signature string, code string, delimited boolean, documentation string, documentation_from string, prose_words int"

#: Functions of one file that one row carries to Python; files with more come in several rows.
FILE_FUNCTIONS = 5_000

#: Words of prose, or Han and kana characters, that documentation needs.
MIN_WORDS, MIN_HAN = 4, 8

# How tool directives begin, and what stands for documentation that nobody wrote.
_DIRECTIVE = re.compile(
    r"\s*(?:eslint|tslint|jshint|jslint|jscs|prettier|istanbul|c8 ignore|v8 ignore|ts-(?:ignore|expect-error|nocheck)|biome-|deno-|webpack|globals? |noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|pragma|fmt:|yapf|isort|black|nosec|rubocop|frozen_string_literal|(?:-\*-\s*)?(?:en)?coding[:=]|go:|\+build|nolint|lint:|clang-|NOLINT|IWYU|noinspection|NOSONAR|checkstyle|CHECKSTYLE|SuppressWarnings|#?(?:end)?region|spell-?checker|cspell|sourceMappingURL|rustfmt|clippy|cov(?:erage)?:|codespell|sorbet|typed:|steep:|language=|vim:|jscpd|sonar|@formatter|formatter:)",
)
_REMINDER = re.compile(r"\s*(?:TODO|FIXME|XXX|HACK|WIP|TBD|TBC|BUG|OPTIMI[SZ]E|REVIEW|todo|fixme|Todo|Fixme)\b")
_PLACEHOLDER = re.compile(
    r"\s*(?:placeholder|descriptions?|summary|documentation|docs?|docstring|undocumented|comment|n/?a|none|null|empty|missing|tbd|tba|unknown|untitled|no (?:description|documentation|docs|comment)s?(?: (?:yet|available|provided|given|here))?|(?:add|write|insert|put|your|fill in|enter) (?:a |the |your |some )?(?:description|documentation|docs?|comment|text)s?(?: (?:here|later))?|to be (?:written|done|documented|added|completed)|(?:not|never) documented(?: yet)?|coming soon|lorem ipsum.*|see above|see below|same as above|self[- ]explanatory|auto-?generated (?:method|function|constructor)? ?stub|method stub|stub|missing docs?|missing documentation|foo|bar|xxx+|asdf|\?+|\.+|…+|-+)\s*[.!?:…]*\s*$",
    re.I,
)
_SEPARATOR = re.compile(r"\s*(?:[^\w\s]{3,}.*[^\w\s]{3,}|[^\w]*)\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ]")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_HEAD_END = re.compile(r"[:)]\s*(?:#.*)?$|:\s*[\"'rRuU]")
_ARTICLES = frozenset("a an the".split())


def clean(comment: str) -> list[str]:
    """The lines of a comment or docstring without comment marks."""
    text = comment.replace("\r\n", "\n").strip()
    for quote in ('"""', "'''"):
        begin = re.match(r"[rRuUbBfF]{0,2}" + quote, text)
        if begin and text.endswith(quote) and len(text) >= begin.end() + 3:
            text = text[begin.end() : -3]
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"\s*\*+/\s*$", "", line)
        lines.append(re.sub(r"^\s*(?:/\*+!?|//+!?|#+!?(?!\[)|\*+(?=\s|$|[^*/]))?", "", line, count=1).strip())
    return lines


def prose(comment: str | None, name: str | None) -> tuple[int, int]:
    """Words of prose and Han or kana characters that a comment has left, as the module's rules say."""
    if not comment or comment.isspace():
        return 0, 0
    own = {x.lower() for x in _NAME_PART.findall(name or "")} | ({(name or "").lower()} if name else set())
    own |= {x + "s" for x in own} | {x + "es" for x in own if x.endswith(("s", "x", "z", "ch", "sh"))}
    words = han = 0
    low = name.lower() if name else ""
    odd = bool(name) and not name.isalpha()
    for line in clean(comment):
        if low and line[: len(low)].lower() == low:  # "name: text"
            rest = line[len(low) :].removeprefix("()").lstrip()
            if not rest or rest[0] in ":-–—":
                line = rest[1:].lstrip()
        if not line or line[0] == "@" or line[0] == "\\" or _DIRECTIVE.match(line) or _REMINDER.match(line) or _PLACEHOLDER.match(line) or _SEPARATOR.match(line):
            continue
        line = re.split(r"\s(?:TODO|FIXME|XXX|HACK)\b", line, maxsplit=1)[0]
        if odd and name in line:
            line = line.replace(name, " ")
        if "_" in line:
            line = re.sub(r"\w*_\w*", lambda m: " " if {x.lower() for x in _NAME_PART.findall(m[0])} <= own else m[0], line)
        if not line.isascii():
            han += len(_HAN.findall(line))
            line = _HAN.sub(" ", line)
        for w in _WORD.findall(line):
            w = w.lower()
            if w not in _ARTICLES and w not in own:
                words += 1
    return words, han


class FirstAtMost:
    """Finds the first value at or after a place that is at most a bound, by minima over growing stretches."""

    WIDTH = 16

    def __init__(self, values: list[int]) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > self.WIDTH:
            below = self.levels[-1]
            self.levels.append([min(below[k : k + self.WIDTH]) for k in range(0, len(below), self.WIDTH)])

    def find(self, at: int, most: int) -> int:
        """The index, or the number of values where there is none."""
        level, w = 0, self.WIDTH
        while True:
            row = self.levels[level]
            end = len(row) if level == len(self.levels) - 1 else min(len(row), (at // w + 1) * w)
            hit = next((k for k in range(at, end) if row[k] <= most), -1)
            if hit >= 0:
                break
            if end == len(row):
                return len(self.levels[0])
            at, level = end // w, level + 1
        while level:  # the stretch that holds it, then the place in it
            level -= 1
            row = self.levels[level]
            hit = next(k for k in range(hit * w, len(row)) if row[k] <= most)
        return hit


class SourceLines:
    """What the state machine saw in each line of a file (from 1)."""

    def __init__(self, text: str, language: str) -> None:
        self.lines = text.split("\n")
        count = len(self.lines) + 2
        self.language = language
        self.comment: dict[int, tuple[str, int]] = {}  # last line of a comment -> (its text, its first line)
        self.first: list[str] = [""] * count  # first code token
        self.second: list[str] = [""] * count
        self.net: list[int] = [0] * count  # opened minus closed brackets
        self.braces: list[tuple[int, int]] = []  # line and +1 or -1
        self.strings: list[tuple[int, str]] = []  # Python string tokens that may be docstrings
        hashes = language in ("python", "ruby")
        number, previous = 1, ""
        for x in lexing.tokens(text, language):
            c = x[0]
            if c == "\n" and (language != "ruby" or x.isspace() or x.startswith("\n__END__")):
                number += x.count("\n")
                previous = "\n"
                continue
            if c == "#" if hashes else x.startswith(("//", "/*")):
                last = number + x.count("\n")
                self.comment[last] = (x, number)
                number = last
                continue
            if c == "\n":  # Ruby block comment or a regular expression that begins its line
                inner = x.lstrip("\n")
                number += len(x) - len(inner)
                if inner.startswith("=begin"):
                    last = number + inner.count("\n")
                    self.comment[last] = (inner[6:].rsplit("=end", 1)[0], number)
                    number = last
                    continue
                x, c = inner.strip() or " ", (inner.strip() or " ")[0]
            if not self.first[number]:
                self.first[number] = x
            elif not self.second[number]:
                self.second[number] = x
            if c in "([{" and len(x) == 1:
                self.net[number] += 1
                if c == "{":
                    self.braces.append((number, 1))
            elif c in ")]}" and len(x) == 1:
                self.net[number] -= 1
                if c == "}":
                    self.braces.append((number, -1))
            elif language == "python" and x[-1] in "\"'" and len(x) > 1 and previous in ("\n", ":"):
                self.strings.append((number, x))
            elif x[0] in "([{=,:" and len(x) > 1:  # an operator with a regular expression
                self.net[number] += c in "([{"
                if c == "{":
                    self.braces.append((number, 1))
            previous = x
            if "\n" in x:
                number += x.count("\n")
        self.brace_lines = [line for line, _ in self.braces]
        self.string_lines = [line for line, _ in self.strings]
        self.partner = [-1] * len(self.braces)  # of each opening brace
        opened: list[int] = []
        for i, (_, step) in enumerate(self.braces):
            if step > 0:
                opened.append(i)
            elif opened:
                self.partner[opened.pop()] = i
        self.depth = [0]  # brackets open after each line
        for n in self.net[1:]:
            self.depth.append(self.depth[-1] + n)
        self._lower: FirstAtMost | None = None
        self._heads: tuple[list[int], FirstAtMost] | None = None

    def block_end(self, start: int) -> int:
        """The line of the bracket that closes the first block opened at or after ``start``; 0 if there is none."""
        i = bisect_left(self.brace_lines, start)
        if i == len(self.braces) or self.braces[i][1] < 0 or self.partner[i] < 0:
            return 0
        return self.brace_lines[self.partner[i]]

    def _opening_line(self, line: int) -> int:
        """The last line up to ``line`` with which the brackets of the lines between are balanced; 1 if there is none."""
        if self.net[line] >= 0:
            return line
        if self._lower is None:
            self._lower = FirstAtMost(self.depth[::-1])
        n = len(self.depth)
        return max(1, n - self._lower.find(n - line, self.depth[line]))

    def _head_ends(self) -> tuple[list[int], FirstAtMost]:
        """The lines that may end the head of a Python definition, and the brackets open after each."""
        if self._heads is None:
            lines = [k for k, code in enumerate(self.lines, 1) if _HEAD_END.search(code.rstrip("\r")) and not self.first[k].startswith("@")]
            self._heads = lines, FirstAtMost([self.depth[k] for k in lines])
        return self._heads

    def _is_comment_line(self, line: int) -> bool:
        found = self.comment.get(line)
        return bool(found) and not any(self.first[k] for k in range(found[1], line + 1))

    def comment_above(self, start: int) -> str:
        """The comment directly above a definition, '' if there is none."""
        if start > len(self.lines):  # the text is shorter than its nodes say
            return ""
        pieces: list[str] = []
        line = start - 1
        while line >= 1:
            if self._is_comment_line(line):
                pieces.append(self.comment[line][0])
                line = self.comment[line][1] - 1
                continue
            if pieces:
                break
            # an annotation may span lines: climb to the line that opens its brackets
            top = self._opening_line(line)
            first = self.first[top]
            if first == "@" or first.startswith("@") or self.language == "rust" and first == "#" and self.second[top] in ("[", "!"):
                line = top - 1
                continue
            break
        return "\n".join(reversed(pieces))

    def docstring(self, start: int, end: int) -> str:
        """The string that is the first statement of a Python function."""
        if not 1 <= start <= len(self.lines):
            return ""
        limit = max(start, min(end or start, len(self.lines)))
        heads, open_after = self._head_ends()
        at = open_after.find(bisect_left(heads, start if self.first[start] else start + 1), self.depth[start - 1]) if heads else 0
        if at >= len(heads):
            return ""
        line = heads[at]
        # decorated definitions start at their decorator or at the def itself
        for i in range(bisect_left(self.string_lines, line), len(self.strings)):
            number, string = self.strings[i]
            if number == line and self.first[number] != string or number > line:
                if number <= max(limit, line) and not any(self.first[k] for k in range(line + 1, number)) and (number == line or self.first[number] == string):
                    return string
                return ""
        return ""


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {x.split()[0]: [] for x in SCHEMA.split(", ")}
        texts = b.column("text")
        for i, nodes in enumerate(b.column("nodes").to_pylist()):
            text = texts[i].as_py()
            seen: SourceLines | None = None
            for n in nodes or ():
                language, start, end = n["language"], n["start_line"], n["end_line"]
                known = text is not None and language in lexing.PATTERNS and start is not None
                if known and (seen is None or seen.language != language):
                    seen = SourceLines(text, language)
                code, delimited, doc, origin = None, None, n["docstring"], "nodes"
                if known:
                    block = seen.block_end(start) if language not in ("python", "ruby") else 0
                    last = end if end is not None and end >= start else block or start
                    delimited = (block == last) if block else None
                    code = "\n".join(seen.lines[start - 1 : last]) if start >= 1 else None
                if (not doc or doc.isspace()) and known:
                    doc = seen.docstring(start, end) if language == "python" else seen.comment_above(start)
                    origin = "text"
                words, han = prose(doc, n["name"])
                enough = words >= MIN_WORDS or han >= MIN_HAN
                for key, value in zip(out, (n["id"], n["kind"], n["name"], language, n["signature"], code, delimited, "\n".join(clean(doc)).strip() if enough else None, origin if enough else None, max(words, han // 2)), strict=True):
                    out[key].append(value)
        types = [pa.string()] * 6 + [pa.bool_(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def current_functions(nodes: DataFrame) -> DataFrame:
    """The counting row of each function or method id."""
    fields = ["kind", "name", "file_path", "language", "start_line", "end_line", "docstring", "signature"]
    filled = F.coalesce(F.length(F.trim("docstring")), F.lit(0))
    newest = F.max_by(F.struct(*fields), F.struct("updated_at", filled, F.coalesce("docstring", F.lit("")), F.coalesce("signature", F.lit("")), F.coalesce("start_line", F.lit(-1)), F.coalesce("file_path", F.lit(""))))
    return nodes.where("id IS NOT NULL").groupBy("id").agg(newest.alias("n")).select("id", "n.*").where("kind IN ('function', 'method')")


def documented_functions(nodes: DataFrame, source_texts: DataFrame) -> DataFrame:
    """``id, kind, name, language, signature, code, delimited, documentation, documentation_from, prose_words`` of each
    function or method whose documentation says something."""
    inner = ["id", "kind", "name", "language", "start_line", "end_line", "docstring", "signature"]
    # one file's functions form one row, so that its text travels and is lexed once.  A path with very many rows, and the rows
    # without a path, are dealt out by their ids, so that no list grows without bound
    crowded = nodes.where("file_path IS NOT NULL").groupBy("file_path").agg(F.ceil(F.count("*") / F.lit(FILE_FUNCTIONS)).alias("parts")).where("parts > 1")
    dealt = F.when(F.col("file_path").isNull(), F.xxhash64("id")).otherwise(F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    functions = current_functions(nodes).join(crowded, "file_path", "left").withColumn("part", dealt)
    per_file = functions.groupBy("file_path", "part").agg(F.collect_list(F.struct(*inner)).alias("nodes"))
    texts = source_texts.where("path IS NOT NULL").select(F.col("path").alias("file_path"), "text").repartition("file_path")
    pairs = bounded_batches(per_file.join(texts, "file_path", "left").select("text", "nodes")).mapInArrow(_pair, SCHEMA)
    return pairs.where("documentation IS NOT NULL")
