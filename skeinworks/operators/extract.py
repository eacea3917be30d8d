"""Extraction of definitions, calls, imports and heritage from source files.

One row per file goes in, one row with four arrays of structs comes out; Spark
spreads the files, the per-file code below is a small table-driven walk.  Python
is read with the interpreter's own parser where it parses; everything else, and
broken Python, by a scope-tracking walk over lexer tokens.  The extension point is
:func:`extracted`: any callable may serve a language, a new one or one of these.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import KEYWORDS, PATTERNS, QUOTED
from ..session import bounded_batches, spread

# File extensions of the supported languages.
EXTENSIONS = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python", ".pyi": "python", ".go": "go", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp", ".php": "php", ".rs": "rust", ".rb": "ruby", ".zig": "zig", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".dart": "dart", ".scala": "scala", ".sc": "scala"}
#: Lexer tables that serve more than one language.
LEXERS = {"tsx": "typescript", "jsx": "javascript", "cpp": "c", "csharp": "java", "kotlin": "java", "scala": "java", "swift": "java", "dart": "quoted", "php": "quoted", "zig": "c"}
_LEXERS = PATTERNS | {"quoted": QUOTED}

DEFINITION = "key string, parent_key string, kind string, name string, container array<string>, start_line int, end_line int, start_column int, end_column int, is_exported boolean, is_async boolean, is_static boolean, decorators array<string>"
CALL = "caller_key string, callee_name string, line int, col int, is_member_call boolean"
IMPORT = "ord int, local_name string, imported_name string, specifier string"
HERITAGE = "source_key string, target_name string, relation string"
SCHEMA = f"path string, language string, definitions array<struct<{DEFINITION.replace(' ', ':').replace(',:', ',')}>>, calls array<struct<{CALL.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>, heritage array<struct<{HERITAGE.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Extraction:
    definitions: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    heritage: list[dict] = field(default_factory=list)

    def define(self, kind: str, name: str, start: tuple[int, int], end: tuple[int, int], scope: list[Scope], **flags: object) -> str:
        key = f"{start[0]}:{start[1]}"
        named = [s for s in scope if s.key]
        self.definitions.append({"key": key, "parent_key": named[-1].key if named else None, "kind": kind, "name": name, "container": [s.name for s in named], "start_line": start[0], "end_line": end[0], "start_column": start[1], "end_column": end[1], "is_exported": False, "is_async": False, "is_static": False, "decorators": []} | flags)
        return key

    def call(self, scope: list[Scope], name: str, at: tuple[int, int], member: bool) -> None:
        key = next((s.key for s in reversed(scope) if s.key), None)
        self.calls.append({"caller_key": key, "callee_name": name, "line": at[0], "col": at[1], "is_member_call": member})

    def bind(self, local: str, imported: str, specifier: str) -> None:
        self.imports.append({"ord": len(self.imports), "local_name": local, "imported_name": imported, "specifier": specifier})


@dataclass
class Scope:
    key: str | None
    name: str
    sort: str  # class, module or other
    depth: int
    definition: dict | None = None


# -- Python ----------------------------------------------------------------
def python_ast(text: str) -> Extraction:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out = Extraction()
    lines = text.split("\n")
    ascii_only = text.isascii()

    def column(line: int, offset: int) -> int:
        """The interpreter counts UTF-8 bytes; the graph counts characters."""
        return offset if ascii_only else len(lines[line - 1].encode()[:offset].decode(errors="replace"))

    def place(node: ast.AST) -> tuple[tuple[int, int], tuple[int, int]]:
        return (node.lineno, column(node.lineno, node.col_offset)), (node.end_lineno, column(node.end_lineno, node.end_col_offset))

    def visit(node: ast.AST, scope: list[Scope]) -> None:
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start, end = place(node)
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if scope and scope[-1].sort == "class" else "function"
            key = out.define(kind, node.name, start, end, scope, is_async=isinstance(node, ast.AsyncFunctionDef), decorators=[ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list])
            if is_class:
                out.heritage += [{"source_key": key, "target_name": b.id, "relation": "extends"} for b in node.bases if isinstance(b, ast.Name)]
            inner = [*scope, Scope(key, node.name, "class" if is_class else "other", 0)]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and (not scope or scope[-1].sort == "class"):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if len(targets) == 1 and isinstance(targets[0], ast.Name):
                out.define("field" if scope else "variable", targets[0].id, *place(node), scope)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, (ast.Name, ast.Attribute)):
                out.call(scope, f.id if isinstance(f, ast.Name) else f.attr, place(node)[0], isinstance(f, ast.Attribute))
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.bind(a.asname or a.name.split(".")[0], "*", a.name)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.bind(a.asname or a.name, a.name, "." * node.level + (node.module or ""))
        for child in ast.iter_child_nodes(node):
            visit(child, inner)

    visit(tree, [])
    return out


# -- token walk for the other languages ------------------------------------
_CLASS_WORDS = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "union": "struct", "record": "class", "module": "namespace", "namespace": "namespace", "mod": "namespace", "object": "class", "protocol": "interface", "mixin": "class", "extension": "class"}
_SCOPE_OF = {"class": "class", "struct": "class", "interface": "class", "trait": "class", "enum": "class", "namespace": "module"}
_FUNCTION_WORDS = {"function", "func", "fn", "fun", "def"}
# what stands before a bracket without being called, in languages that borrow another's lexer
_NOT_CALLED = frozenset("if for while switch catch return function sizeof await foreach lock using when elif match guard".split())
_MEMBER = frozenset([".", "->", "::", "?.", "&."])
_TYPED = frozenset(["java", "c", "cpp", "csharp", "dart"])
#: Words that borrowed lexers do not reserve, and that name nothing.
_RESERVED = {
    "kotlin": "fun val var object when is in as typealias companion data sealed open internal inline override by constructor init",
    "scala": "def val var object trait extends with override lazy implicit type match case given using yield",
    "swift": "func var let protocol extension guard in is as init deinit inout where defer override mutating",
    "php": "function fn use trait namespace echo array list foreach as match readonly",
    "csharp": "using namespace get set override virtual readonly string bool object var foreach in is as lock async await params out ref internal sealed partial where",
    "dart": "import library part mixin extends implements with late required factory get set operator as is in async await show hide",
    "cpp": "class public private protected virtual override final template typename namespace using new delete operator noexcept constexpr explicit friend this throw try catch mutable",
    "zig": "fn pub var comptime test usingnamespace try catch orelse and or defer errdefer align error anytype",
}
#: Before or after these a line break does not end a declaration's head.
_CONTINUES = frozenset("{ ( , : = . with extends implements where -> & |".split())
_JS = frozenset(["javascript", "typescript", "jsx", "tsx"])


@dataclass(slots=True)
class Token:
    text: str
    line: int
    column: int


def lex(text: str, language: str) -> list[Token]:
    """Tokens with their places; comments are left out, line breaks kept."""
    hashes = language in ("python", "ruby")
    out, line, begin = [], 1, 0
    for m in _LEXERS[LEXERS.get(language, language)].finditer(text):
        x, at = m[1], m.start(1)
        comment = x[0] == "#" if hashes else x.startswith(("//", "/*")) or language == "php" and x[0] == "#" or language in ("c", "cpp") and x == "\\\n"
        if not comment:
            out.append(Token(x if not x.isspace() else "\n", line, at - begin))
        breaks = x.count("\n")
        if breaks:
            line += breaks
            begin = at + x.rindex("\n") + 1
    return out


def _match(tokens: list[Token]) -> dict[int, int]:
    """Index of each bracket's partner, as far as they pair."""
    stack, found = [], {}
    close = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.text in "([{" and len(t.text) == 1:
            stack.append(i)
        elif t.text in close:
            while stack and tokens[stack[-1]].text != close[t.text]:
                stack.pop()
            if stack:
                found[stack[-1]] = i
                found[i] = stack.pop()
    return found


_METHOD_HEAD = frozenset("async static get set public private protected readonly override * abstract".split())
_FIELD_HEAD = frozenset("static public private protected readonly declare abstract".split())
_TOLD = _METHOD_HEAD | _FIELD_HEAD | frozenset("= ( ) , . return new pub crate class struct enum interface record namespace".split())


def _statements(texts: list[str]) -> tuple[list[int], list[frozenset[str]]]:
    """For each token, where its statement begins, and the words before it in the statement; those that no rule asks for are
    told as one.  One pass, however long a statement is."""
    begins, heads, begin, head = [], [], 0, frozenset()
    nothing = head
    for k, x in enumerate(texts):
        begins.append(begin)
        heads.append(head)
        if x in ("\n", ";", "{", "}"):
            begin, head = k + 1, nothing
        else:
            word = x if x in _TOLD else "other"
            if word not in head:
                head = head | {word}
    return begins, heads


_NAME = re.compile(r"[^\W\d][\w$]*[?!]?$|\$[\w$]+$")


def token_walk(text: str, language: str) -> Extraction:  # noqa: C901, PLR0912, PLR0915
    """The lexical extractor: declaration words, bracket scopes and the place before a call's bracket."""
    if language in ("c", "cpp"):
        text = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.)*", lambda m: " " * len(m[0]) if "include" not in m[0] else m[0], text)
    out, tokens = Extraction(), lex(text, language)
    pair = _match(tokens)
    words = set(KEYWORDS.get({"quoted": "java"}.get(LEXERS.get(language, ""), LEXERS.get(language, language)), "").split()) | set(_RESERVED.get(language, "").split())
    ruby, js, open_ended = language == "ruby", language in _JS, language in ("kotlin", "scala", "swift")
    scope: list[Scope] = []
    until: list[int] = []  # token index at which each scope ends
    chain: dict[int, int] = {}  # name of a call -> where its chain of members begins
    ends = _ruby_ends(tokens) if ruby else {}
    n, i = len(tokens), 0

    texts = [x.text for x in tokens]
    begins, heads = _statements(texts)

    def txt(k: int) -> str:
        return texts[k] if 0 <= k < n else ""

    def name_at(k: int) -> bool:
        return bool(_NAME.match(txt(k))) and (txt(k) not in words or js and txt(k) in ("get", "set", "of", "from", "type", "static", "async", "as"))

    def body(k: int) -> int:
        """The opening brace of a declaration's body after token k, -1 if a terminator comes first."""
        while k < n and txt(k) not in ("{", ";"):
            if txt(k) == "\n" and open_ended and txt(k + 1) not in _CONTINUES and txt(k - 1) not in _CONTINUES:
                return -1
            if txt(k) == "\n" and js and txt(k + 1) not in ("{",) and txt(k - 1) not in (",", "(", "|", "&", ":", "=>"):
                return -1
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[") else k + 1
        return k if txt(k) == "{" else -1

    def place(k: int) -> tuple[int, int]:
        return tokens[k].line, tokens[k].column

    def stop(k: int) -> tuple[int, int]:
        k = min(k, n - 1)
        return tokens[k].line, tokens[k].column + len(tokens[k].text)

    def line_end(k: int) -> int:
        while k < n and txt(k) not in ("\n", ";"):
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
        return k if txt(k) == ";" else k - 1

    def open_scope(key: str, name: str, sort: str, end: int) -> None:
        scope.append(Scope(key, name, sort, len(until)))
        until.append(end)

    def declare(kind: str, at: int, start: int, finish: int, sort: str | None) -> str:
        head = [txt(k) for k in range(start, at)]
        flags = {"is_async": "async" in head or js and "async" in [txt(at + 2)], "is_static": "static" in head, "is_exported": _exported(language, txt(at), head, scope)}
        while language in ("java", "csharp", "kotlin", "scala") and txt(start - 1) == "\n" and txt(begins[start - 1]) == "@":
            start = begins[start - 1]  # annotations on lines of their own
        name = "~" + txt(at) if language == "cpp" and txt(at - 1) == "~" else txt(at)
        key = out.define(kind, name, place(start), stop(finish), scope, **flags)
        if sort:
            open_scope(key, name, sort, finish)
        return key

    while i < n:
        while until and i > until[-1]:
            until.pop()
            scope.pop()
        t, here = txt(i), scope[-1].sort if scope else "module"
        if t == "\n":
            i += 1
            continue
        # imports
        step = _imports(out, tokens, i, language, txt, line_end)
        if step:
            i = step
            continue
        start = begins[i]
        step = _declared_value(language, i, start, here, txt, name_at, line_end, body, pair, declare, out, scope, heads[i], place, stop)
        if step:
            i = step
            continue
        if t in _CLASS_WORDS and name_at(i + 1) and txt(i - 1) not in (".", "::", "new") and not (language == "go" or language in ("c", "cpp") and txt(i + 2) not in ("{", ":")) and not (js and t in ("module", "namespace", "record", "object", "extension", "struct", "union", "mixin", "protocol", "trait")):
            kind = "enum" if language == "kotlin" and "enum" in [txt(k) for k in range(start, i)] else _CLASS_WORDS[t]
            opening = ends.get(i, -1) if ruby else body(i + 1)
            if opening >= 0:
                finish = ends[i] if ruby else pair.get(opening, n - 1)
                key = declare(kind, i + 1, start, finish, _SCOPE_OF.get(kind, "class"))
                _bases(out, tokens, key, i + 2, (opening if not ruby else i + 6), txt, language)
                i = (opening + 1) if not ruby else i + 2
                if kind == "enum" and language not in ("php", "swift"):
                    _enum_members(out, tokens, opening + 1, finish, pair, scope, txt, place, stop)
                if language == "scala" and txt(i if ruby else opening) == "{":
                    _parameters(opening, start, txt, pair, name_at, declare)
                continue
            if language in ("kotlin", "scala") and opening < 0:  # a class without a body
                finish = line_end(i)
                key = declare(kind, i + 1, start, finish, None)
                _bases(out, tokens, key, i + 2, finish + 1, txt, language)
                i += 2
                continue
            if language == "rust" or js:
                declare(kind, i + 1, start, line_end(i), None)
                i += 2
                continue
        if t == "type" and name_at(i + 1) and (js and txt(i + 2) in ("=", "<") or language in ("go", "rust")) and start >= i - 2:
            finish = line_end(i)
            key = declare("type_alias", i + 1, start, finish, None)
            if language == "go" and txt(i + 2) in ("struct", "interface") and txt(i + 3) == "{":
                open_scope(key, txt(i + 1), "class", pair.get(i + 3, n - 1))
                i += 4
                continue
            i += 2
            continue
        if language == "rust" and t == "impl":
            opening = body(i)
            if opening >= 0:
                named = [txt(k) for k in range(i, opening) if name_at(k)]
                scope.append(Scope(None, named[-1] if named else "", "class", len(until)))
                until.append(pair.get(opening, n - 1))
                i = opening + 1
                continue
        if t in _FUNCTION_WORDS and txt(i - 1) not in (".", "::"):
            k = i + 1
            if language == "go" and txt(k) == "(" and name_at(pair.get(k, k) + 1):
                at, kind = pair[k] + 1, "method"
            else:
                k += txt(k) == "*"
                if ruby and txt(k) == "self" and txt(k + 1) == ".":
                    k += 2
                at, kind = k, "method" if here == "class" or ruby else "function"
            if (name_at(at) or ruby and txt(at)) and (txt(at + 1) in ("(", "<", "[") or ruby):
                opening = ends.get(i, -1) if ruby else body(at)
                finish = opening if ruby else pair.get(opening, n - 1) if opening >= 0 else line_end(at)
                declare(kind, at, start if not ruby else i, finish if finish >= 0 else i, "other" if finish > i else None)
                i = at + 1
                continue
        if js and t in ("const", "let", "var") and name_at(i + 1) and txt(i - 1) != "(":
            finish, k = line_end(i), i + 2
            while k < finish and txt(k) not in ("=",):
                k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{", "<") else k + 1
            v = k + 1 + (txt(k + 1) == "async")
            arrow = txt(v) == "function" or txt(v) == "(" and _arrow_after(pair.get(v, v) + 1, txt, n, pair) or name_at(v) and txt(v + 1) == "=>"
            if arrow:
                declare("function", i + 1, start, finish, "other")
            elif here in ("module", "class"):
                declare("variable", i + 1, start, finish, None)
            i = k if k < finish else i + 2
            continue
        if language in ("rust", "go") and t in ("const", "static", "var") and name_at(i + 1 + (txt(i + 1) == "mut")) and here in ("module", "class"):
            at = i + 1 + (txt(i + 1) == "mut")
            declare("constant" if t == "const" else "variable", at, at if language == "go" else start, line_end(at), None)
            i = at + 1
            continue
        if ruby and re.match(r"[A-Z]\w*$", t) and txt(i + 1) == "=" and start == i:
            declare("constant", i, i, line_end(i), None)
        elif ruby and here == "module" and start == i and name_at(i) and txt(i + 1) == "=" and not scope:
            declare("variable", i, i, line_end(i), None)
        if name_at(i) and here == "class" and not ruby and (js or language in _TYPED or language in ("go", "rust")):
            head, after = heads[i], txt(i + 1)
            if after == "(" and (language != "go") and language != "rust":
                opening = body(pair.get(i + 1, i + 1))
                if opening < 0 and language == "cpp" and (head or txt(i - 1) == "~" or t == scope[-1].name) and not {"=", "return", "new", ".", "(", ","} & head:
                    declare("method", i, start, line_end(i), None)  # declared here, defined elsewhere
                    i = line_end(i) + 1
                    continue
                if opening >= 0 and (js and head <= _METHOD_HEAD or language in _TYPED and not {"=", "return", "new", "."} & head):
                    begin = start
                    declare("method", i, begin, pair.get(opening, n - 1), "other")
                    i += 1
                    continue
            elif js and head <= _FIELD_HEAD and after in ("=", ":", ";", "\n", "?", "!"):
                finish = line_end(i)
                declare("field", i, start, finish, None)
                i = finish + 1
                continue
            elif language in _TYPED and head and not {"=", "(", "return", "."} & head and after in ("=", ";", "[", ",") and txt(i - 1) not in (",",):
                finish = line_end(i)
                declare("field", i, start, finish, None)
                i = finish + 1
                continue
            elif language == "go" and start == i and after not in ("(", ".", ",", "\n", "}"):
                finish = line_end(i)
                declare("field", i, i, finish, None)
                i = finish + 1
                continue
            elif language == "rust" and after == ":" and scope[-1].key and head <= {"pub", "crate", "(", ")"}:
                k = i + 2
                while k < until[-1] and txt(k) != ",":
                    k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
                declare("field", i, start, k - 1, None)
                i = k + 1
                continue
        if language in ("c", "cpp") and here == "module" and name_at(i) and txt(i + 1) == "(" and start < i and not {"=", "return"} & heads[i]:
            opening = body(pair.get(i + 1, i + 1))
            if opening >= 0:
                declare("function", i, start, pair.get(opening, n - 1), "other")
                i += 1
                continue
        if language in ("c", "cpp") and not scope and name_at(i) and start < i and txt(i + 1) in ("=", ";", "[") and txt(start) not in ("struct", "union", "enum", "typedef", "return") and "(" not in heads[i]:
            finish = line_end(i)
            declare("variable", i, start, finish, None)
            i = finish + 1
            continue
        # calls
        if name_at(i) and t not in _NOT_CALLED and (txt(i + 1) == "(" or js and txt(i + 1) == "<" and _generic_call(i + 1, txt, n) or language == "rust" and txt(i + 1) == "!" and False):
            member = txt(i - 1) in _MEMBER
            first = i
            while first not in chain and txt(first - 1) in _MEMBER and first >= 2:
                first -= 2
                while txt(first) in (")", "]") and first in pair:
                    first = pair[first] - 1
            first = chain[i] = chain.get(first, first)
            if txt(i - 1) not in ("new", "~", "@") and language != "dart":
                out.call(scope, t, place(max(first, 0)), member)
        i += 1
    if js:
        exported = _common_js(txt, n, pair)
        for d in out.definitions:
            if not d["container"] and d["name"] in exported:
                d["is_exported"] = True
    return out


def _common_js(txt: Callable[[int], str], n: int, pair: dict[int, int]) -> set[str]:
    """Names that top-level statements export: ``exports.X =``, ``module.exports.X =`` and ``module.exports = X``."""
    found, k, fresh = set(), 0, True
    while k < n:
        if fresh and txt(k) in ("module", "exports"):
            at = k + 2 if txt(k) == "module" and txt(k + 1) == "." and txt(k + 2) == "exports" else k
            if txt(at) == "exports" and txt(at + 1) == "." and txt(at + 3) == "=":
                found.add(txt(at + 2))
            elif at > k and txt(at + 1) == "=" and _NAME.match(txt(at + 2)) and txt(at + 3) in ("\n", ";", ""):
                found.add(txt(at + 2))
        fresh = txt(k) in ("\n", ";")
        k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
    return found


def _declared_value(language: str, i: int, start: int, here: str, txt: Callable, name_at: Callable, line_end: Callable, body: Callable, pair: dict[int, int], declare: Callable, out: Extraction, scope: list[Scope], head: frozenset[str], place: Callable, stop: Callable) -> int:
    """Fields, constants, properties and values of the languages that borrow a lexer; the index after one, or 0."""
    t = txt(i)
    if here == "other":
        return 0
    if language == "zig" and t in ("const", "var") and name_at(i + 1):
        k = i + 2
        while txt(k) not in ("=", ";", ""):
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
        value = k + 1 + (txt(k + 1) in ("extern", "packed"))
        if txt(k) == "=" and txt(value) in ("struct", "union", "enum"):
            opening = body(value)
            if opening >= 0:
                kind, finish = "enum" if txt(value) == "enum" else "struct", pair.get(opening, opening)
                declare(kind, i + 1, start, finish, "class")
                if kind == "enum":
                    _enum_members(out, [], opening + 1, finish, pair, scope, txt, place, stop)
                return opening + 1
        if txt(value) == "@" and txt(value + 1) == "import" and txt(value + 3)[:1] == '"':
            out.bind(txt(i + 1), "*", txt(value + 3).strip('"'))
        finish = line_end(i)
        declare("variable" if t == "var" else "constant", i + 1, start, finish, None)
        return k if txt(k) == "=" else finish + 1
    if language == "zig" and here == "class" and name_at(i) and txt(i + 1) == ":" and txt(i - 1) in ("{", ",", "\n"):
        k = i + 2
        while txt(k) not in (",", "}", "", ";"):
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
        declare("field", i, i, k - 1, None)
        return k
    if language in ("scala", "swift") and t in ("val", "var", "let") and name_at(i + 1):
        finish = line_end(i)
        fixed = "variable" if t == "var" else "constant"
        declare("field" if here == "class" else fixed, i + 1, start, finish, None)
        return i + 2
    if language == "php" and t == "$" and here == "class" and start < i and _NAME.match(txt(i + 1)) and txt(i + 2) in ("=", ";", ",") and "(" not in head:
        declare("field", i + 1, start, line_end(i), None)
        return line_end(i) + 1
    if language == "php" and t == "const" and _NAME.match(txt(i + 1)):
        at = i + 1 if txt(i + 2) == "=" else i + 2
        declare("constant", at, start, line_end(i), None)
        return line_end(i) + 1
    if language in ("php", "swift") and t == "case" and here == "class":
        k, end = i + 1, line_end(i)
        while k <= end:
            if _NAME.match(txt(k)) and txt(k - 1) in ("case", ","):
                out.define("enum_member", txt(k), place(k), stop(k), scope)
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
        return end + 1
    if language == "csharp" and here == "class" and name_at(i) and start < i and (txt(i + 1) == "{" or txt(i + 1) == "=>") and not {"class", "struct", "enum", "interface", "record", "(", "=", "namespace"} & head:
        finish = pair.get(i + 1, line_end(i)) if txt(i + 1) == "{" else line_end(i)
        declare("property", i, start, finish, None)
        return finish + 1 if txt(i + 1) == "{" else i + 1
    if language in ("c", "cpp") and t == "typedef" and start == i:
        finish = line_end(i)
        at = finish - 1 if txt(finish) == ";" else finish
        if _NAME.match(txt(at)) and txt(at - 1) not in ("typedef", "\n"):
            declare("type_alias", at, start, finish, None)
    return 0


def _parameters(opening: int, start: int, txt: Callable[[int], str], pair: dict[int, int], name_at: Callable, declare: Callable) -> None:
    """The parameters of a Scala class, which are its fields."""
    k = next((k for k in range(start, opening) if txt(k) == "("), opening)
    end = pair.get(k, k)
    while k < end:
        k += 1
        if name_at(k) and txt(k + 1) == ":" and txt(k - 1) in ("(", ",", "val", "var", "\n"):
            begin = k
            while k < end and txt(k) != ",":
                k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
            declare("field", begin, begin, k - 1, None)


def _arrow_after(k: int, txt: Callable[[int], str], n: int, pair: dict[int, int]) -> bool:
    """Whether ``=>`` follows a parameter list, a return type between."""
    if txt(k) == ":":
        while k < n and txt(k) not in ("=>", "\n", ";"):
            k = pair.get(k, k) + 1 if txt(k) in ("(", "[", "{") else k + 1
    return txt(k) == "=>"


def _generic_call(k: int, txt: Callable[[int], str], n: int) -> bool:
    depth = 0
    for j in range(k, min(n, k + 30)):
        depth += (txt(j) == "<") - (txt(j) == ">")
        if depth == 0:
            return txt(j + 1) == "("
        if txt(j) in (";", "{", "\n", "&&", "||"):
            return False
    return False


def _exported(language: str, name: str, head: list[str], scope: list[Scope]) -> bool:
    if language in _JS:
        return "export" in head
    if language == "go":
        return name[:1].isupper()
    if language in ("java", "csharp", "php"):
        return "public" in head
    if language in ("c", "cpp"):
        return not scope and "static" not in head
    if language in ("rust", "zig"):
        return "pub" in head
    if language == "swift":
        return bool({"public", "open"} & set(head))
    if language in ("kotlin", "scala"):
        return not {"private", "protected", "internal"} & set(head)
    return language == "dart" and not name.startswith("_")


def _ruby_ends(tokens: list[Token]) -> dict[int, int]:
    """Index of the ``end`` of each block word."""
    stack, found, fresh = [], {}, True
    for i, t in enumerate(tokens):
        x = t.text
        if x in ("def", "class", "module", "begin", "do", "case") or x in ("if", "unless", "while", "until", "for") and fresh:
            if not (x == "do" and stack and tokens[stack[-1]].text in ("while", "until", "for") and tokens[stack[-1]].line == t.line) and not (i and tokens[i - 1].text == "."):
                stack.append(i)
        elif x == "end" and stack and not (i and tokens[i - 1].text == "."):
            found[stack.pop()] = i
        fresh = x in ("\n", ";", "=", "(", "then", "do", "else", "{", "|")
    return found


#: How the languages write bases after a class's name: words or signs that begin a list of bases, and the relation.
_BASE_WORDS = {"extends": "extends", "<": "extends", ":": "extends", "with": "extends", "implements": "implements"}
_MODIFIERS = frozenset("public private protected virtual".split())


def _bases(out: Extraction, tokens: list[Token], key: str, k: int, end: int, txt: Callable[[int], str], language: str) -> None:
    """Bare base names between a class's name and its body; qualified and generic ones are left out."""
    relation, expected, depth = None, False, 0
    while k < end and txt(k) != "":
        x = txt(k)
        if x in ("(", "["):
            depth += 1
        elif x in (")", "]"):
            depth -= 1
        elif depth or x == "\n" and language != "ruby":
            pass
        elif x in ("{", "\n"):
            return
        elif x in _BASE_WORDS and not (x == "<" and language != "ruby"):
            relation, expected = _BASE_WORDS[x], True
        elif x == "where":
            return
        elif x == "<":  # type parameters
            close, level = k, 0
            while close < end:
                level += (txt(close) == "<") - (txt(close) == ">")
                if not level:
                    break
                close += 1
            k = close
        elif x in (",", "+", "&"):
            expected = relation is not None
        elif expected and x in _MODIFIERS and language == "cpp":
            pass
        elif expected and _NAME.match(x):
            call = txt(k + 1) == "(" and language in ("kotlin", "scala", "csharp")
            if txt(k + 1) not in (".", "::", "<", "[", "\\") and (call or txt(k + 1) != "("):
                out.heritage.append({"source_key": key, "target_name": x, "relation": relation})
            expected = False
        else:
            expected = expected and x == "\\" and language == "php"
        k += 1


def _enum_members(out: Extraction, tokens: list[Token], k: int, end: int, pair: dict[int, int], scope: list[Scope], txt: Callable[[int], str], place: Callable, stop: Callable) -> None:
    fresh = True
    while k < end:
        x = txt(k)
        if fresh and _NAME.match(x):
            out.define("enum_member", x, place(k), stop(k), scope)
            fresh = False
        elif x == ",":
            fresh = True
        elif x == ";":
            return
        k = pair.get(k, k) + 1 if x in ("(", "[", "{") else k + 1


def _imports(out: Extraction, tokens: list[Token], i: int, language: str, txt: Callable[[int], str], line_end: Callable[[int], int]) -> int:  # noqa: C901, PLR0912
    """Reads an import statement at token i; the index after it, or 0."""
    t = txt(i)
    unquote = lambda s: s.strip("\"'`<>")
    if language in _JS:
        if t == "import" and txt(i + 1) not in ("(", "."):
            end, names = i + 1, []
            while txt(end) and not (txt(end)[:1] in "\"'" and len(txt(end)) > 1):
                if txt(end) == ";" or txt(end) == "\n" and txt(end - 1) not in ("import", "from", ",", "}", "{", "type") and "{" not in [txt(j) for j in range(i, end)]:
                    return 0  # the statement ends without a module
                end += 1
            if not txt(end):
                return 0
            spec, k = unquote(txt(end)), i + 1
            while k < end:
                x = txt(k)
                if x == "*" and txt(k + 1) == "as":
                    names.append((txt(k + 2), "*"))
                    k += 2
                elif _NAME.match(x) and x not in ("from", "type", "as"):
                    inside = "{" in [txt(j) for j in range(i, k)]
                    if txt(k + 1) == "as":
                        names.append((txt(k + 2), x))
                        k += 2
                    else:
                        names.append((x, x if inside else "default"))
                k += 1
            for local, imported in names:
                out.bind(local, imported, spec)
            return end + 1
        if t == "require" and txt(i + 1) == "(" and txt(i + 2)[:1] in "\"'" and txt(i - 1) == "=" and _NAME.match(txt(i - 2)):
            out.bind(txt(i - 2), "*", unquote(txt(i + 2)))
        return 0
    if language == "go" and t == "import":
        end = i + 1
        if txt(i + 1) == "(":
            while txt(end) not in (")", ""):
                end += 1
        for k in range(i + 1, end + 2):
            if txt(k)[:1] in "\"`" and len(txt(k)) > 1:
                out.bind(txt(k - 1) if _NAME.match(txt(k - 1)) and txt(k - 1) != "import" else unquote(txt(k)).rsplit("/", 1)[-1], "*", unquote(txt(k)))
        return end + 1
    if language in ("java", "kotlin", "scala") and t == "import" or language == "csharp" and t == "using" and txt(i + 1) != "(" or language == "php" and t == "use" and txt(i - 1) in ("\n", ";", "}", ""):
        end = line_end(i)
        if language == "java" and txt(end) != ";":
            return 0
        for local, imported, spec in _IMPORT_FORMS[language]([txt(k) for k in range(i + 1, end + 1) if txt(k) not in (";", "static", "\n")]):
            out.bind(local, imported, spec)
        return end + 1
    if language == "rust" and t == "use" and txt(i - 1) in ("\n", ";", "}", "", "pub"):
        end = line_end(i)
        path = "".join(txt(k) if txt(k) != "as" else " as " for k in range(i + 1, end + 1)).rstrip(";")
        for local, full in _use_tree(path):
            out.bind(local, full.rsplit("::", 1)[-1], full)
        return end + 1
    if language in ("c", "cpp") and t == "#" and txt(i + 1) == "include":
        end = line_end(i)
        spec = unquote("".join(txt(k) for k in range(i + 2, end + 1)))
        out.bind(spec, "*", spec)
        return end + 1
    if language == "ruby" and t in ("require", "require_relative") and txt(i + 1)[:1] in "\"'" and len(txt(i + 1)) > 1:
        spec = unquote(txt(i + 1))
        out.bind(spec.rsplit("/", 1)[-1], "*", ("./" if t == "require_relative" else "") + spec)
        return i + 2
    if language == "dart" and t == "import":
        out.bind(unquote(txt(i + 1)), "*", unquote(txt(i + 1)))
        return line_end(i) + 1
    if language == "swift" and t == "import":
        out.bind(txt(i + 1), "*", txt(i + 1))
        return line_end(i) + 1
    return 0


def _dotted(parts: list[str]) -> Iterator[tuple[str, str, str]]:
    path = "".join(parts)
    if path:
        yield path.rsplit(".", 1)[-1], path.rsplit(".", 1)[-1], path


def _csharp_using(parts: list[str]) -> Iterator[tuple[str, str, str]]:
    """``using A.B`` and ``using X = A.B``."""
    alias, path = (parts[0], parts[2:]) if "=" in parts[1:2] else (None, parts)
    for local, imported, spec in _dotted(path):
        yield alias or local, imported, spec


def _kotlin_import(parts: list[str]) -> Iterator[tuple[str, str, str]]:
    """``import a.b.c``, ``import a.b.*`` and ``import a.b.c as d``."""
    alias = parts[-1] if "as" in parts[-2:-1] else None
    path = [x for x in (parts[:-2] if alias else parts)]
    if path[-1:] == ["*"]:
        yield "", "*", "".join(path[:-2])
    elif path:
        yield alias or path[-1], path[-1], "".join(path)


def _scala_import(parts: list[str]) -> Iterator[tuple[str, str, str]]:
    """``import a.b.c`` and ``import a.b.{c, d}``; renamed selectors are left out."""
    if "{" not in parts:
        yield from _dotted(parts)
        return
    at = parts.index("{")
    prefix = "".join(parts[:at]).rstrip(".")
    for one in "\0".join(parts[at + 1 : -1] if parts[-1] == "}" else parts[at + 1 :]).split("\0,\0"):
        if _NAME.match(one) and one != "_":
            yield one, one, f"{prefix}.{one}"


def _php_use(parts: list[str]) -> Iterator[tuple[str, str, str]]:
    """``use A\\B, C\\D as E`` and ``use A\\{B, C as D}``; function and const name nothing else."""
    parts = parts[1:] if parts[:1] in (["function"], ["const"]) else parts
    prefix = ""
    if "{" in parts:
        at = parts.index("{")
        prefix = "".join(parts[:at]).rstrip("\\") + "\\"
        parts = [x for x in parts[at + 1 :] if x != "}"]
    clause: list[str] = []
    for x in [*parts, ","]:
        if x != ",":
            clause.append(x)
            continue
        alias = clause[-1] if "as" in clause[-2:-1] else None
        path = "".join(clause[:-2] if alias else clause)
        if path:
            name = path if prefix else path.rsplit("\\", 1)[-1]
            yield alias or name, name, prefix + path
        clause = []


_IMPORT_FORMS: dict[str, Callable[[list[str]], Iterator[tuple[str, str, str]]]] = {"java": _dotted, "csharp": _csharp_using, "kotlin": _kotlin_import, "scala": _scala_import, "php": _php_use}


def _use_tree(path: str) -> Iterator[tuple[str, str]]:
    m = re.match(r"(.*?)(?:::)?\{(.*)\}$", path)
    if m:
        depth, part = 0, ""
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                if part:
                    yield from _use_tree(f"{m[1]}::{part}")
                part = ""
            else:
                part += c
    else:
        full, _, local = path.partition(" as ")
        yield (local or full.rsplit("::", 1)[-1]), full


_PY_HEAD = re.compile(r"([ \t]*)(async\s+)?(def|class)\s+([^\W\d]\w*)")
_PY_VALUE = re.compile(r"([ \t]*)([^\W\d]\w*)\s*(?::[^=]*)?=(?!=)")


_PY_FROM = re.compile(r"from\s+(\.*[\w.]*)\s+import\s+(.+)")
_PY_IMPORT = re.compile(r"import\s+(.+)")


def _python_import(out: Extraction, line: str) -> bool:
    """Binds what an import statement on one line says."""
    line = line.strip()
    origin, plain = _PY_FROM.match(line), _PY_IMPORT.match(line)
    for part in re.split(r"\s*,\s*", re.sub(r"#.*|;.*", "", (origin[2] if origin else plain[1] if plain else "")).strip(" ()\\")):
        named = re.fullmatch(r"([\w.]+|\*)(?:\s+as\s+(\w+))?", part)
        if named and origin:
            out.bind(named[2] or named[1], named[1], origin[1])
        elif named:
            out.bind(named[2] or named[1].split(".")[0], "*", named[1])
    return bool(origin or plain)


def python_lines(text: str) -> Extraction:
    """Broken Python: definitions by their first line and indentation, imports by their line, calls by the place before a bracket."""
    out, scope = Extraction(), []
    lines = text.split("\n")
    inside: dict[int, bool] = {}  # lines that begin within a string token
    for t in lex(text, "python"):
        for k in range(1, t.text.count("\n") + 1 if t.text != "\n" else 1):
            inside[t.line + k] = True
    for number, line in enumerate(lines, 1):
        if not line.strip() or inside.get(number):
            continue
        width = len(line) - len(line.lstrip())
        while scope and width <= scope[-1].depth:
            scope.pop()
        m = _PY_HEAD.match(line)
        value = None if m else _PY_VALUE.match(line)
        if m:
            last = number
            for k in range(number, len(lines)):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= width and not inside.get(k + 1):
                        break
                    last = k + 1
            kind = "class" if m[3] == "class" else "method" if scope and scope[-1].sort == "class" else "function"
            key = out.define(kind, m[4], (number, width), (last, len(lines[last - 1])), scope, is_async=bool(m[2]))
            scope.append(Scope(key, m[4], "class" if kind == "class" else "other", width))
        elif _python_import(out, line):
            continue
        elif value and (not scope or scope[-1].sort == "class"):
            out.define("field" if scope else "variable", value[2], (number, width), (number, len(line)), scope)
        else:
            for c in re.finditer(r"(\.)?\b([^\W\d]\w*)\s*\(", line):
                if c[2] not in KEYWORDS["python"].split():
                    out.call(scope, c[2], (number, c.start(2)), bool(c[1]))
    return out


def python_any(text: str) -> Extraction:
    try:
        return python_ast(text)
    except (SyntaxError, ValueError, RecursionError):
        return python_lines(text)


EXTRACTORS: dict[str, Callable[[str], Extraction]] = {"python": python_any} | {x: (lambda text, x=x: token_walk(text, x)) for x in set(EXTENSIONS.values()) if x != "python"}


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow(fields: str) -> pa.DataType:
    return pa.list_(pa.struct([(name, _ARROW[kind]) for name, kind in (f.split() for f in fields.split(", "))]))


_PARTS = {"definitions": _arrow(DEFINITION), "calls": _arrow(CALL), "imports": _arrow(IMPORT), "heritage": _arrow(HERITAGE)}


def _extract(batches: Iterator[pa.RecordBatch], own: dict[str, Callable[[str], Extraction]]) -> Iterator[pa.RecordBatch]:
    by = EXTRACTORS | own
    for b in batches:
        found = []
        for language, text in zip(b.column("language").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            found.append(by[language](text) if text and language in by else Extraction())
        parts = [pa.array([getattr(e, name) for e in found], kind) for name, kind in _PARTS.items()]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("language"), *parts], names=["path", "language", *_PARTS])


def language_of(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """By the extension, case-sensitive, also by a caller's own ones; NULL for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in (EXTENSIONS | (extensions or {})).items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def extracted(source_texts: DataFrame, extractors: dict[str, Callable[[str], Extraction]] | None = None, extensions: dict[str, str] | None = None) -> DataFrame:
    """``path, language, definitions, calls, imports, heritage`` of every file of a known language; empty arrays for empty texts.

    ``extractors`` (by language) and ``extensions`` (extension to language) are a caller's own; they go to the workers with the
    plan and win over those of this module.
    """
    known = source_texts.where("path IS NOT NULL").select("path", language_of(F.col("path"), extensions).alias("language"), "text").where("language IS NOT NULL")
    return bounded_batches(spread(known)).mapInArrow(partial(_extract, own=extractors or {}), SCHEMA)


def exploded(extraction: DataFrame, what: str) -> DataFrame:
    """One row per definition, call, import or base, with its path."""
    return extraction.select("path", F.explode(what).alias("x")).select("path", "x.*")
