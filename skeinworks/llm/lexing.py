"""Token classes and logical lines for the bundled grammars, on the core's lexers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.lexing import JS_REGEX_HEAD, KEYWORDS, PATTERNS, tokens

__all__ = ["KEYWORDS", "PATTERNS", "Classes", "classes_by_line", "go_lines", "python_lines", "ruby_lines", "tokens"]


@dataclass
class Classes(dict):
    """Token -> its class, as characters of a grammar's terminals.  Learns tokens as they come, within a bound."""

    language: str
    terminal: object  # chart.Terminals
    most: int = 200_000
    words: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.words = set(KEYWORDS[self.language].split())

    def __missing__(self, token: str) -> str:
        if len(self) > self.most:
            self.clear()
        found = self[token] = self._class(token)
        return found

    def _class(self, token: str) -> str:  # noqa: PLR0911, PLR0912
        t, lang, c = self.terminal, self.language, token[0]
        js = lang in ("javascript", "typescript")
        if token == "\n":
            return "\n"
        if lang in ("python", "ruby"):
            if c == "#":
                return ""
            if c == "\n":
                if lang == "ruby" and token.lstrip()[:1] == "/":
                    return "\n" * token.count("\n") + t["RE"]
                return token if lang == "python" else "\n" * token.count("\n")
            if c == "\\" and len(token) > 1:
                return ""
        elif token.startswith("//") or (token.startswith("/*") and len(token) >= 4):
            return "\n" * token.count("\n")
        if lang == "c" and c == "\\" and len(token) > 1:
            return ""
        if js and c != "/" and token[-1] not in "\"'`" and len(token) > 2 and "/" in token and not (c.isalnum() and " " not in token and "\n" not in token):
            head = re.match(JS_REGEX_HEAD, token)
            if head:
                word = head.group(0).strip()
                return "\n" * token.count("\n") + (t[word] if word else "") + t["RE"]
        if lang == "ruby" and c not in "\"'`%<:@?" and len(token) > 2 and token.rstrip("abcdefghijklmnopqrstuvwxyz").endswith("/") and "/" in token[:-1]:
            word = token.split("/", 1)[0].strip()
            return (t[word] if word else "") + t["RE"]
        if token == "_":
            return t["_"] if lang == "rust" else t["ID"]
        if c.isalpha() or c in "_$" and len(token) > 1 or c == "$" and js:
            if token[-1] in "\"'" and len(token) > 1:
                if lang == "rust" and token[0] == "b" and token[-1] == "'":
                    return t["CHR"]
                return t["STR"]
            if token in self.words:
                return t[token]
            if lang == "rust" and c == "r" and '"' in token:
                return t["STR"]
            if lang == "ruby" and c.isupper():
                return t["CONST"]
            if lang == "ruby" and c == "$":
                return t["VAR"]
            return t["ID"]
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return t["NUM"]
        if c == '"' and len(token) > 1:
            return t["STR"]
        if c == "'":
            if lang in ("go", "java", "c", "rust"):
                if len(token) > 2 and token[-1] == "'":
                    return t["CHR"]
                return t["LIFE"] if lang == "rust" and len(token) > 1 else t["BAD"]
            return t["STR"] if len(token) > 1 else t["BAD"]
        if c == "`" and len(token) > 1:
            return t["STR"] if lang == "go" else t["TPL"] + "\n" * (token.count("\n") if js else 0)
        if lang == "ruby":
            if c == "@":
                return t["VAR"]
            if c == ":" and len(token) > 1 and token != "::":
                return t["SYM"]
            if c == "%" and len(token) > 2:
                return t["STR"]
            if token.startswith("<<") and len(token) > 3:
                return self._heredoc(token)
            if c == "?" and len(token) == 2:
                return t["STR"]
        if token in t.code:
            return t.code[token]
        return t["BAD"]

    def _heredoc(self, token: str) -> str:
        """A heredoc stands where its mark stands; what follows the mark on its line goes on after it."""
        rest = re.sub(r"^<<[-~]?(['\"`]?)[A-Z_]\w*\1", "", token.split("\n", 1)[0])
        return self.terminal["STR"] + "".join(self[x] for x in tokens(rest, "ruby"))


_DIRECTIVE = re.compile(r"(?m)^[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*")
_SHEBANG = re.compile(r"\A﻿?#![^\n]*")


def classes_by_line(text: str, language: str, table: Classes) -> list[str]:
    """Token classes of each line that has any meaning to the grammar."""
    if language == "ruby":
        text = "\n" + text
    elif language != "python" and text[:3].lstrip("﻿").startswith("#!") and language in ("javascript", "typescript"):
        text = _SHEBANG.sub("", text)
    if language == "c":
        text = _DIRECTIVE.sub(lambda m: "\n" * m.group(0).count("\n"), text)
    if text[:1] == "﻿":
        text = text[1:]
    return "".join([table[x] for x in tokens(text, language)]).split("\n")


def python_lines(text: str, table: Classes) -> list[str]:
    """As :func:`classes_by_line`, with indentation turned into INDENT and DEDENT and each logical line ended by END."""
    t = table.terminal
    opening, closing = t["("] + t["["] + t["{"], t[")"] + t["]"] + t["}"]
    indent, dedent, end, bad = t["INDENT"], t["DEDENT"], t["END"], t["BAD"]
    pieces = "".join([table[x] for x in tokens("\n" + text.lstrip("﻿"), "python")]).split("\n")
    out, depth, stack, open_line = [], 0, [0], False
    for piece in pieces[1:]:
        body = piece.lstrip(" \t\f")
        if not body:
            out.append("")
            continue
        line = body
        if depth == 0:
            blank = piece[: len(piece) - len(body)]
            width = len(blank.expandtabs(8)) if "\t" in blank else len(blank)
            if width > stack[-1]:
                stack.append(width)
                line = indent + line
            elif width < stack[-1]:
                gone = 0
                while width < stack[-1]:
                    stack.pop()
                    gone += 1
                line = (dedent * gone if width == stack[-1] else bad) + line
        for c in body:
            if c in opening:
                depth += 1
            elif c in closing:
                depth = max(0, depth - 1)
        open_line = depth > 0
        out.append(line if open_line else line + end)
    if open_line:
        out.append(end)
    out.append(dedent * (len(stack) - 1))
    return out


_GO_ENDS = ("ID", "NUM", "STR", "CHR", "return", "break", "continue", "fallthrough", "++", "--", ")", "]", "}")


def go_lines(text: str, table: Classes) -> list[str]:
    """Go ends a statement at a line break after an operand, closing bracket or some words."""
    t = table.terminal
    ends = {t[x] for x in _GO_ENDS}
    return [line + t[";"] if line and line[-1] in ends else line for line in classes_by_line(text, "go", table)]


_RUBY_MODIFIERS = "if unless while until rescue".split()
_RUBY_VALUES = "ID CONST VAR NUM STR SYM RE TPL ) ] } nil true false self end super return break next redo retry yield __method__".split()
_RUBY_GOES_ON = "+ - * / % ** == != === =~ !~ <=> < <= > >= && || and or not & ^ << >> = += -= *= /= %= **= &= |= ^= <<= >>= &&= ||= , ( [ { . &. :: ? : => -> !".split()


def ruby_lines(text: str, table: Classes) -> list[str]:
    """Ruby ends a statement at a line break unless the line ends in an operator or the next one begins with a dot or closing bracket."""
    t = table.terminal
    goes_on = {t[x] for x in _RUBY_GOES_ON}
    led = {t["."], t["&."], t[")"], t["]"]}
    # such a word after a value modifies the statement; elsewhere it begins one
    modifier = re.compile(f"(?<=[{re.escape(''.join(t[x] for x in _RUBY_VALUES))}])[{''.join(t[x] for x in _RUBY_MODIFIERS)}](?!{re.escape(t[':'])})")
    lines = [modifier.sub(t["MODIFIER"], x) for x in classes_by_line(text, "ruby", table)[1:]]
    following = ""
    for i in range(len(lines) - 1, -1, -1):
        line = lines[i]
        if line:
            if line[-1] not in goes_on and following not in led:
                lines[i] = line + "\n"
            following = line[0]
    return lines
