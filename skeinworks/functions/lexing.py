"""String- and comment-aware lexers, one per language, as tables.

Each language has one master pattern; ``findall`` cuts the whole text into
tokens in one pass and a table gives each token its class.  The tables serve
extraction here and the parsing operators built on top.
"""

from __future__ import annotations

import re

# Reserved words of the languages, as their public definitions list them.
KEYWORDS = {
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum let yield await async of get set static from as true false null",
    "typescript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum let yield await async of get set static from as true false null type interface implements readonly public private protected abstract override declare namespace module keyof infer is asserts satisfies unique require accessor",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record yield sealed permits non when module",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Static_assert _Alignas _Noreturn __attribute__",
    "ruby": "alias and begin BEGIN break case class def defined do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __method__",
}

_OPERATORS = {
    "js": r"\.\.\.|=>|\*\*=?|&&=?|\|\|=?|\?\?=?|[!=]==?|<<=?|<=|\+\+|--|[-+*/%&|^]=|\?\.(?!\d)",
    "python": r"\.\.\.|->|:=|\*\*=?|//=?|<<=?|>>=?|[-+*/%&|^@=!<>]=",
    "go": r"\.\.\.|:=|<-|&&|\|\||\+\+|--|<<=?|>>=?|&\^=?|[-+*/%&|^=!<>]=",
    "java": r"\.\.\.|->|::|&&|\|\||\+\+|--|<<=?|[-+*/%&|^=!<]=",
    "rust": r"\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||<<=?|[-+*/%&|^=!<]=",
    "c": r"\.\.\.|->|&&|\|\||\+\+|--|<<=?|>>=?|[-+*/%&|^=!<>]=|\#\#",
    "ruby": r"\.\.\.|\.\.|\*\*=?|&&=?|\|\|=?|<=>|===?|=~|!~|=>|->|<<=?|>>=?|&\.|::|[-+*/%&|^!<>]=",
}
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"0[xX][\da-fA-F_]+[a-zA-Z\d]*|0[bBoO][\d_]+[a-z\d]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[A-Za-z\d_]*"
_ID = r"[^\W\d]\w*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"
_REGEX_BODY = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
JS_REGEX_HEAD = r"(?:\n\s*|=>\s*|&&\s*|\|\|\s*|\?\?\s*|[!=]==?\s*|[(,=:\[!&|?{;+*%~^<>-]\s*|\b(?:return|typeof|case|in|of|void|throw|delete)\s+)"


def _cut(*parts: str) -> re.Pattern[str]:
    return re.compile(r"[ \t\r\f\v﻿ ​　]*(" + "|".join(parts) + r"|\n|\S)")


_JS = _cut(JS_REGEX_HEAD + _REGEX_BODY, _LINE, _BLOCK, r"[^\W\d][\w$]*|\$[\w$]*", _DQ, _SQ, _TEMPLATE, r"\d[\d_]*(?=\.\.)", _NUM + r"|\d+\.(?![.\w])", _OPERATORS["js"])

PATTERNS = {
    "javascript": _JS,
    "typescript": _JS,
    "python": _cut(
        r"\#[^\n]*",
        r"(?:[rRbBuUfFtT]{1,2})?\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|(?:[rRbBuUfFtT]{1,2})?'''(?:[^\\']|\\[\s\S]|'(?!''))*'''",
        r"(?:[rRbBuUfFtT]{1,2})?(?:\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"\"(?!\")|''(?!'))",
        _ID, r"\\\r?\n", r"\d[\d_]*\.(?![\w.])", _NUM, _OPERATORS["python"], r"\n[ \t\f]*",
    ),
    "go": _cut(_LINE, _BLOCK, _ID, _DQ, r"`[^`]*`", r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'", r"\d+\.(?![\w.])", _NUM, _OPERATORS["go"]),
    "java": _cut(_LINE, _BLOCK, r"[^\W\d][\w$]*", r'"""[\s\S]*?"""', _DQ, r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'", r"\d+\.(?![\w.])", _NUM, _OPERATORS["java"]),
    "rust": _cut(_LINE, _BLOCK, r'b?r(\#*)"[\s\S]*?"\2', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\[^\n][^'\n]*)'", r"'[A-Za-z_]\w*", r"r\#[^\W\d]\w*", _ID, r"\d[\d_]*(?=\.\.)", r"\d[\d_]*\.(?![\w.])", _NUM, _OPERATORS["rust"]),
    "c": _cut(_LINE, _BLOCK, r"(?:u8|[uUL])?\"(?:[^\"\\\n]|\\[\s\S])*\"", r"[uUL]?'(?:[^'\\\n]|\\[^\n][^'\n]*)+'", _ID, r"\d+\.(?![\w.])", _NUM, _OPERATORS["c"], r"\\\r?\n"),
    "ruby": _cut(
        r"\#[^\n]*", r"\n=begin\b[\s\S]*?\n=end[^\n]*", r"\n__END__[\s\S]*",
        r"(?<=[=(,\s])<<[-~]?(['\"`]?)([A-Z_]\w*)\2[^\n]*\n[\s\S]*?\n[ \t]*\3(?=\s|$)",
        r"%[wWiIqQ]?\([^()]*\)|%[wWiIqQ]?\[[^\[\]]*\]|%[wWiIqQ]?\{[^{}]*\}|%[wWiIqQ]\|[^|]*\|",
        r"(?:\n\s*|[(,=!&|{]\s*|\b(?:if|unless|when|and|or|not|return)\s+)/(?![/*\s])(?:[^/\\\n]|\\[^\n])+/[a-z]*",
        r":\"(?:[^\"\\]|\\[\s\S])*\"|:[^\W\d]\w*[?!=]?(?![:\w])|:[-+*/<>=!\[\]%&|^~]+(?=[\s,)])", r"@{1,2}[^\W\d]\w*|\$\w+|\$[!@&~0-9]", r"[^\W\d]\w*[?!](?!=)|[^\W\d]\w*",
        r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'", r"`(?:[^`\\]|\\[\s\S])*`", r"\?[A-Za-z](?!\w)", r"\d[\d_]*(?=\.\.)", _NUM, _OPERATORS["ruby"], r"\\\r?\n",
    ),
}

#: For languages with strings in single and double quotes, ``#`` comments and ``$`` before names.
QUOTED = _cut(
    _LINE, _BLOCK, r"\#(?!\[)[^\n]*", _ID, r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"", r'"(?:[^"\\]|\\[\s\S])*"', r"'(?:[^'\\]|\\[\s\S])*'",
    r"\d+\.(?![\w.])", _NUM, r"<=>|\?->|\?\?=?|===?|!==?", _OPERATORS["java"],
)

#: Whether findall gives more than one group, of which the first is the token.
_GROUPED = {name: p.groups > 1 for name, p in PATTERNS.items()}


def tokens(text: str, language: str) -> list[str]:
    """The tokens of a text, line breaks and comments included; text between them is white space."""
    found = PATTERNS[language].findall(text)
    return [m[0] for m in found] if _GROUPED[language] else found
