"""SQL of the queries over source text that SQL can express: declarations by the stored graph, imports by their lines."""

from __future__ import annotations

from .graph_sql import WITH

#: Extensions, the pattern of an import line, and its groups (0: none) for module and name; a name of group 0 is the last part
#: of the module behind the sign that follows, or the whole module.
_LINES = [
    ("ts mts cts tsx js mjs cjs jsx", r"(?m)^import (?:type )?\{ (\w+) \} from '([^'\n]+)'", 2, 1, ""),
    ("ts mts cts tsx js mjs cjs jsx", r"(?m)^import \* as (\w+) from '([^'\n]+)'", 2, 0, ""),
    ("ts mts cts tsx js mjs cjs jsx", r"(?m)^(?:const|let|var) (\w+) = require\('([^'\n]+)'\)", 2, 0, ""),
    ("py pyi", r"(?m)^from ([.\w]+) import (\w+)", 1, 2, ""),
    ("py pyi", r"(?m)^import (\w+)", 1, 0, ""),
    ("go", r'(?m)^import (?:\w+ )?"([^"\n]+)"', 1, 0, ""),
    ("go", r'(?m)^\t(?:\w+ )?"([^"\n]+)"\r?$', 1, 0, ""),
    ("java", r"(?m)^import (?:static )?([\w.]+);", 1, 0, "[.]"),
    ("rs", r"(?m)^(?:pub )?use ([\w:]+);", 1, 0, "::"),
    ("c h", r'(?m)^#include [<"]([^>"\n]+)[>"]', 1, 0, ""),
    ("rb", r"(?m)^require '([^'\n]+)'", 1, 0, ""),
    ("rb", r"(?m)^require_relative '([^'\n]+)'", 1, 0, ""),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lines(extensions: str, pattern: str, module: int, name: int, behind: str) -> str:
    found = f"unnest(regexp_extract_all(text, {_quoted(pattern)}, {module})) AS module"
    names = f", unnest(regexp_extract_all(text, {_quoted(pattern)}, {name})) AS name" if name else ""
    imported = "name" if name else "regexp_extract(module, '([^.:]+)$', 1)" if behind else "'*'"
    prefix = "'./' || " if "require_relative" in pattern else ""
    known = ", ".join(_quoted("." + e) for e in extensions.split())
    return f"SELECT path, {prefix}module AS specifier, {imported} AS imported_name FROM (SELECT path, {found}{names} FROM source_texts WHERE regexp_extract(path, '([.][^./]*)$', 1) IN ({known}))"


SQL = {
    "declarations_found": f"{WITH} SELECT id, name FROM n WHERE kind <> 'file'",
    "imports_found": " UNION ".join(_lines(*x) for x in _LINES),
}
