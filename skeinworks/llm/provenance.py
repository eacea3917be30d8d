"""Problem 5: generated, minified or vendored source files, and data saved as code.

Re-Pair grammars (:mod:`.repair`) are inferred over the token sequence of each
file, comments left out, and tell most cases:

* *vendored*: at least half of the file's tokens, and 40 of them, lie in rules that
  occur in other repositories too (:func:`.repair.passages`); edited copies are found as
  long as half of them stayed;
* *data*: nearly all characters stand in literals, and the grammar of these
  literals is about as long as they are: near-incompressible;
* *minified*: hardly any line breaks, and a grammar that is much shorter than the
  tokens, as few names return all the time;
* *generated*: high rule reuse, three quarters of the tokens in rules of eight
  tokens or more that are used four times or more; numbers within names do not
  count, so that serially numbered definitions share their rules.

A file that a tool wrote in the manner of a person, or a copy of which no other
repository holds anything, shows nothing in its grammar.  For these the hints
count that tools leave: a generator's banner or a notice of origin in the head
comment (never in code or string literals), and customary folders and suffixes.
``signs`` says for every file which grammar or hint spoke.

Empty files and texts of unknown languages are no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, cut_lineage, cut_measured
from . import lexing, repair
from .sources import files_with_text, repository

# Folders and suffixes that package managers and generators use, and what they write into head comments.
VENDOR_FOLDERS = "vendor third_party thirdparty third-party 3rdparty 3rd_party external deps node_modules bower_components bower_parts jspm_packages Godeps site-packages Pods Carthage".split()
GENERATED_FOLDERS = "gen generated autogen auto_generated __generated__ generated-sources".split()
GENERATED_SUFFIX = r"(?:\.pb|\.pb-c|_pb2|_pb2_grpc|_grpc\.pb|\.pb\.gw|\.g|\.gen|_gen|\.generated|_generated|\.designer|\.freezed)\.\w+$|_string\.go$"
MINIFIED_SUFFIX = r"[.-](?:min|bundle|prod|packed)\.[cm]?js$"
BANNER = r"(?:^|\s)@generated\b|\bcode generated by .{1,80}do not edit|<auto-?generated|\bauto-?generated (?:file|by|from|code|source)|\b(?:automatically|auto-?) ?generated\b|\bgenerated (?:from|by|with|using) \S.{0,80}\b(?:do not|don't|never|not to be) (?:edit|modify|change)|\bthis (?:file|code|source) (?:is|was|has been) (?:auto\S* )?generated|\bgenerated (?:file|code)\b|\bautomatically (?:produced|created|built|written|made) by\b|\bmachine[- ](?:made|generated|written|produced)\b|\b(?:manual|any|all|hand|local) (?:changes?|edits?|modifications?)(?: (?:made )?(?:here|to this file|below))? (?:is|are|will be|get) (?:lost|overwritten|discarded)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bgénéré automatiquement|\bgenerado automáticamente|\bgerado automaticamente|\bgenerato automaticamente|自动生成|自動生成|자동 ?생성|автоматически (?:создан|сгенерирован)|сгенерирован\w* автоматически"
NOTICE = r"\(c\) .{0,60}authors\b.*licen[cs]e|\bupstream: \S+@\S|\b(?:taken|copied|imported) (?:unchanged |verbatim )?from \S+ v?\d|\bvendored (?:from|copy)|\bthird[- ]party (?:code|file|copy)"
NOT_BANNER = r"\b(?:keys|names|values|ids|files|tables|lines|data) (?:are|were) generated by the\b"

#: Rounds of pairing that make the rules compared between repositories (about 38 tokens each), the least tokens of a rule that
#: is evidence, the share of a file's tokens that must lie in such rules, and their least number: a few lines, such as an error
#: page saved as code, are alike by chance.
SHARED_ROUNDS, SHARED_TOKENS, SHARED_SHARE, SHARED_LEAST = 9, 16, 0.5, 40
#: Share of literals among the characters of literals and words, their least length, and the least length of the literals'
#: grammar for each literal, from which a text is mere data.
DATA_SHARE, DATA_CHARS, DATA_RATIO = 0.95, 400, 0.8
#: Characters per line from which code may be minified, and the most grammar symbols for each token.
MINIFIED_LINE, MINIFIED_RATIO = 200, 0.8
#: Share of the tokens that stand in reused rules (:data:`.repair.REUSED_TOKENS`) from which a file is generated.
GENERATED_SHARE = 0.75

#: Tokens that a task keeps in mind between its batches.
REMEMBERED = 200_000

_DIGITS = re.compile(r"\d+")
_BANNER, _NOTICE, _NOT = re.compile(BANNER, re.I), re.compile(NOTICE, re.I), re.compile(NOT_BANNER, re.I)
_RULE = pa.list_(pa.struct([("rule", pa.int64()), ("tokens", pa.int64())]))
SCHEMA = "path string, language string, n_tokens long, symbols long, reused long, literals long, literal_symbols long, literal_chars long, word_chars long, chars_a_line double, banner boolean, notice boolean, rules array<struct<rule: long, tokens: long>>"
#: What a token counts as.
_OTHER, _LITERAL, _WORD, _SKIPPED = range(4)


def _head_comment(tokens: list[str], hash_comments: bool) -> str:
    """The comments before the first code, without their marks; string literals are code."""
    out = []
    for x in tokens:
        if x.isspace():
            continue
        if x.startswith(("//", "/*")) and not hash_comments or x[0] == "#" and hash_comments and not x.startswith("#!"):
            out.append(x.strip("/*#! \t\r\n"))
        elif not (x.startswith("#!") or x == "﻿"):
            break
    return " \n".join(out)


def _token_id(token: str) -> int:
    """A 64-bit id that depends on the token only, equal on every executor."""
    import xxhash

    return xxhash.xxh64_intdigest(token) or 1


class _Tokens(dict):
    """Token -> its number in the columns ``ids``, ``plain``, ``kinds`` and ``sizes``; learns tokens as they come."""

    def __init__(self, hash_comments: bool) -> None:
        super().__init__()
        self.hash_comments = hash_comments
        self.ids: list[int] = []
        self.plain: list[int] = []  # ids of names and numbers without their digits
        self.kinds: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, x: str) -> int:
        found = self[x] = len(self.ids)
        if x.isspace() or (x[0] == "#" if self.hash_comments else x.startswith(("//", "/*"))):
            kind = _SKIPPED
        elif x[0].isdigit() or len(x) > 1 and x[-1] in "\"'`":
            kind = _OTHER if self.hash_comments and x[-3:] in ('"""', "'''") else _LITERAL
        else:
            kind = _WORD if x[0].isalpha() or x[0] == "_" else _OTHER
        self.ids.append(_token_id(x))
        self.plain.append(_token_id(_DIGITS.sub("0", x)) if x[0].isalnum() or x[0] == "_" else self.ids[-1])
        self.kinds.append(kind)
        self.sizes.append(len(x))
        return found


def _sums(values: np.ndarray, owner: np.ndarray, files: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=files).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {True: _Tokens(True), False: _Tokens(False)}
    for b in batches:
        texts, languages = b.column("text").to_pylist(), b.column("language").to_pylist()
        for h, t in known.items():
            if len(t) > REMEMBERED:
                known[h] = _Tokens(h)
        parts: list[tuple[bool, int, np.ndarray]] = []
        files = len(texts)
        lines, banner, notice = np.ones(files), np.zeros(files, bool), np.zeros(files, bool)
        for i, (text, language) in enumerate(zip(texts, languages, strict=True)):
            if not text or language not in lexing.PATTERNS:
                continue
            hashes = language in ("python", "ruby")
            tokens = lexing.tokens(text, language)
            parts.append((hashes, i, np.fromiter(map(known[hashes].__getitem__, tokens), np.int64, len(tokens))))
            lines[i] = 1 + sum(1 for x in text.split("\n") if x and not x.isspace())
            head = _head_comment(tokens, hashes)
            if head:
                banner[i] = bool(_BANNER.search(head)) and not (_NOT.search(head) and not _BANNER.search(_NOT.sub(" ", head)))
                notice[i] = bool(_NOTICE.search(head))
        columns = {h: (np.array(t.ids, np.uint64), np.array(t.plain, np.uint64), np.array(t.kinds, np.int64), np.array(t.sizes, np.int64)) for h, t in known.items()}
        owner = np.concatenate([np.zeros(0, np.int64), *[np.full(len(x), i) for _, i, x in parts]])
        ids, plain, kinds, sizes = (np.concatenate([columns[True][k][:0], *[columns[h][k][x] for h, _, x in parts]]) for k in range(4))
        code = kinds != _SKIPPED
        owner, ids, plain, kinds, sizes = owner[code], ids[code], plain[code], kinds[code], sizes[code]
        whole = repair.infer(plain, owner, files)
        literal = kinds == _LITERAL
        literal_chars, word_chars = _sums(sizes * literal, owner, files), _sums(sizes * (kinds == _WORD), owner, files)
        mostly = literal & (literal_chars >= DATA_SHARE * (literal_chars + word_chars))[owner]
        values = repair.infer(ids[mostly], owner[mostly], files)
        at, rule, span = repair.passages(ids, owner, SHARED_ROUNDS)
        long_enough = span >= SHARED_TOKENS
        at, rule, span = at[long_enough], rule[long_enough], span[long_enough]
        offsets = np.searchsorted(at, np.arange(files + 1)).astype(np.int32)
        rules = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rule.view(np.int64)), pa.array(span)], ["rule", "tokens"]))
        sized = [whole["n"], whole["axiom"] + 2 * whole["rules"], whole["reused"], values["n"], values["axiom"] + 2 * values["rules"], literal_chars, word_chars, _sums(sizes, owner, files) / lines, banner, notice]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("language"), *map(pa.array, sized), rules.cast(_RULE)], names=[x.split()[0] for x in SCHEMA.split(", ") if ": long>" not in x])


def grammar_features(files: DataFrame, source_texts: DataFrame) -> DataFrame:
    """Per current file with a text: the sizes of its grammars, its rules of some length, and what its head comment says."""
    texts = files_with_text(files, source_texts).where("text IS NOT NULL").select("path", "language", "text")
    return bounded_batches(texts).mapInArrow(_features, SCHEMA)


def _in_folder(path: Column, names: list[str]) -> Column:
    return path.rlike("/(?:" + "|".join(re.escape(x) for x in names) + ")/")


def foreign_tokens(features: DataFrame) -> DataFrame:
    """``path, foreign``: tokens of each file in rules that other repositories have too; files without any are left out.

    A rule is foreign to all its files if the least and greatest of its
    repositories, as hashes, differ: two algebraic aggregates of fixed size, so a
    rule that stands in a third of all files reaches the shuffle as a few partial
    rows.  The shared rules are written and measured: where they are few they go to
    the uses, and where they are many the planner may split a hot rule's uses, as no
    aggregate stands between the join and its shuffles.
    """
    uses = features.select("path", F.explode("rules").alias("r")).select("path", "r.rule", "r.tokens")
    repo = F.xxhash64(repository(F.col("path")))
    shared = cut_measured(uses.groupBy("rule").agg(F.min(repo).alias("a"), F.max(repo).alias("b")).where("a <> b").select("rule"))
    return uses.join(shared.side(), "rule", "left_semi").groupBy("path").agg(F.sum("tokens").alias("foreign"))


def classified(files: DataFrame, source_texts: DataFrame) -> DataFrame:
    """``path, language, reasons, signs`` of each current file with a text; ``reasons`` is empty for hand-written source, and
    ``signs`` names what speaks for them: ``grammar: ...`` or ``hint: ...``."""
    f = cut_lineage(grammar_features(files, source_texts))  # read twice, inferred once
    path, n = F.col("path"), F.col("n_tokens")
    joined = f.drop("rules").join(foreign_tokens(f), "path", "left")
    literal_share = F.col("literal_chars") / F.greatest(F.lit(1), F.col("literal_chars") + F.col("word_chars"))
    long_lines = F.col("chars_a_line") >= MINIFIED_LINE
    signs = [
        ("vendored", "grammar: rules of other repositories", F.coalesce("foreign", F.lit(0)) >= F.greatest(SHARED_SHARE * n, F.lit(SHARED_LEAST))),
        ("data", "grammar: incompressible literals", (literal_share >= DATA_SHARE) & (F.col("literal_chars") >= DATA_CHARS) & (F.col("literal_symbols") >= DATA_RATIO * F.col("literals"))),
        ("minified", "grammar: few names, few lines", long_lines & (literal_share < DATA_SHARE) & (F.col("symbols") < MINIFIED_RATIO * n)),
        ("generated", "grammar: rule reuse", ~long_lines & (literal_share < DATA_SHARE) & (F.col("reused") >= GENERATED_SHARE * n)),
        ("generated", "hint: banner", F.col("banner")),
        ("generated", "hint: folder or suffix", _in_folder(path, GENERATED_FOLDERS) | path.rlike(GENERATED_SUFFIX)),
        ("minified", "hint: suffix", path.rlike(MINIFIED_SUFFIX)),
        ("vendored", "hint: notice", F.col("notice")),
        ("vendored", "hint: folder", _in_folder(path, VENDOR_FOLDERS)),
    ]
    spoken = F.array_compact(F.array(*[F.when(c & (n > 0), F.struct(F.lit(r).alias("reason"), F.lit(s).alias("sign"))) for r, s, c in signs]))
    return joined.withColumn("s", spoken).select("path", "language", F.array_distinct("s.reason").alias("reasons"), F.col("s.sign").alias("signs"))
