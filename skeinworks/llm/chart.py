"""Table-driven recogniser for bundled grammars.

A grammar is a set of EBNF rules.  Each rule is compiled to a deterministic
automaton over terminals and rule names; together they form a recursive
transition network.  The recogniser keeps *every* live derivation at once (a
set of stacks, shared as linked cells), so grammars may be ambiguous, as those
of real languages are, and a text is rejected exactly where no derivation can
take the next token.

Terminals are single characters.  The move of a set of stacks over one *line*
of tokens is remembered: source code repeats few line shapes in few contexts,
so most lines cost one dictionary lookup.  The memory is bounded
(``MAX_CELLS``) and only saves time, never changes a verdict.
"""

from __future__ import annotations

import re

MAX_CELLS = 400_000
LONG_LINE = 60

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|'((?:[^'\\]|\\.)+)'|([()|*+?:;]))")


class Terminals:
    """Gives each terminal name its own character."""

    def __init__(self) -> None:
        self.code: dict[str, str] = {}

    def __getitem__(self, name: str) -> str:
        if name not in self.code:
            self.code[name] = "\n" if name == "NL" else chr(0x4E00 + len(self.code))
        return self.code[name]


class Grammar:
    """Compiled rules: ``edges[state][symbol] -> state``, ``final``, ``start``."""

    def __init__(self, text: str, terminals: Terminals, start: str = "file") -> None:
        self.terminals = terminals
        text = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("--"))
        rules = self._read(text)
        self.nullable: set[str] = set()
        grew = True
        while grew:
            grew = False
            for name, tree in rules.items():
                if name not in self.nullable and self._nullable(tree):
                    self.nullable.add(name)
                    grew = True
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.start: dict[str, int] = {}
        self.names = set(rules)
        for name, tree in rules.items():
            self._compile(name, tree)
        self._first()
        self.root = self.start[start]

    # -- reading EBNF ------------------------------------------------------
    def _read(self, text: str) -> dict[str, tuple]:
        tokens = [m.groups() for m in _TOKEN.finditer(text)]
        at = 0

        def alternatives() -> tuple:
            nonlocal at
            options = [sequence()]
            while at < len(tokens) and tokens[at][2] == "|":
                at += 1
                options.append(sequence())
            return ("or", options) if len(options) > 1 else options[0]

        def sequence() -> tuple:
            nonlocal at
            parts = []
            while at < len(tokens) and tokens[at][2] not in ("|", ")", ";"):
                name, quoted, mark = tokens[at]
                at += 1
                if mark == "(":
                    item = alternatives()
                    at += 1
                elif quoted is not None:
                    item = ("t", self.terminals[quoted])
                elif name.isupper():
                    item = ("t", self.terminals[name])
                else:
                    item = ("n", name)
                if at < len(tokens) and tokens[at][2] in ("*", "+", "?"):
                    item = (tokens[at][2], item)
                    at += 1
                parts.append(item)
            return ("seq", parts)

        rules: dict[str, tuple] = {}
        while at < len(tokens):
            name = tokens[at][0]
            if tokens[at + 1][2] != ":":
                raise ValueError(f"grammar: ':' expected after {name}")
            at += 2
            rules[name] = alternatives()
            if at >= len(tokens) or tokens[at][2] != ";":
                raise ValueError(f"grammar: ';' expected after rule {name}")
            at += 1
        used = re.findall(r"\('n', '(\w+)'\)", repr(rules))
        if lost := set(used) - set(rules):
            raise ValueError(f"grammar: no rule {sorted(lost)}")
        return rules

    def _nullable(self, tree: tuple) -> bool:
        kind, x = tree
        if kind == "t":
            return False
        if kind == "n":
            return x in self.nullable
        if kind == "or":
            return any(map(self._nullable, x))
        if kind == "seq":
            return all(map(self._nullable, x))
        return kind in "*?" or self._nullable(x)

    # -- rule to automaton -------------------------------------------------
    def _compile(self, name: str, tree: tuple) -> None:
        moves: list[list[tuple[str, int]]] = []
        jumps: list[list[int]] = []

        def state() -> int:
            moves.append([])
            jumps.append([])
            return len(moves) - 1

        def build(node: tuple, a: int, b: int) -> None:
            kind, x = node
            if kind in "tn":
                moves[a].append((x if kind == "t" else "<" + x, b))
                if kind == "n" and x in self.nullable:
                    jumps[a].append(b)
            elif kind == "or":
                for option in x:
                    build(option, a, b)
            elif kind == "seq":
                for item in x:
                    c = state()
                    build(item, a, c)
                    a = c
                jumps[a].append(b)
            else:
                c, d = state(), state()
                jumps[a].append(c)
                build(x, c, d)
                jumps[d].append(b)
                if kind in "*+":
                    jumps[d].append(c)
                if kind in "*?":
                    jumps[c].append(b)

        first, last = state(), state()
        build(tree, first, last)

        def closed(states: set[int]) -> frozenset[int]:
            todo = list(states)
            while todo:
                for b in jumps[todo.pop()]:
                    if b not in states:
                        states.add(b)
                        todo.append(b)
            return frozenset(states)

        known = {closed({first}): len(self.edges)}
        self.start[name] = len(self.edges)
        self.edges.append({})
        self.final.append(False)
        todo = list(known)
        while todo:
            group = todo.pop()
            number = known[group]
            self.final[number] = last in group
            by: dict[str, set[int]] = {}
            for a in group:
                for symbol, b in moves[a]:
                    by.setdefault(symbol, set()).add(b)
            for symbol, to in by.items():
                target = closed(to)
                if target not in known:
                    known[target] = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                    todo.append(target)
                self.edges[number][symbol] = known[target]

    def _first(self) -> None:
        self.first: dict[str, set[str]] = {n: set() for n in self.names}
        grew = True
        while grew:
            grew = False
            for name, at in self.start.items():
                mine = self.first[name]
                before = len(mine)
                for symbol in self.edges[at]:
                    mine |= self.first[symbol[1:]] if symbol[0] == "<" and len(symbol) > 1 else {symbol}
                grew |= len(mine) > before


class Recogniser:
    """Runs a grammar over token lines.  ``skip`` is a terminal that may be ignored anywhere."""

    def __init__(self, grammar: Grammar, skip: str = "") -> None:
        self.grammar = grammar
        self.skip = skip
        ends = "".join(grammar.terminals.code.get(x, "") for x in (";", ",", "{", "}", ")"))
        self.parts = re.compile(f"[^{ends}]{{0,40}}[{ends}]?", re.S).findall if ends else lambda x: (x,)
        self.reset()

    def reset(self) -> None:
        self.cell: dict[tuple[int, int], int] = {}
        self.top: list[tuple[int, int]] = []
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.plans: dict[tuple[int, str], tuple[list[tuple[int, ...]], bool]] = {}
        self.begin = self._set(frozenset([self._cell(self.grammar.root, -1)]))

    def _cell(self, state: int, below: int) -> int:
        key = (state, below)
        found = self.cell.get(key)
        if found is None:
            found = self.cell[key] = len(self.top)
            self.top.append(key)
        return found

    def _set(self, members: frozenset[int]) -> int:
        found = self.sets.get(members)
        if found is None:
            found = self.sets[members] = len(self.members)
            self.members.append(members)
        return found

    def _plan(self, state: int, token: str) -> tuple[list[tuple[int, ...]], bool]:
        """The chains of states that replace ``state`` when ``token`` comes, and whether its rule can end before."""
        found = self.plans.get((state, token))
        if found is not None:
            return found
        g = self.grammar
        chains: set[tuple[int, ...]] = set()

        def expand(at: int, under: tuple[int, ...]) -> None:
            for symbol, to in g.edges[at].items():
                if symbol == token:
                    chains.add((*under, to))
                elif symbol[0] == "<" and len(symbol) > 1 and token in g.first[symbol[1:]]:
                    # a finished state that can only return is not kept: right recursion needs no stack
                    expand(g.start[symbol[1:]], under if g.final[to] and not g.edges[to] else (*under, to))

        expand(state, ())
        found = self.plans[(state, token)] = (list(chains), g.final[state])
        return found

    def step(self, members: frozenset[int], token: str) -> frozenset[int]:
        out: set[int] = set()
        if token == self.skip:
            out |= members
        done: set[int] = set()
        todo = list(members)
        while todo:
            cell = todo.pop()
            if cell in done:
                continue
            done.add(cell)
            state, below = self.top[cell]
            chains, ends = self._plan(state, token)
            for chain in chains:
                at = below
                for s in chain:
                    at = self._cell(s, at)
                out.add(at)
            if ends and below >= 0:
                todo.append(below)
        return frozenset(out)

    def line(self, at: int, tokens: str) -> int:
        """The set after one line, or -1."""
        key = (at, tokens)
        found = self.moves.get(key)
        if found is None:
            members = self.members[at]
            for token in tokens:
                members = self.step(members, token)
                if not members:
                    break
            found = self.moves[key] = self._set(members) if members else -1
        return found

    def accepts(self, at: int) -> bool:
        g = self.grammar
        for cell in self.members[at]:
            while cell >= 0:
                state, cell = self.top[cell]
                if not g.final[state]:
                    break
            else:
                return True
        return False

    def first_error(self, lines: list[str]) -> int:
        """0 if the token lines form a sentence of the grammar, else the line (from 1) of the first error."""
        if len(self.top) > MAX_CELLS or len(self.moves) > MAX_CELLS:
            self.reset()
        at, moves = self.begin, self.moves
        for number, tokens in enumerate(lines, 1):
            # a very long line (minified code) repeats in its parts, not as a whole
            for part in (tokens,) if len(tokens) <= LONG_LINE else self.parts(tokens):
                after = moves.get((at, part))
                at = self.line(at, part) if after is None else after
                if at < 0:
                    return number
        return 0 if self.accepts(at) else max(1, len(lines))
