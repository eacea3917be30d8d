"""Re-Pair grammar inference over many token sequences at once.

:func:`infer` takes the most frequent pairs of a sequence first.  Every round looks at the adjacent pairs of each sequence, takes those that
occur at least twice *in that sequence*, and replaces the occurrences that beat
their neighbours (more frequent first, ties by content).  All sequences of a
batch advance together in numpy, yet none sees another, so the grammar of a
sequence depends on nothing but its content.  A rule's name is a hash of its
two sides: equal rules have equal names in any file, batch or executor.

:func:`passages` compares sequences that never meet.  A pair's frequency in the
whole collection is known to no task, and by the frequency in its own sequence
one passage would be derived differently in every file; so here a pair is
replaced where its *name* beats both neighbours.  What is replaced depends on a
few tokens around a place only: equal passages get equal rules wherever they
stand, but for the rules at their two ends.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for the ordered pair (a, b)."""
    with np.errstate(over="ignore"):
        x = (a * _A) ^ (b * _B + _C)
        x ^= x >> np.uint64(29)
        x *= _B
        x ^= x >> np.uint64(32)
    return x


#: A rule of at least so many tokens and uses counts as reused.
REUSED_TOKENS, REUSED_USES = 8, 4


def infer(tokens: np.ndarray, owner: np.ndarray, sequences: int, rounds: int = 64) -> dict[str, np.ndarray]:
    """Infers one grammar per sequence.

    ``tokens`` are 64-bit token ids, ``owner`` the non-decreasing sequence
    number of each.  Returns arrays by sequence: ``n`` tokens, ``axiom`` length
    of the start rule, ``rules`` number of rules, ``start`` name of the start
    rule, ``reused`` tokens that stand in reused rules.  A sequence without tokens has zeros.  ``rounds`` only bounds a loop
    that ends by itself after a number of rounds logarithmic in the longest
    repeat.
    """
    tokens, owner = tokens.astype(np.uint64), owner.astype(np.int64)
    n = np.bincount(owner, minlength=sequences)
    rules = np.zeros(sequences, np.int64)
    reused = np.zeros(sequences, np.int64)
    frozen: list[tuple[np.ndarray, np.ndarray]] = []
    s, o = tokens, owner
    span, within_reused = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
    for _ in range(rounds):
        if len(s) < 2:
            break
        inside = o[:-1] == o[1:]
        with np.errstate(over="ignore"):
            key = _mix(s[:-1], s[1:])
            mine = key ^ (o[:-1].astype(np.uint64) * _C)  # the same pair in another sequence is another pair
        within = np.flatnonzero(inside)  # a pair across two sequences is none
        if not len(within):
            break
        order = within[np.argsort(mine[within])]
        run = mine[order]
        first = np.empty(len(run), bool)
        first[0] = True
        np.not_equal(run[1:], run[:-1], out=first[1:])
        begins = np.flatnonzero(first)
        count = np.zeros(len(mine), np.int64)
        count[order] = np.repeat(np.diff(np.append(begins, len(run))), np.diff(np.append(begins, len(run))))
        able = inside & (count >= 2)
        if not able.any():
            break
        rank = np.where(able, count, 0).astype(np.float64)
        before, after = np.zeros(len(rank)), np.zeros(len(rank))
        before[1:], after[:-1] = rank[:-1], rank[1:]
        kb, ka = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64)
        kb[1:], ka[:-1] = key[:-1], key[1:]
        wins = able & ((rank > before) | (rank == before) & (key > kb)) & ((rank > after) | (rank == after) & (key > ka))
        # in a run of one symbol every other place may win
        same = able & (key == kb) & (rank == before) | able & (key == ka) & (rank == after)
        if same.any():
            edge = same & ~(np.append(False, same[:-1]) & (key == kb))
            start_at = np.maximum.accumulate(np.where(edge, np.arange(len(s) - 1), -1))
            odd = same & ((np.arange(len(s) - 1) - start_at) % 2 == 0)
            wins |= odd
            wins[1:] &= ~wins[:-1]
        if not wins.any():
            break
        # a rule needs two uses: drop winners that are alone in their sequence
        won = np.flatnonzero(wins)
        w = mine[won]
        uniq, inverse, uses = np.unique(w, return_inverse=True, return_counts=True)
        keep = uses[inverse] >= 2
        won = won[keep]
        if not len(won):
            break
        uses = uses[inverse][keep]
        ruled = np.unique(mine[won], return_index=True)[1]
        rules += np.bincount(o[won[ruled]], minlength=sequences)
        s, span, within_reused = s.copy(), span.copy(), within_reused.copy()
        s[won] = key[won]
        span[won] += span[won + 1]
        again = (uses >= REUSED_USES) & (span[won] >= REUSED_TOKENS)
        within_reused[won] = np.where(again, span[won], within_reused[won] + within_reused[won + 1])
        drop = np.ones(len(s), bool)
        drop[won + 1] = False
        changed = np.zeros(sequences, bool)
        changed[o[won]] = True
        s, o, span, within_reused = s[drop], o[drop], span[drop], within_reused[drop]
        live = changed[o]  # sequences without a new rule are done
        if not live.all():
            reused += np.bincount(o[~live], weights=within_reused[~live], minlength=sequences).astype(np.int64)
            frozen.append((s[~live], o[~live]))
            s, o, span, within_reused = s[live], o[live], span[live], within_reused[live]
    reused += np.bincount(o, weights=within_reused, minlength=sequences).astype(np.int64)
    frozen.append((s, o))
    axiom, start = np.zeros(sequences, np.int64), np.zeros(sequences, np.uint64)
    for s, o in frozen:
        if not len(s):
            continue
        axiom += np.bincount(o, minlength=sequences)
        begins = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        place = np.arange(len(s)) - np.repeat(begins, np.diff(np.append(begins, len(s))))
        with np.errstate(over="ignore"):
            start[o[begins]] = np.add.reduceat(_mix(s, place.astype(np.uint64)), begins)
    return {"n": n, "axiom": axiom, "rules": rules, "start": start, "reused": reused}


def passages(tokens: np.ndarray, owner: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, rule, tokens)`` of the rules that cut each sequence after so many rounds, in order.

    A round leaves about two of three symbols, so a rule spans about 1.5 ** ``rounds`` tokens.
    """
    s, o = tokens.astype(np.uint64), owner.astype(np.int64)
    span = np.ones(len(s), np.int64)
    for _ in range(rounds):
        if len(s) < 2:
            break
        wins = o[:-1] == o[1:]
        key = _mix(s[:-1], s[1:])
        rank = np.where(wins, key, np.uint64(0))
        wins[1:] &= rank[1:] > rank[:-1]
        wins[:-1] &= rank[:-1] > rank[1:]
        won = np.flatnonzero(wins)
        s, span = s.copy(), span.copy()
        s[won] = key[won]
        span[won] += span[won + 1]
        kept = np.ones(len(s), bool)
        kept[won + 1] = False
        s, o, span = s[kept], o[kept], span[kept]
    return o, s, span
