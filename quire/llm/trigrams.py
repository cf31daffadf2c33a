"""Boolean trigram queries derived from regular expressions.

A query is a tuple of alternatives, each a frozenset of trigrams that must all occur; None means that the
expression has no mandatory trigram and every text must be scanned. Letters are folded to lower case, so a
query holds for texts folded likewise, whatever the case rules of the expression.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parser

#: Beyond so many alternatives a run of known characters is closed and a new one begun.
MOST = 24


def _exact(op, arg) -> set[str] | None:
    """The strings an element stands for, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return s if len(s := {chr(a).lower() for _, a in arg}) <= 4 else None
    if op is sre.MAX_REPEAT and arg[1] == 1 and len(arg[2]) == 1:
        inner = _exact(*arg[2][0])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is sre.SUBPATTERN:
        return _strings(arg[3])
    if op is sre.BRANCH:
        parts = [_strings(p) for p in arg[1]]
        return None if None in parts or len(u := set().union(*parts)) > MOST else u
    return None


def _strings(parsed) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        s = _exact(op, arg)
        if s is None or len(out) * len(s) > MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(strings: set[str]) -> tuple[frozenset[str], ...] | None:
    alternatives = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in alternatives else tuple(_least(alternatives))


def _least(alternatives) -> list[frozenset[str]]:
    """Without alternatives that imply another one, in a fixed order."""
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _and(a, b):
    if a is None or b is None:
        return a if b is None else b
    return tuple(_least({x | y for x in a for y in b})) if len(a) * len(b) <= MOST else min(a, b, key=len)


def _of(parsed):
    query, run = None, {""}
    for op, arg in parsed:
        s = _exact(op, arg)
        if s is not None and len(run) * len(s) <= MOST:
            run = {a + b for a in run for b in s}
            continue
        query, run = _and(query, _query(run)), s if s is not None else {""}
        if s is None and op is sre.SUBPATTERN:
            query = _and(query, _of(arg[3]))
        elif s is None and op is sre.MAX_REPEAT and arg[0] > 0:
            query = _and(query, _of(arg[2]))
        elif s is None and op is sre.BRANCH:
            parts = [_of(p) for p in arg[1]]
            query = _and(query, None if None in parts else tuple(_least({x for p in parts for x in p})))
    return _and(query, _query(run))


def trigram_query(pattern: str) -> tuple[frozenset[str], ...] | None:
    return _of(sre_parser.parse(pattern))
