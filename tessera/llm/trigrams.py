"""Boolean trigram queries that every match of a regular expression must satisfy (after Cox, "Regular Expression
Matching with a Trigram Index", 2012). Trigrams are of lower-cased text, so that a query also serves either case."""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

MOST = 64
Query = list[frozenset[str]]  # any of these sets must be wholly present; an empty list: no condition is known


class _Walk:
    """Literal strings are grown along a sequence; where they can't be, their trigrams become a condition."""

    def __init__(self) -> None:
        self.strings: set[str] = {""}
        self.conditions: list[set[frozenset[str]]] = []

    def flush(self) -> None:
        if all(len(s) >= 3 for s in self.strings):
            self.conditions.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.strings})
        self.strings = {""}

    def grow(self, choices: set[str]) -> None:
        grown = {a + b for a, b in product(self.strings, choices)}
        if len(grown) > MOST:
            self.flush()
            grown = set(choices)
        self.strings = grown

    def sequence(self, items) -> None:
        for op, arg in items:
            if op is C.SUBPATTERN:
                self.sequence(arg[-1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, body = arg
                own = exact(body)
                if own is not None and most == 1:
                    self.grow(own | {""} if least == 0 else own)
                elif own is not None and 1 <= least == most <= 8:
                    for _ in range(least):
                        self.grow(own)
                else:
                    if least and own is not None:
                        self.grow(own)
                    self.flush()
            elif op is C.BRANCH and exact([(op, arg)]) is None:
                self.flush()
                parts = [dnf(part) for part in arg[1]]
                if all(parts):
                    self.conditions.append({x for part in parts for x in part})
            else:
                own = exact([(op, arg)])
                if own is None:
                    self.flush()
                else:
                    self.grow(own)


def exact(items) -> set[str] | None:
    """All strings that a part can match, in lower case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.SUBPATTERN:
            own = exact(arg[-1])
        elif op is C.BRANCH:
            parts = [exact(part) for part in arg[1]]
            own = None if None in parts else {s for part in parts for s in part}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            own = {chr(v).lower() for _, v in arg}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            own = exact(arg[2])
            own = own and (own | {""} if arg[0] == 0 else own)
        elif op is C.AT:
            own = {""}
        else:
            return None
        if own is None or len(out) * len(own) > MOST:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def dnf(items) -> Query:
    walk = _Walk()
    walk.sequence(items)
    walk.flush()
    out: set[frozenset[str]] = {frozenset()}
    for condition in walk.conditions:
        grown = {a | b for a, b in product(out, condition)}
        out = grown if len(grown) <= MOST else out
    if out == {frozenset()}:
        return []
    return sorted((x for x in out if not any(y < x for y in out)), key=sorted)


def query(pattern: str) -> Query:
    """The trigram sets of which a matching text holds at least one; empty if every text must be scanned."""
    return dnf(_parser.parse(pattern))
