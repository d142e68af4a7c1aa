"""Patterns as column expressions, guarded by literals that any match must hold.

A guard is a few plain substring searches, far cheaper than the pattern; most texts fail it. Patterns run with Unix line
ends, so that ``.`` stops at newlines only.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _parser as sre  # the syntax tree of a pattern

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST, MOST = 3, 3


def _clauses(tree) -> list[tuple[str, ...]]:
    """Of a sequence, groups of literals of which every match holds one each."""
    out: list[tuple[str, ...]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= SHORTEST:
            out.append((run,))
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and 32 <= arg < 127:
            run += chr(arg)
            continue
        close()
        if name == "SUBPATTERN" and not arg[1] and not arg[2]:
            out += _clauses(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out += _clauses(arg[2])
        elif name == "BRANCH":
            each = [_clauses(x) for x in arg[1]]
            if all(each):
                out.append(tuple(sorted({x for c in each for x in _best(c)})))
    close()
    return out


def _best(clauses: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The most telling of the groups: the fewest literals, then the longest."""
    return min(clauses, key=lambda c: (len(c), -min(map(len, c))))


@lru_cache(maxsize=10_000)
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Up to ``MOST`` groups of literals, most telling first: a text that misses all of a group has no match of ``pattern``."""
    found = sorted(set(_clauses(sre.parse(pattern))), key=lambda c: (len(c), -min(map(len, c)), c))
    return tuple(found[:MOST])


def may_hit(text: Column, pattern: str) -> Column | None:
    """Whether ``text`` holds what every match needs; None where nothing is certain."""
    groups = [reduce(lambda a, b: a | b, [text.contains(x) for x in g]) for g in required(pattern)]
    return reduce(lambda a, b: a & b, groups) if groups else None


def hit(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs in ``text`` (lower case); null text gives false."""
    found = text.rlike(f"(?d){pattern}")
    guard = may_hit(text, pattern)
    return F.coalesce(found if guard is None else guard & found, F.lit(False))


def any_hit(text: Column, patterns: list[str]) -> Column:
    out = hit(text, patterns[0])
    for p in patterns[1:]:
        out = out | hit(text, p)
    return out
