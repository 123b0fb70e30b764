"""Literal text that every match of a user pattern must contain, proven from its parse tree.

Texts and literals are compared folded: character by character in lower case, with the letters that equal an ASCII letter
when case is ignored written as that letter. Folding maps every character on its own, so a literal inside a text is
inside the folded text as well."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as c, _parser as parser

import pyarrow as pa
from pyspark.sql import Column, functions as F

LEAST = 3
MOST_ALTERNATIVES = 16


def folder() -> Callable[[str], str]:
    """The folding, as a function that needs no import of this package where it runs."""
    letters = {"ς": "σ", "ſ": "s", "ı": "i", "̇": None}

    def fold(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Only the capital sigma is lowered by what stands around it.
        return text.replace("Σ", "σ").lower().translate(str.maketrans(letters))

    return fold


fold = folder()


def _better(one: frozenset[str] | None, other: frozenset[str] | None) -> frozenset[str] | None:
    def worth(texts: frozenset[str]) -> tuple[int, int]:
        return min(map(len, texts)), -len(texts)

    if not one or not other:
        return one or other
    return max(one, other, key=worth)


def _needed(parts, flags: int) -> frozenset[str] | None:
    """Texts of which every match of a sequence contains one."""
    best, run = None, ""
    for kind, value in parts:
        if kind is c.LITERAL and (chr(value).isascii() or not flags & re.IGNORECASE):
            run += fold(chr(value))
            continue
        best, run = _better(best, frozenset([run]) if run else None), ""
        inner = None
        if kind is c.SUBPATTERN:
            inner = _needed(value[3], (flags | value[1]) & ~value[2])
        elif kind is c.BRANCH:
            branches = [_needed(branch, flags) for branch in value[1]]
            if all(branches):
                inner = frozenset().union(*branches)
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2], flags)
        elif kind is c.ATOMIC_GROUP:
            inner = _needed(value, flags)
        if inner and len(inner) <= MOST_ALTERNATIVES:
            best = _better(best, inner)
    return _better(best, frozenset([run]) if run else None)


@lru_cache(maxsize=100_000)
def needed_literals(pattern: str) -> tuple[str, ...]:
    """Folded texts of at least ``LEAST`` characters of which every match contains one; none if that cannot be proven."""
    compiled = re.compile(pattern)
    found = _needed(parser.parse(pattern), compiled.flags)
    return tuple(sorted(found)) if found and min(map(len, found)) >= LEAST else ()


def occurring(text: Column, literals: list[tuple[str, ...]]) -> Column:
    """array<int>: the numbers, ascending, of those tuples of which a literal occurs in the text.

    One automaton over all literals reads every text once, however many there are."""
    numbers: dict[str, list[int]] = {}
    for i, texts in enumerate(literals):
        for t in texts:
            numbers.setdefault(t, []).append(i)
    make = folder

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine, folded = ahocorasick.Automaton(), make()
        for t, which in numbers.items():
            machine.add_word(t, (t, which))
        machine.make_automaton()
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                seen = {t: which for _, (t, which) in machine.iter(folded(value))} if value else {}
                rows.append(sorted({i for which in seen.values() for i in which}))
            yield pa.array(rows, pa.list_(pa.int32()))

    def by_value(function):
        import types

        return types.FunctionType(function.__code__, {"__builtins__": __builtins__}, function.__name__, None, function.__closure__)

    make = by_value(folder)
    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "array<int>")(text)
