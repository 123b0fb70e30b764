"""Patterns that users write in the dialect of Python's ``re``, spelled out for ``java.util.regex``.

The pattern is parsed by ``re`` itself and written anew from its parts, so flags, verbose mode, escapes, classes and
group names mean what they mean there. A part without a counterpart is reported as unsupported, never approximated."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as c, _parser as parser

from .patterns import DIGIT, SPACE, WORD, Translated

_UNICODE = {"DIGIT": DIGIT, "SPACE": SPACE, "WORD": WORD}
_ASCII = {"DIGIT": "0-9", "SPACE": r" \t-\r", "WORD": "A-Za-z0-9_"}
_SHIFTED = re.IGNORECASE | re.ASCII | re.DOTALL | re.MULTILINE


class Unsupported(ValueError):
    """A valid pattern that the engine cannot express."""


def _char(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else f"\\x{{{code:x}}}"


def _class(name: str, flags: int) -> str:
    chars = (_ASCII if flags & re.ASCII else _UNICODE)[name.rpartition("_")[2]]
    return f"[^{chars}]" if "_NOT_" in name else f"[{chars}]"


def _set(items: list, flags: int) -> str:
    negated = "^" if items and items[0][0] is c.NEGATE else ""
    parts = []
    for kind, value in items:
        if kind is c.LITERAL:
            parts.append(_char(value))
        elif kind is c.RANGE:
            parts.append(f"{_char(value[0])}-{_char(value[1])}")
        elif kind is c.CATEGORY:
            parts.append(_class(str(value), flags))
    return f"[{negated}{''.join(parts)}]"


def _boundary(name: str, flags: int) -> str:
    word = _class("CATEGORY_WORD", flags)
    if name == "AT_BOUNDARY":
        return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"


def _at(name: str, flags: int) -> str:
    if "BOUNDARY" in name:
        return _boundary(name, flags)
    if name == "AT_BEGINNING" and flags & re.MULTILINE:
        return r"(?:\A|(?<=\n))"
    if name == "AT_END":
        return r"(?=\n|\z)" if flags & re.MULTILINE else r"(?=\n?\z)"
    return {"AT_BEGINNING": r"\A", "AT_BEGINNING_STRING": r"\A", "AT_END_STRING": r"\z"}[name]


def _cased(text: str, flags: int) -> str:
    return text if not flags & re.IGNORECASE else f"(?{'i' if flags & re.ASCII else 'iu'}:{text})"


def _repeat(low: int, high: int, inner: str, mode: str) -> str:
    return f"(?:{inner}){{{low},{'' if high == c.MAXREPEAT else high}}}{mode}"


def _write(parts, flags: int) -> str:
    out = []
    for kind, value in parts:
        if kind is c.LITERAL:
            out.append(_cased(_char(value), flags))
        elif kind is c.NOT_LITERAL:
            out.append(_cased(f"[^{_char(value)}]", flags))
        elif kind is c.ANY:
            out.append(r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]")
        elif kind is c.IN:
            out.append(_cased(_set(value, flags), flags))
        elif kind is c.AT:
            out.append(_at(str(value), flags))
        elif kind is c.BRANCH:
            out.append(f"(?:{'|'.join(_write(branch, flags) for branch in value[1])})")
        elif kind is c.SUBPATTERN:
            group, added, removed, inner = value
            text = _write(inner, (flags | added) & ~removed & ~(re.ASCII if added & re.UNICODE else 0))
            out.append(f"({text})" if group is not None else f"(?:{text})")
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            mode = {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}[kind]
            out.append(_repeat(value[0], value[1], _write(value[2], flags), mode))
        elif kind is c.ATOMIC_GROUP:
            out.append(f"(?>{_write(value, flags)})")
        elif kind in (c.ASSERT, c.ASSERT_NOT):
            way = "<" if value[0] < 0 else ""
            out.append(f"(?{way}{'=' if kind is c.ASSERT else '!'}{_write(value[1], flags)})")
        elif kind is c.GROUPREF:
            out.append(_cased(f"(?:\\{value})", flags))
        elif kind is c.FAILURE:
            out.append("(?!)")
        else:
            raise Unsupported(f"{str(kind).lower()} is not supported")
    return "".join(out)


@lru_cache(maxsize=100_000)
def user_regex(pattern: str) -> Translated:
    """The pattern for the engine; ``re.error`` if it is invalid, ``Unsupported`` if it has no counterpart."""
    compiled = re.compile(pattern)
    parsed = parser.parse(pattern)
    text = Translated(_write(parsed, compiled.flags & _SHIFTED))
    text.groups = compiled.groups
    return text
