"""Regular expressions: the pattern packs are written in the usual short notation
(``\\w``, ``\\s``, ``\\b`` over Unicode text) and spelled out here as explicit
character classes, so that a pattern means the same on every Java version."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from re import _constants as c, _parser as parser

import pyarrow as pa
from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f \x85\p{Z}"
DIGIT = r"\p{Nd}"
_CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Characters that str.strip() style trimming removes; Spark's trim takes them as a set.
WHITESPACE = (
    "".join(map(chr, range(0x09, 0x0E)))
    + "".join(map(chr, range(0x1C, 0x21)))
    + "\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


class Translated(str):
    """A pattern that is already spelled out for the engine; nothing is derived from its text."""

    groups = 0


@lru_cache(maxsize=None, typed=True)
def java_regex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Spell a pattern out for ``java.util.regex`` with Unicode classes and ``\\n`` line ends."""
    if isinstance(pattern, Translated):
        return str(pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[nxt.lower()]}]")
            elif nxt == "b" and not in_class:
                out.append(_boundary(pattern, i))
            else:
                out.append(ch + nxt)
            i += 2
            continue
        named = re.match(r"\(\?P<(\w+)>|\(\?P=(\w+)\)", pattern[i:]) if not in_class else None
        if named:
            # Named groups: the engine writes them without the P and without underscores.
            group = (named[1] or named[2]).replace("_", "")
            out.append(f"(?<{group}>" if named[1] else f"\\k<{group}>")
            i += named.end()
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        if ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    flags = "d" + ("iu" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags})" + "".join(out)


_WORD_GROUP = re.compile(r"\((?:\?:)?([A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)*)\)")
_WORD_CLASS = re.compile(r"\(?(\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\])")


def _boundary(pattern: str, at: int) -> str:
    """A word boundary next to a plain word character needs only one look-around, and
    looking at the next character first rejects most places cheaply."""
    rest, before = pattern[at + 2 :], pattern[at - 1 : at] if at else ""
    group, listed = _WORD_GROUP.match(rest), _WORD_CLASS.match(rest)
    coming = None
    if rest[:1].isalnum() or rest[:1] == "_":
        coming = rest[0]
    elif rest[:2] in (r"\w", r"\d"):
        coming = f"[{_CLASSES[rest[1]]}]"
    elif listed:
        coming = listed[1]
    elif group:
        coming = "[" + "".join(sorted({word[0] for word in group[1].split("|")})) + "]"
    if coming is not None:
        return f"(?={coming})(?<![{WORD}])"
    escaped = at >= 2 and pattern[at - 2] == "\\"
    if (before.isalnum() or before == "_") and (not escaped or before in "wd"):
        return f"(?![{WORD}])"
    return _BOUNDARY


def atomic(pattern: str) -> str:
    """The pattern without backtracking into a finished match. Plain letters at its start
    stay outside the group, where the engine searches for them fastest."""
    lead = re.match(r"[A-Za-z]*(?![A-Za-z?*+{|])", pattern)[0] if "|" not in pattern else ""
    return f"{lead}(?>{pattern[len(lead):]})"


@lru_cache(maxsize=None, typed=True)
def required_text(pattern: str) -> str:
    """The longest plain text that every match must contain, or an empty string.

    Only the top level counts: groups and classes end a run, a quantifier removes the
    character it applies to, and a top-level alternative means nothing is required.
    """
    if isinstance(pattern, Translated):
        return ""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            token, literal = pattern[i : i + 2], not pattern[i + 1 : i + 2].isalnum()
            char = pattern[i + 1 : i + 2]
        elif ch == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            token, literal, char = pattern[i : end + 1], False, ""
        elif ch == "{" and re.match(r"\{\d*,?\d*\}", pattern[i:]):
            token, literal, char = pattern[i : pattern.index("}", i) + 1], False, ""
        else:
            token, literal, char = ch, ch not in "().^$*+?{}|[]", ch
        if ch == "|" and depth == 0:
            return ""
        depth += (token == "(") - (token == ")")
        quantified = pattern[i + len(token) : i + len(token) + 1] in tuple("?*{")
        if depth == 0 and literal and not quantified:
            run += char
            if pattern[i + len(token) : i + len(token) + 1] == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        i += len(token)
    return max([*runs, run], key=len)


def is_plain(pattern: str) -> bool:
    """True for patterns that are nothing but literal text."""
    text = required_text(pattern)
    return text != "" and re.escape(text).replace("\\", "") == pattern.replace("\\", "") and (
        re.fullmatch(pattern, text) is not None and not re.search(r"\\[A-Za-z0-9]|[.^$*+?{}|\[\]()]",
                                                               re.sub(r"\\\W", "", pattern))
    )


def matches(column: Column, pattern: str, **flags: bool) -> Column:
    """True where the pattern occurs anywhere in the text; required text is looked for
    first, as a search for plain bytes is far cheaper than a regex."""
    test = F.regexp_like(column, F.lit(java_regex(pattern, **flags)))
    text = "" if flags else required_text(pattern)
    return column.contains(text) & test if text else test


def occurrences(column: Column, pattern: str, **flags: bool) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(column, F.lit(java_regex(pattern, **flags)))


def extract(column: Column, pattern: str, group: int = 0, **flags: bool) -> Column:
    """One group of every non-overlapping match, in text order."""
    return F.regexp_extract_all(column, F.lit(java_regex(pattern, **flags)), F.lit(group))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Letters and the blank by how often they occur, most first; all else is taken for rarer.
FREQUENT = " etaoinsrhldcumfpgwybv"
LEAST_END, LEAST_TOGETHER = 3, 40
_TOGETHER: ContextVar[set[str] | None] = ContextVar("together", default=None)


@contextmanager
def searched_together() -> Iterator[set[str]]:
    """Within it, SQL tests for plain texts in ``content`` are read off a column ``marks`` (see ``marks``), which holds
    every text of the set that occurs; the set fills as tests are written."""
    token = _TOGETHER.set(set())
    try:
        yield _TOGETHER.get()
    finally:
        _TOGETHER.reset(token)


def rare_end(text: str) -> str:
    """The end of a text from its rarest character on; a search that starts there stops at few places."""
    def rarity(i: int) -> int:
        at = FREQUENT.find(text[i])
        return len(FREQUENT) if at < 0 else at

    return text[max(range(max(1, len(text) - LEAST_END + 1)), key=lambda i: (rarity(i), -i)):]


def sql_contains(column: str, text: str) -> str:
    """SQL test: a plain substring occurs."""
    test, together = f"contains({column}, {sql_text(text)})", _TOGETHER.get()
    if together is None or column != "content" or len(text) < LEAST_END or not re.fullmatch("[ -~]+", text):
        return test
    end = rare_end(text)
    together.add(end)
    marked = f"contains(marks, {sql_text(end)})"
    return marked if end == text else f"({marked} AND {test})"


def marks(texts: Iterable[str]) -> Column:
    """Text that contains one of ``texts`` (ASCII, no line end) exactly if ``content`` does: those that occur, each once.

    One automaton over all texts reads every content once, whatever their number; its bytes are taken one by one, so they
    need not be valid text."""
    texts = sorted(texts)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text in texts:
            machine.add_word(text, text)
        machine.make_automaton()
        for batch in batches:
            rows = []
            for value in batch:
                content = value.as_py()
                found = None if content is None else {text for _, text in machine.iter(content.decode("latin-1"))}
                rows.append(None if found is None else "\n".join(sorted(found)))
            yield pa.array(rows, pa.string())

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "string")(F.col("content").cast("binary"))


def sql_all(tests: list[str]) -> str:
    """SQL test: all hold, none evaluated before those in front of it hold. The engine computes a test that it sees more
    than once ahead of an AND, for every row; it does not do so inside an IF."""
    return tests[0] if len(tests) == 1 else f"IF({tests[0]}, {sql_all(tests[1:])}, false)"


def sql_any(column: str, needles) -> str:
    """SQL test: at least one plain substring occurs."""
    return "(" + " OR ".join(sql_contains(column, n) for n in needles) + ")"


def _needed(parts) -> list[frozenset[str]]:
    """Sets of plain texts of a parsed sequence; every match contains at least one text of each set."""
    found, run = [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is c.LITERAL and 32 <= value < 127:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if kind is c.SUBPATTERN and not value[1] and not value[2]:
            found += _needed(value[3])
        elif kind is c.BRANCH:
            branches = [max(_needed(branch), key=lambda texts: min(map(len, texts)), default=None) for branch in value[1]]
            if all(branches):
                found.append(frozenset().union(*branches))
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _needed(value[2])
        elif kind is c.ATOMIC_GROUP:
            found += _needed(value)
    return found


@lru_cache(maxsize=None, typed=True)
def needed_texts(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Tuples of plain texts, the longest first; every match of the pattern contains at least one text of each tuple."""
    if isinstance(pattern, Translated):
        return ()
    try:
        parsed = parser.parse(pattern)
    except re.error:  # written for the engine only
        return ()
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ()
    return tuple(sorted((tuple(sorted(s)) for s in set(_needed(parsed))), key=lambda s: (-min(map(len, s)), s)))


def sql_matches(column: str, pattern: str, **flags: bool) -> str:
    """SQL test: the pattern occurs. See ``matches``."""
    test = f"regexp_like({column}, {sql_text(java_regex(pattern, **flags))})"
    together = _TOGETHER.get() is not None and column == "content" and not flags.get("ignore_case")
    if together and not is_plain(pattern):
        # A search for plain texts costs next to nothing here, so all that a match needs are looked for.
        return sql_all([*[sql_any(column, texts) for texts in needed_texts(pattern)], test])
    if flags:
        return test
    text = required_text(pattern)
    if text and is_plain(pattern):
        return sql_contains(column, text)
    return f"({sql_contains(column, text)} AND {test})" if text else test


# SQL: content in lower case with the letters that equal an ASCII letter when case is
# ignored written as that letter. Text is only tested for plain words in this form.
FOLDED = (
    "IF(octet_length(content) = char_length(content) OR NOT (contains(content, '\u017f') OR "
    "contains(content, '\u0131') OR contains(content, '\u0130') OR contains(content, '\u0307') OR "
    "contains(content, '\u212a')), lower(content), "
    "translate(lower(content), '\u017f\u0131\u212a\u0307', 'sik'))"
)
