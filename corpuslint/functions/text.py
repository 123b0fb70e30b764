"""Line and text expressions. All of them work inside one row: an array of lines is
an ordinary column, so a check over a file needs neither an explode nor a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .patterns import FOLDED, WHITESPACE, Translated, atomic, java_regex, occurrences, sql_text

MARK = "\x01"


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(WHITESPACE))


def lstrip(column: Column) -> Column:
    return F.ltrim(column, F.lit(WHITESPACE))


def indent(line: Column) -> Column:
    """Width of the leading white space; a tab counts one."""
    return F.length(line) - F.length(lstrip(line))


def split_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def newlines(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n")))


def line_count(content: Column, lines: Column | None = None) -> Column:
    """Lines as a text reader counts them: a final newline does not open another one. The array of lines, where there is
    one, saves a search for the newlines."""
    unfinished = (content != "") & ~content.endswith("\n")
    return (newlines(content) if lines is None else F.array_size(lines) - 1) + unfinished.cast("int")


def count_text(content: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a plain substring; a text without any is only searched, which is cheaper."""
    removed = F.length(content) - F.length(F.replace(content, F.lit(needle)))
    return F.when(~content.contains(needle), 0).otherwise((removed / len(needle)).cast("int"))


def contains_any(column: Column, needles) -> Column:
    """True where at least one plain substring occurs."""
    found = F.lit(False)
    for needle in needles:
        found = found | column.contains(needle)
    return found


def with_lines(files: DataFrame) -> DataFrame:
    """Add what many checks read, once per file: the ``lines`` array and the ``folded`` text."""
    return files.withColumns({"lines": split_lines(F.col("content")), "folded": F.expr(FOLDED)})


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``body`` use it any number of times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(ordered: Column) -> Column:
    """Neighbours with the same ``name`` as arrays of their own; linear, for an array that is sorted by name."""
    def cut_at(at: Column) -> Column:
        return F.transform(
            at, lambda s, k: F.slice(ordered, s + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - s)
        )

    starts = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda i: F.when(i > 0, F.get(ordered, i)["name"] != F.get(ordered, i - 1)["name"]).otherwise(True),
    )
    return F.when(F.size(ordered) > 0, bind(starts, cut_at)).otherwise(F.array())


def numbered(lines: Column) -> Column:
    """array<struct<n, line>> with 1-based numbers."""
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), line.alias("line")))


def _match_lines_sql(pattern: str, **flags: bool) -> str:
    regex = sql_text(java_regex(pattern, **flags))
    return (
        "flatten(transform(arrays_zip("
        f"split(regexp_replace(content, {regex}, {sql_text(MARK + '$0')}), '\\n', -1), lines), "
        "(pair, i) -> array_repeat(i + 1, octet_length(pair.`0`) - octet_length(pair.lines))))"
    )


def match_lines(pattern: str, **flags: bool) -> Column:
    """Start line of every match in ``content``, in text order.

    A one-character mark goes in front of each match; a marked line is longer than
    the original line by its number of matches, whatever the text contains.
    """
    return F.expr(_match_lines_sql(pattern, **flags))


def matches_of(regex: Column) -> Column:
    """array<struct<n, g0>>, start line and text of every match of a regex that is a value."""
    content, lines = F.col("content"), F.col("lines")
    marked = F.split(F.regexp_replace(content, regex, F.lit(MARK + "$0")), "\n", -1)
    starts = F.flatten(F.transform(
        F.arrays_zip(marked.alias("marked"), lines),
        lambda pair, i: F.array_repeat(i + 1, F.octet_length(pair["marked"]) - F.octet_length(pair["lines"])),
    ))
    found = F.regexp_extract_all(content, regex, F.lit(0))
    return F.transform(F.arrays_zip(starts.alias("n"), found.alias("g0")), lambda m: F.struct(m["n"], m["g0"]))


def match_table_sql(
    pattern: str, groups: tuple[int, ...] = (), ahead: str = "", **flags: bool
) -> str:
    """SQL: array<struct<n, g0, …>>, start line and chosen groups of every match.

    The text is searched once for the matches; their groups are read off the short match
    texts. ``ahead`` is an optional look-ahead behind the pattern. Its groups continue the
    numbering and need one search each; the atomic group keeps it from moving a match end.
    """
    inner = pattern.groups if isinstance(pattern, Translated) else re.compile(pattern).groups
    whole = atomic(pattern) + ahead if ahead else pattern
    regex = sql_text(java_regex(whole, **flags))
    own = sql_text(java_regex(f"\\A(?:{pattern})\\z", **flags))
    columns = [_match_lines_sql(whole, **flags), f"regexp_extract_all(content, {regex}, 0)"]
    fields = ["'n', z.`0`"]
    for group in groups:
        if group == 0:
            fields.append("'g0', z.`1`")
        elif group <= inner:
            fields.append(f"'g{group}', regexp_extract(z.`1`, {own}, {group})")
        else:
            fields.append(f"'g{group}', z.`{len(columns)}`")
            columns.append(f"regexp_extract_all(content, {regex}, {group})")
    if not groups:
        columns = columns[:1]
        return f"transform({columns[0]}, z -> named_struct('n', z))"
    return f"transform(arrays_zip({', '.join(columns)}), z -> named_struct({', '.join(fields)}))"


def match_table(
    pattern: str, groups: tuple[int, ...] = (), ahead: str = "", **flags: bool
) -> Column:
    return F.expr(match_table_sql(pattern, groups, ahead, **flags))


def sql_strip(text: str) -> str:
    return f"trim(BOTH {sql_text(WHITESPACE)} FROM {text})"


# SQL: the line a match row starts on.
MATCH_LINE = "coalesce(try_element_at(lines, m.n), '')"


def line_at(lines: Column, number: Column) -> Column:
    """Text of a 1-based line, empty outside the file."""
    return F.coalesce(F.try_element_at(lines, number), F.lit(""))


def cut(column: Column, length: int) -> Column:
    return F.substring(column, 1, length)


def context_window(lines: Column, number: Column) -> Column:
    """Two lines on each side of a line, the line itself marked with ``>>> ``."""
    first = F.greatest(F.lit(1), number - 2)
    last = F.least(F.size(lines), number + 2)
    shown = F.transform(
        F.slice(lines, first, last - first + 1),
        lambda line, i: F.concat(
            F.when(first + i == number, F.lit(">>> ")).otherwise(F.lit("    ")), line
        ),
    )
    return F.array_join(shown, "\n")


def code_line_count(lines: Column) -> Column:
    """Non-blank, non-comment lines outside triple-quoted text."""

    def step(acc: Column, line: Column) -> Column:
        text = strip(line)
        odd = (count_text(text, '"""') % 2 == 1) | (count_text(text, "'''") % 2 == 1)
        quoted = acc["quoted"] != odd
        counted = (text != "") & ~quoted & ~text.startswith("#") & ~text.startswith("//")
        return F.struct(quoted.alias("quoted"), (acc["n"] + counted.cast("int")).alias("n"))

    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("n"))
    return F.aggregate(lines, start, step)["n"]


# Words and operators that add a path through the code.
BRANCH_WORDS = (
    "if", "else", "elif", "for", "while", "do", "switch", "case", "catch", "try", "finally",
    "and", "or",
)
BRANCH_MARKS = ("&&", "||")

# Structure counters.
STRUCTURE = {
    "classes": r"\bclass\s+\w+",
    "functions": r"\b(?:def|fn|func|function)\s+\w+",
    "imports": r"\b(?:import|from|require)\b",
    "comments": r"#.*|//.*|/\*.*?\*/",
    "async_marks": r"\basync\b|\bawait\b",
    "types": r":\s*\w+|\binterface\b|\btype\s+\w+",
}

# Naming conventions.
NAMING = {
    "snake_case": r"^[a-z][a-z0-9_]*$",
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "SCREAMING_SNAKE_CASE": r"^[A-Z][A-Z0-9_]*$",
}


def complexity(content: Column) -> Column:
    """One plus the number of branch words and marks. Whole words exclude each other, so
    one alternation counts them all in a single pass over the text."""
    words = occurrences(content, r"\b(?:" + "|".join(BRANCH_WORDS) + r")\b")
    return words + count_text(content, BRANCH_MARKS[0]) + count_text(content, BRANCH_MARKS[1]) + 1


def naming_style(name: Column, convention: str = "snake_case") -> Column:
    """True where a name follows the convention; unknown conventions accept anything."""
    if convention not in NAMING:
        return F.lit(True)
    return F.regexp_like(name, F.lit("(?d)" + NAMING[convention]))
