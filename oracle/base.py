"""Building blocks of the comparison SQL (DuckDB dialect).

The SQL explodes lines and uses window functions, while the engine works on arrays inside
the row, so the two sides share patterns and texts but not the way they compute."""

from __future__ import annotations

import re

from corpuslint.packs import catalog
from corpuslint.sources.samples import TEMPLATES, template_path

WORD, DIGIT = r"\pL\pN_", r"\p{Nd}"
SPACE = r"\t-\r\x1c-\x1f \x{85}\pZ"
CHECKS = {check.check_id: check for check in catalog.ALL}
LIMITS = {"QUAL001": "120", "QUAL002": "50"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    """A pattern with its Unicode classes spelled out, as a SQL literal."""
    classes = {"w": WORD, "d": DIGIT, "s": SPACE}
    out, inside, i = [], False, 0
    while i < len(pattern):
        ch, nxt = pattern[i], pattern[i + 1 : i + 2]
        if ch == "\\" and nxt:
            if nxt in classes:
                out.append(classes[nxt] if inside else f"[{classes[nxt]}]")
            elif nxt == "S":
                out.append(f"[^{SPACE}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        inside = (ch == "[") or (inside and ch != "]")
        out.append(ch)
        i += 1
    return q((f"(?{flags})" if flags else "") + "".join(out))


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def plain(letter: str, text: str = "content") -> str:
    """RE2 knows ASCII word boundaries only: letters beyond ASCII become one ASCII letter
    that the pattern in question treats the same way."""
    return f"regexp_replace({text}, '[^\\x00-\\x7f]', '{letter}', 'g')"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def count_text(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(needle)}, ''))) // {len(needle)})"


def any_of(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def _suffix(ending: str) -> str:
    return ending[ending.rindex("."):]


VALUES = ",\n".join(
    f"({i}, {q(template_path(name))}, {q(_suffix(name))}, {q(code)})"
    for i, (name, code) in enumerate(TEMPLATES)
)
CODE_FILES = f"""templates(kind, ending, ext, code) AS (VALUES {VALUES}),
code_files AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id,
         'src/m' || (doc_id % 7) || '/f' || doc_id || ending AS path, ext,
         code || chr(10) || text AS content
  FROM documents JOIN templates ON doc_id % {len(TEMPLATES)} = kind)"""

LINES = f"""lines AS (
  SELECT file_id, path, ext, n, line, {strip('line')} AS t FROM (
    SELECT file_id, path, ext, unnest(string_split(content, chr(10))) AS line,
           generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code_files))"""


def suffix_test(suffixes) -> str:
    return "ext IN (" + ", ".join(q(s) for s in suffixes) + ")"


def fill(template: str, check_id: str, n="n", what="''", count="0") -> str:
    """A report text as a SQL concatenation."""
    places = {"line": n, "what": what, "count": count, "limit": q(LIMITS.get(check_id, ""))}
    parts = [
        f"CAST({places[part]} AS VARCHAR)" if i % 2 else q(part)
        for i, part in enumerate(re.split(r"\{(line|what|count|limit)\}", template)) if part
    ]
    return " || ".join(parts) if parts else "''"


def finding(check_id: str, n="0", snippet="''", what="''", count="0", severity=None) -> str:
    """The select list of one finding."""
    c = CHECKS[check_id]
    return (
        f"file_id, path, {q(check_id)} AS check_id, {fill(c.name, check_id, n, what, count)} AS check_name, "
        f"{q(c.category)} AS category, {severity or q(c.severity)} AS severity, "
        f"CAST({n} AS INTEGER) AS line_number, {fill(c.message, check_id, n, what, count)} AS message, "
        f"{snippet} AS snippet, {fill(c.suggestion, check_id, n, what, count)} AS suggestion, "
        f"{q(c.rule_id)} AS rule_id"
    )


def match_cte(name: str, pattern: str, suffixes, flags: str = "", text: str = "content",
              groups=(), extra: str = "") -> str:
    """CTE with one row per match: line n, ordinal, match text, groups and end offset."""
    regex = re2(pattern, flags)
    anchored = re2(f"^(?:{pattern})", flags.replace("m", ""))
    cols = "".join(f", regexp_extract(part, {anchored}, {g}) AS g{g}" for g in groups)
    frame = "(PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS (
  SELECT file_id, path, ext, content, i - 1 AS k, 1 + nl AS n, off{cols}{extra} FROM (
    SELECT *, sum({newlines('part')}) OVER {frame} AS nl, sum(length(part)) OVER {frame} AS off FROM (
      SELECT file_id, path, ext, content, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
        SELECT file_id, path, ext, content,
               string_split(regexp_replace(txt, {regex}, chr(1) || '\\0', 'g'), chr(1)) AS parts
        FROM (SELECT *, {text} AS txt FROM code_files WHERE {suffix_test(suffixes)})
        WHERE regexp_matches(txt, {regex}))))
  WHERE i > 1)"""


def with_line(name: str) -> str:
    """Join match rows with the text of their line."""
    return f"{name} JOIN lines USING (file_id, path, ext, n)"
