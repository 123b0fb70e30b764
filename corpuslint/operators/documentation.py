"""Documentation checks: docstrings, comments, routes without description, readme parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.patterns import matches, sql_text
from ..functions.text import MATCH_LINE, contains_any, cut, line_at, match_lines, numbered, sql_strip, strip
from ..packs import probes as pack
from ..packs.catalog import DOCUMENTATION
from .probe import Probe, content, each_match, hit, lines, no_hits, pattern_gate, whole_file

CHECKS = {check.check_id: check for check in DOCUMENTATION}


def _body_has(words: tuple[str, ...], reach: int = 500) -> str:
    """Optional look-ahead group: filled when a word ends within ``reach`` characters."""
    choices = "|".join(f"(?s:.){{0,{reach - len(word)}}}?{word}" for word in words)
    return f"(?=({choices})?)"


FUNCTION = pack.Pattern(pack.DOCUMENTED_FUNCTION, needles=("def",))


def module_text() -> Probe:
    """DOC001: code among the first ten lines and no docstring at the very start."""

    def gate() -> Column:
        undocumented = ~content().startswith('"""') & ~content().startswith("'''")
        top = F.slice(F.split(content(), "\n", -1), 1, 10)
        code = F.exists(top, lambda line: (strip(line) != "") & ~strip(line).startswith("#"))
        return undocumented & code

    return whole_file(CHECKS["DOC001"], "documentation", gate)


VISIBLE = "(NOT startswith(m.g1, '_') OR m.g1 IN ({}))".format(
    ", ".join(sql_text(name) for name in pack.DOCUMENTED_ANYWAY)
)


def _functions(check_id: str, keep: str, snippet: str = "''", words=(), filled: str = "") -> Probe:
    """``words`` must be missing from the text behind the head: group 5 stays empty. ``filled`` is a pattern that any head
    to be kept matches."""
    pattern = FUNCTION._replace(ahead=_body_has(words) if words else "")
    groups = (1, 2, 3, 4, 5) if words else (1, 2, 3, 4)
    gate = pattern_gate([FUNCTION._replace(regex=filled)]) if filled else pattern_gate([FUNCTION])
    return Probe(
        check_id, "documentation", gate,
        lambda: each_match(
            CHECKS[check_id], pattern, groups,
            keep=f"{VISIBLE} AND {keep}", snippet=snippet, what="m.g1",
        ),
        self_gated=not filled,
    )


def function_docstrings() -> Probe:
    """DOC002."""
    return _functions(
        "DOC002", "m.g4 = ''", "concat('def ', m.g1, '(', m.g2, '):')"
    )


DOCUMENTED_WITH_PARAMETERS = f"m.g4 <> '' AND {sql_strip('m.g2')} <> ''"


# Heads with a docstring, and those that say what they return as well: the optional groups of the pattern, filled.
QUOTED = pack.DOCUMENTED_FUNCTION.removesuffix("?")
TYPED_AND_QUOTED = QUOTED.replace("+))?", "+))")


def argument_sections() -> Probe:
    """DOC003."""
    return _functions("DOC003", f"{DOCUMENTED_WITH_PARAMETERS} AND m.g5 = ''",
                      words=pack.ARGUMENT_WORDS, filled=QUOTED)


def return_sections() -> Probe:
    """DOC004."""
    return _functions(
        "DOC004", f"{DOCUMENTED_WITH_PARAMETERS} AND m.g3 NOT IN ('', 'None') AND m.g5 = ''",
        words=pack.RETURN_WORDS, filled=TYPED_AND_QUOTED,
    )


def class_docstrings() -> Probe:
    """DOC005."""
    pattern = pack.Pattern(pack.DOCUMENTED_CLASS, needles=("class",))
    return Probe(
        "DOC005", "documentation", pattern_gate([pattern]),
        lambda: each_match(
            CHECKS["DOC005"], pattern, (1, 2),
            keep="NOT startswith(m.g1, '_') AND m.g2 = ''",
            snippet="concat('class ', m.g1, ':')", what="m.g1",
        ),
        self_gated=True,
    )


def _first(found: Column, limit: int | None) -> Column:
    """The first ``limit`` entries, or all of them."""
    return found if limit is None else F.slice(found, 1, limit)


def empty_comments(limit: int | None = 3) -> Probe:
    """DOC006: the first few comments per file that say nothing."""
    empty = "|".join(f"(?:{p})" for p in pack.EMPTY_COMMENTS)

    def rows() -> Column:
        comments = F.filter(
            F.transform(
                numbered(lines()),
                lambda x: F.struct(x["n"].alias("n"), strip(x["line"]).alias("t")),
            ),
            lambda x: x["t"].startswith("#")
            & ~contains_any(F.lower(x["t"]), pack.HEADER_WORDS)
            & matches(x["t"], empty, ignore_case=True),
        )
        return F.transform(
            _first(comments, limit),
            lambda x: hit(CHECKS["DOC006"], x["n"], cut(x["t"], 80)),
        )

    return Probe("DOC006", "documentation", lambda: content().contains("#"), rows)


def todo_marks(limit: int | None = 5) -> Probe:
    """DOC007: the first few marks per file, by kind and then by place."""

    def rows() -> Column:
        found = [
            each_match(
                CHECKS["DOC007"], word, ignore_case=True,
                snippet=f"substring({sql_strip(MATCH_LINE)}, 1, 100)",
            )
            for word in pack.TODO_WORDS
        ]
        return _first(F.concat(*found), limit)

    return Probe("DOC007", "documentation",
                 pattern_gate(pack.TODO_WORDS, ignore_case=True), rows)


def api_routes(limit: int | None = 5) -> Probe:
    """DOC008: the first few routes per file whose next five lines hold no description."""

    def rows() -> Column:
        found = []
        for route in pack.API_ROUTES:
            places = F.transform(
                match_lines(route.regex),
                lambda n: F.struct(n.alias("n"), F.lit(route.what).alias("what")),
            )
            none = F.array().cast("ARRAY<STRUCT<n: INT, what: STRING>>")
            found.append(F.when(pattern_gate([route])(), places).otherwise(none))
        bare = F.filter(
            _first(F.concat(*found), limit),
            lambda r: ~F.exists(
                F.slice(lines(), r["n"] + 1, 5), lambda line: contains_any(line, pack.DOC_MARKS)
            ),
        )
        return F.transform(
            bare,
            lambda r: hit(CHECKS["DOC008"], r["n"],
                          cut(strip(line_at(lines(), r["n"])), 80), r["what"]),
        )

    return Probe("DOC008", "documentation", pattern_gate(pack.API_ROUTES), rows)


def readme_parts() -> Probe:
    """DOC009."""

    def missing() -> Column:
        lowered = F.lower(content())
        present = [
            matches(content(), pack.README_TITLE, multiline=True),
            lowered.contains("install"),
            contains_any(lowered, ("usage", "example")),
            lowered.contains("license"),
        ]
        return F.array_compact(F.array(*[
            F.when(~has, F.lit(part)) for has, part in zip(present, pack.README_PARTS)
        ]))

    def rows() -> Column:
        report = hit(CHECKS["DOC009"], F.lit(1), what=F.array_join(missing(), ", "))
        return F.when(F.size(missing()) > 0, F.array(report)).otherwise(no_hits())

    return Probe("DOC009", "documentation",
                 lambda: F.lower(F.col("path")).contains("readme"), rows)


def probes(comments: int | None = 3, marks: int | None = 5, routes: int | None = 5) -> list[Probe]:
    """All checks; the numbers limit DOC006, DOC007 and DOC008 per file, ``None`` reports all."""
    return [
        module_text(), function_docstrings(), argument_sections(), return_sections(), class_docstrings(),
        empty_comments(comments), todo_marks(marks), api_routes(routes), readme_parts(),
    ]
