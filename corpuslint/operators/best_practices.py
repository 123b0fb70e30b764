"""Best-practice checks: error handling, resources, signatures, imports, constants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.patterns import extract, java_regex, matches, sql_text
from ..functions.text import (
    MATCH_LINE, bind, contains_any, count_text, cut, match_table, match_table_sql, numbered, runs, strip,
)
from ..packs import probes as pack
from ..packs.catalog import BEST_PRACTICES
from .probe import Probe, content, each_match, hit, lines, pattern_gate, whole_file

CHECKS = {check.check_id: check for check in BEST_PRACTICES}
PYTHON = (".py",)
SCRIPTS = (".js", ".ts")
DEF = ("def",)


HEAD = "concat('def ', m.g1, '(...):')"
PUBLIC = "(NOT startswith(m.g1, '_') OR m.g1 IN ({}))".format(
    ", ".join(sql_text(name) for name in pack.TYPED_ANYWAY)
)


def _by_match(check_id: str, pattern: pack.Pattern, groups=(), **options) -> Probe:
    return Probe(
        check_id, "best_practices", pattern_gate([pattern]),
        lambda: each_match(CHECKS[check_id], pattern, groups, **options), self_gated=True,
    )


def reraised() -> Probe:
    """BP002: the first line of the match says ``raise`` and no second ``raise`` with an
    argument follows the first one."""

    at = f"instr({MATCH_LINE}, 'raise')"
    rest = (
        f"concat(substring({MATCH_LINE}, 1, {at} - 1), "
        f"substring({MATCH_LINE}, {at} + 5, length({MATCH_LINE})))"
    )
    return _by_match("BP002", pack.Pattern(pack.RERAISE, needles=("except",)),
                     keep=f"{at} > 0 AND NOT contains({rest}, 'raise ')", snippet="''")


def missing_return_types() -> Probe:
    """BP005."""
    return _by_match(
        "BP005", pack.Pattern(pack.TYPED_FUNCTION, needles=DEF), (1, 2),
        keep=f"{PUBLIC} AND m.g2 = '' AND m.g1 <> '__init__'", snippet=HEAD, what="m.g1",
    )


def missing_parameter_types() -> Probe:
    """BP006: the first plain head ``def name(…):`` in the file, looked up by name, has
    no annotation. A look-ahead lists heads at every position, nested ones included."""
    plain_head = java_regex(r"(?=(def\s+(\w+)\s*\([^)]*\):))")
    pattern = pack.Pattern(pack.TYPED_FUNCTION, needles=DEF)

    def rows() -> Column:
        heads = F.arrays_zip(
            F.regexp_extract_all(content(), F.lit(plain_head), F.lit(1)).alias("head"),
            F.regexp_extract_all(content(), F.lit(plain_head), F.lit(2)).alias("name"),
        )

        functions = F.expr(
            f"filter({match_table_sql(pack.TYPED_FUNCTION, (1,))}, m -> {PUBLIC})"
        )

        def entry(name: Column, kind: int, at: Column, head: Column, n: Column) -> Column:
            return F.struct(name.alias("name"), F.lit(kind).alias("kind"), at.alias("at"), head.alias("head"), n.alias("n"))

        # Heads before functions, in the order of names; the first head of a name comes first in its run.
        named = F.array_sort(F.concat(
            F.transform(heads, lambda h, i: entry(h["name"], 0, i, h["head"], F.lit(0))),
            F.transform(functions, lambda m, i: entry(m["g1"], 1, i, F.lit(""), m["n"])),
        ))

        def bare(run: Column) -> Column:
            first = F.get(run, F.lit(0))
            plain = (first["kind"] == 0) & ~first["head"].contains("->") & ~first["head"].contains(": ")
            return F.filter(run, lambda x: (x["kind"] == 1) & plain)

        found = bind(named, lambda x: F.flatten(F.transform(runs(x), bare)))
        return F.transform(
            F.array_sort(F.transform(found, lambda x: F.struct(
                x["at"].alias("at"), x["n"].alias("n"), x["name"].alias("name")))),
            lambda x: hit(CHECKS["BP006"], x["n"], what=x["name"]),
        )

    return Probe("BP006", "best_practices", pattern_gate([pattern]), rows)


def missing_docstrings() -> Probe:
    """BP007: no triple quote in the 200 characters after the head. The look-ahead group
    is optional, so it never changes where a match ends."""
    near = r"""(?=((?s:.){0,197}?(?:\"\"\"|'''))?)"""
    pattern = pack.Pattern(pack.PUBLIC_FUNCTION, needles=DEF, ahead=near)
    return _by_match(
        "BP007", pattern, (1, 2), keep="m.g2 = ''", snippet=HEAD, what="m.g1",
    )


def late_imports() -> Probe:
    """BP008: an import word in line six or later, unless one of the comment lines at the
    very top (before the first code line, within the first five) has it too."""

    def importing(line: Column) -> Column:
        return contains_any(line, ("import ", "from "))

    def gate() -> Column:
        # The first code line as a number; a file without code has no header at all.
        def late(all_lines: Column) -> Column:
            top = F.slice(all_lines, 1, 5)
            is_code = F.transform(
                top, lambda line: (strip(line) != "") & ~strip(line).startswith("#")
            )
            first = F.array_position(is_code, F.lit(True)).cast("int")
            size = F.when(first > 0, first - 1).otherwise(
                F.when(
                    F.exists(
                        F.slice(all_lines, 6, F.greatest(F.size(all_lines), F.lit(1))),
                        lambda line: (strip(line) != "") & ~strip(line).startswith("#"),
                    ),
                    5,
                ).otherwise(0)
            )
            header = F.exists(
                F.transform(top, lambda line, i: (i < size) & importing(line)), lambda hit: hit
            )
            below = F.exists(
                F.slice(all_lines, 6, F.greatest(F.size(all_lines), F.lit(1))), importing
            )
            return below & ~header

        return contains_any(content(), ("import ", "from ")) & bind(lines(), late)

    return whole_file(CHECKS["BP008"], "best_practices", gate)


def circular_imports() -> Probe:
    """BP009: every ``from X import`` whose X has no dot."""
    pattern = pack.Pattern(pack.FROM_IMPORT, needles=("from",))

    def rows() -> Column:
        modules = F.filter(
            extract(content(), pack.FROM_IMPORT, 1), lambda name: ~name.contains(".")
        )
        return F.transform(modules, lambda name: hit(CHECKS["BP009"], what=name))

    return Probe("BP009", "best_practices", pattern_gate([pattern]), rows)


def constants() -> Probe:
    """BP010: one finding per distinct name, at its first assignment, when some
    assignment is not directly followed by another upper-case name."""
    pattern = pack.Pattern(pack.UPPERCASE_NAME, needles=pack.CONSTANT_WORDS, ahead=r"(?=([A-Z_])?)")

    def rows() -> Column:
        uses = F.filter(
            match_table(pattern.regex, (1, 2), pattern.ahead),
            lambda m: contains_any(m["g1"], pack.CONSTANT_WORDS),
        )

        named = F.array_sort(F.transform(uses, lambda m, i: F.struct(
            m["g1"].alias("name"), i.alias("at"), m["n"].alias("n"), (m["g2"] == "").alias("free"))))

        def first(run: Column) -> Column:
            top = F.get(run, F.lit(0))
            return F.struct(
                top["at"].alias("at"), top["n"].alias("n"), top["name"].alias("name"),
                F.exists(run, lambda x: x["free"]).alias("free"),
            )

        found = bind(named, lambda x: F.array_sort(F.transform(runs(x), first)))
        return F.transform(
            F.filter(found, lambda x: x["free"]), lambda x: hit(CHECKS["BP010"], x["n"], what=x["name"])
        )

    return Probe("BP010", "best_practices", pattern_gate([pattern]), rows)


def complex_comprehensions() -> Probe:
    """BP012."""

    def crowded(item: Column) -> Column:
        line = item["line"]
        many = (count_text(line, "for") > 2) | (count_text(line, "if") > 2)
        return line.contains("for") & line.contains("[") & many

    def rows() -> Column:
        return F.transform(
            F.filter(numbered(lines()), crowded),
            lambda item: hit(CHECKS["BP012"], item["n"], cut(strip(item["line"]), 80)),
        )

    return Probe("BP012", "best_practices",
                 lambda: content().contains("[") & content().contains("for"), rows)


def print_calls() -> Probe:
    """BP013: the first line that prints, ``def __repr__`` lines aside."""

    def rows() -> Column:
        hits = F.filter(
            numbered(lines()),
            lambda item: item["line"].contains("print")
            & matches(item["line"], pack.PRINT_CALL)
            & ~item["line"].contains("def __repr__"),
        )
        return F.transform(
            F.slice(hits, 1, 1), lambda item: hit(CHECKS["BP013"], item["n"])
        )

    gate = pattern_gate([pack.Pattern(pack.PRINT_CALL, needles=("print",))])
    return Probe("BP013", "best_practices", gate, rows, PYTHON)


def _unclosed_file() -> Column:
    return content().contains("open(") & ~content().contains("with open(")


def _unreleased_resource() -> Column:
    opened = pattern_gate([pack.Pattern(pack.OPENING_CALL, needles=(".connect", ".open", ".create"))])
    return ~contains_any(content(), ("with", "finally")) & opened()


def _no_export_list() -> Column:
    return content().contains("def ") & ~content().contains("__all__")


def probes() -> list[Probe]:
    def file_wide(check_id, gate, suffixes=None):
        return whole_file(CHECKS[check_id], "best_practices", gate, suffixes)

    def file_pattern(check_id, regex, needles, suffixes):
        return file_wide(check_id, pattern_gate([pack.Pattern(regex, needles=needles)]), suffixes)

    return [
        _by_match("BP001", pack.Pattern(pack.BARE_EXCEPT, needles=("except",))),
        reraised(),
        file_wide("BP003", _unclosed_file),
        file_wide("BP004", _unreleased_resource),
        missing_return_types(),
        missing_parameter_types(),
        missing_docstrings(),
        late_imports(),
        circular_imports(),
        constants(),
        _by_match("BP011", pack.Pattern(pack.MUTABLE_DEFAULT, needles=DEF)),
        complex_comprehensions(),
        print_calls(),
        file_pattern("BP014", pack.BOOL_COMPARISON, ("True", "False"), PYTHON),
        file_wide("BP015", _no_export_list, PYTHON),
        file_pattern("BP016", pack.VAR_KEYWORD, ("var",), SCRIPTS),
        file_pattern("BP017", pack.LOOSE_EQUALITY, ("=", "!"), SCRIPTS),
        file_pattern("BP018", pack.CONSOLE_LOG, ("console.log",), SCRIPTS),
    ]
