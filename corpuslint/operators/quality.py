"""Quality checks: line and function length, repeats, nesting, literals, dead code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.patterns import SPACE, java_regex, matches, occurrences, sql_text
from ..functions.text import bind, cut, indent, lstrip, match_table, numbered, strip
from ..packs import probes as pack
from ..packs.catalog import QUALITY
from .probe import Probe, content, each_match, hit, lines, pattern_gate, whole_file

CHECKS = {check.check_id: check for check in QUALITY}


def _comment(text: Column) -> Column:
    return text.startswith("#") | text.startswith("//")


def long_lines(limit: int = pack.MAX_LINE_LENGTH) -> Probe:
    """QUAL001: lines above the limit, comments and lines with a URL aside."""

    def too_long(item: Column) -> Column:
        line = item["line"]
        url = line.contains("http://") | line.contains("https://")
        return (F.length(line) > limit) & ~url & ~_comment(strip(line))

    def rows() -> Column:
        def row(item: Column) -> Column:
            line = item["line"]
            length = F.length(line)
            shown = F.when(length > 100, F.concat(cut(line, 100), F.lit("..."))).otherwise(line)
            severity = F.when(length < 200, F.lit("low")).otherwise(F.lit("medium"))
            return hit(CHECKS["QUAL001"], item["n"], shown, count=length, severity=severity)

        return F.transform(F.filter(numbered(lines()), too_long), row)

    return Probe("QUAL001", "quality", lambda: F.length(content()) > limit, rows)


def _ends_function(line: Column) -> Column:
    """A line at the left margin that is neither blank nor a comment."""
    text = lstrip(line)
    return (text != "") & (text == line) & ~text.startswith("#")


def long_functions(limit: int = pack.MAX_FUNCTION_LINES) -> Probe:
    """QUAL002. Only the next ``limit + 1`` lines decide whether a function is long, so
    each head looks at a bounded slice; the exact end is searched for long ones only."""
    head = pack.Pattern(pack.FUNCTION_HEAD, needles=("def",))

    def rows() -> Column:
        total = F.size(lines())
        table = match_table(head.regex, (1,))
        long_heads = F.filter(
            table,
            lambda m: (total - m["n"] > limit)
            & ~F.exists(F.slice(lines(), m["n"] + 1, limit + 1), _ends_function),
        )

        def measured(ends: Column) -> Column:
            def row(m: Column) -> Column:
                end = F.coalesce(F.array_min(F.filter(ends, lambda e: e > m["n"])), total + 1)
                return F.struct(m["n"].alias("n"), m["g1"].alias("name"),
                                (end - m["n"] - 1).alias("length"))

            return F.transform(long_heads, row)

        ends = F.transform(
            F.filter(numbered(lines()), lambda item: _ends_function(item["line"])),
            lambda item: item["n"],
        )
        return F.transform(
            bind(ends, measured),
            lambda m: hit(
                CHECKS["QUAL002"], m["n"],
                F.concat(F.lit("def "), m["name"], F.lit("(...)")), m["name"], m["length"],
            ),
        )

    def gate() -> Column:
        return pattern_gate([head])() & (
            F.array_size(lines()) - 1 > limit
        )

    return Probe("QUAL002", "quality", gate, rows)


def repeated_blocks() -> Probe:
    """QUAL003: a line text seen for the first time opens a block, repeats join it, and
    a block of three or more is reported once another new text follows it.

    First occurrences come from sorting (text, position) pairs inside the row.
    """

    def rows() -> Column:
        texts = F.transform(lines(), lambda line: strip(line))
        code = F.filter(texts, lambda t: (t != "") & ~t.startswith("#"))
        long_texts = F.filter(
            F.transform(code, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("at"))),
            lambda x: F.length(x["t"]) > 20,
        )
        ranked = F.array_sort(
            F.transform(
                long_texts,
                lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"), x["at"].alias("at")),
            )
        )

        def openings(ordered: Column) -> Column:
            fresh = F.filter(
                ordered,
                lambda x, k: (k == 0) | (F.get(ordered, k - 1)["t"] != x["t"]),
            )
            return F.array_sort(
                F.transform(
                    fresh,
                    lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), x["t"].alias("t")),
                )
            )

        def blocks(opened: Column) -> Column:
            sized = F.transform(
                opened,
                lambda x, k: F.struct(
                    x["at"].alias("at"), x["t"].alias("t"),
                    (F.get(opened, k + 1)["i"] - x["i"]).alias("count"),
                ),
            )
            return F.filter(sized, lambda b: F.coalesce(b["count"] >= 3, F.lit(False)))

        return F.transform(
            bind(bind(ranked, openings), blocks),
            lambda b: hit(CHECKS["QUAL003"], b["at"], cut(b["t"], 80), count=b["count"]),
        )

    return Probe("QUAL003", "quality", lambda: F.length(content()) > 62, rows)


def empty_handlers() -> Probe:
    """QUAL004."""
    pattern = pack.Pattern(pack.EMPTY_EXCEPT, needles=("except",))
    return Probe(
        "QUAL004", "quality", pattern_gate([pattern], multiline=True),
        lambda: each_match(CHECKS["QUAL004"], pattern, multiline=True), self_gated=True,
    )


def hardcoded_values() -> Probe:
    """QUAL005: URLs, file names and long numbers, in this order."""

    def rows() -> Column:
        return F.concat(*[
            each_match(CHECKS["QUAL005"], pattern, (0,), snippet="m.g0")
            for pattern in pack.HARDCODED
        ])

    return Probe("QUAL005", "quality", pattern_gate(pack.HARDCODED), rows, self_gated=True)


def mixed_naming() -> Probe:
    """QUAL006: two or more naming styles and more than ten names.

    Without a camel-case or Pascal-case name there cannot be two styles, and both have a
    small letter in front of a capital. Eleven snake-case names settle the count, and the
    search for them stops at the eleventh; only files with fewer are counted in full.
    """
    snake, camel, pascal = pack.NAME_STYLES
    # One search for both; a name's run of letters ends where it must.
    either = r"(?=[a-zA-Z])(?<![\w])[A-Z]?+[a-z]++[A-Z][a-zA-Z]*+(?![\w])"
    eleven = java_regex(r"\A(?>(?s:.)*?" + snake + "){11}")

    def gate() -> Column:
        mixed = F.regexp_like(content(), F.lit("[a-z][A-Z]"))
        has_camel, has_pascal = matches(content(), camel), matches(content(), pascal)
        many = F.regexp_like(content(), F.lit(eleven))
        enough = (
            occurrences(content(), snake) + occurrences(content(), camel)
            + occurrences(content(), pascal)
        ) > 10
        two = (has_camel & has_pascal) | matches(content(), snake)
        return mixed & matches(content(), either) & (many | (two & enough))

    return whole_file(CHECKS["QUAL006"], "quality", gate)


def deep_nesting(allowed: int = pack.MAX_NESTING) -> Probe:
    """QUAL007: indentation in steps of four."""
    width = 4 * (allowed + 1)

    def rows() -> Column:
        deep = F.filter(numbered(lines()), lambda item: indent(item["line"]) >= width)
        return F.transform(
            deep,
            lambda item: hit(
                CHECKS["QUAL007"], item["n"], cut(strip(item["line"]), 80),
                count=F.floor(indent(item["line"]) / 4).cast("int"),
            ),
        )

    blanks = SPACE.replace(r"\t-\r", r"\t\x0b-\r")
    margin = f"(?md)^[{blanks}]{{{width}}}"
    return Probe("QUAL007", "quality", lambda: F.regexp_like(content(), F.lit(margin)), rows)


def magic_numbers() -> Probe:
    """QUAL008."""
    # The digit is looked for first, as it rejects most places at once.
    pattern = pack.Pattern("(?=[1-9])" + pack.MAGIC_NUMBER)

    ordinary = ", ".join(sql_text(str(n)) for n in pack.ORDINARY_NUMBERS)

    def rows() -> Column:
        return each_match(
            CHECKS["QUAL008"], pattern, (0,),
            keep=f"length(m.g0) <= 4 AND m.g0 NOT IN ({ordinary})",
            snippet="concat('数字: ', m.g0)", what="m.g0",
        )

    return Probe("QUAL008", "quality", pattern_gate([pattern]), rows, self_gated=True)


def unreachable_lines() -> Probe:
    """QUAL009: the lines from one ``def`` to the next form a section; in each section
    everything after the first ``return`` counts, comments and further returns aside."""

    def rows() -> Column:
        texts = F.transform(lines(), lambda line: strip(line))
        marks = F.filter(
            F.transform(
                texts,
                lambda t, i: F.when(t.startswith("def "), i + 1),
            ),
            lambda n: n.isNotNull(),
        )

        def sections(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda n, k: F.struct(
                    n.alias("first"),
                    (F.coalesce(F.get(starts, k + 1), F.size(lines()) + 1) - n).alias("size"),
                ),
            )

        def dead(section: Column) -> Column:
            body = F.transform(
                F.slice(lines(), section["first"], section["size"]),
                lambda line, j: F.struct((section["first"] + j).alias("n"), strip(line).alias("t")),
            )

            def after_return(body_: Column) -> Column:
                first = F.array_min(
                    F.transform(
                        F.filter(body_, lambda x: x["t"].startswith("return")), lambda x: x["n"]
                    )
                )
                return bind(first, lambda r: F.filter(
                    body_,
                    lambda x: F.coalesce(x["n"] > r, F.lit(False)) & (x["t"] != "")
                    & ~x["t"].startswith("#") & ~x["t"].startswith("return"),
                ))

            return bind(body, after_return)

        flagged = F.flatten(F.transform(bind(marks, sections), dead))
        return F.transform(
            flagged, lambda x: hit(CHECKS["QUAL009"], x["n"], cut(x["t"], 80))
        )

    def gate() -> Column:
        return content().contains("def ") & content().contains("return")

    return Probe("QUAL009", "quality", gate, rows)


def probes(max_line_length: int = pack.MAX_LINE_LENGTH,
           max_function_lines: int = pack.MAX_FUNCTION_LINES) -> list[Probe]:
    return [
        long_lines(max_line_length), long_functions(max_function_lines), repeated_blocks(),
        empty_handlers(), hardcoded_values(), mixed_naming(), deep_nesting(),
        magic_numbers(), unreachable_lines(),
    ]
