"""Performance checks: loops and what happens inside them, copies, globals, caching.

Loop checks see a file as runs: every line that starts a loop or leaves one opens a new
run, and the runs that open with a loop line are loop bodies. Runs partition the lines,
so slicing them out is linear in the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions.patterns import WHITESPACE, extract, java_regex, matches
from ..functions.text import bind, contains_any, count_text, cut, match_table, runs, strip
from ..packs import probes as pack
from ..packs.catalog import PERFORMANCE
from .probe import Probe, content, each_match, hit, lines, pattern_gate, whole_file

CHECKS = {check.check_id: check for check in PERFORMANCE}
LOOP_WORDS = ("for ", "while ")
DEF = ("def",)


def _unindented(line: Column) -> Column:
    return ~line.startswith("    ")


def _has_loop() -> Column:
    return contains_any(content(), LOOP_WORDS)


def loop_bodies(leaves: Callable[[Column], Column]) -> Column:
    """array<array<struct<n, line, t>>>: the lines of every loop run, loop line first.
    ``leaves`` tells which lines end a loop; it sees structs with ``line`` and ``t``."""
    rows = F.transform(
        lines(),
        lambda line, i: F.struct(
            (i + 1).alias("n"), line.alias("line"), strip(line).alias("t")
        ),
    )

    def runs(table: Column) -> Column:
        events = F.filter(
            F.transform(
                table,
                lambda x: F.struct(
                    x["n"].alias("n"), contains_any(x["t"], LOOP_WORDS).alias("loop"),
                    leaves(x).alias("out"),
                ),
            ),
            lambda e: e["loop"] | e["out"],
        )

        def bodies(marks: Column) -> Column:
            spans = F.filter(
                F.transform(
                    marks,
                    lambda e, k: F.struct(
                        e["n"].alias("n"), e["loop"].alias("loop"),
                        (F.coalesce(F.get(marks, k + 1)["n"], F.size(table) + 1) - e["n"]).alias("size"),
                    ),
                ),
                lambda e: e["loop"],
            )
            return F.transform(spans, lambda e: F.slice(table, e["n"], e["size"]))

        return bind(events, bodies)

    return bind(rows, runs)


def _in_loop(check_id: str, leaves, test, snippet, gate) -> Probe:
    def rows() -> Column:
        hits = F.filter(F.flatten(loop_bodies(leaves)), test)
        return F.transform(hits, lambda x: hit(CHECKS[check_id], x["n"], snippet(x)))

    return Probe(check_id, "performance", lambda: _has_loop() & gate(), rows)


def _leaves_at_margin(x: Column) -> Column:
    return _unindented(x["line"]) & (x["t"] != "")


def string_building() -> Probe:
    """PERF002. A blank line at the margin and any ``def`` end the loop here."""
    return _in_loop(
        "PERF002",
        lambda x: x["t"].startswith("def ") | _unindented(x["line"]),
        lambda x: x["line"].contains("+") & matches(x["line"], pack.STRING_APPEND),
        lambda x: x["line"],
        pattern_gate([pack.Pattern(pack.STRING_APPEND, needles=("+",))]),
    )


def regexes_in_loops() -> Probe:
    """PERF009."""
    return _in_loop(
        "PERF009", _leaves_at_margin,
        lambda x: x["t"].contains("re.") & matches(x["t"], pack.REGEX_CALL),
        lambda x: x["t"],
        pattern_gate([pack.Pattern(pack.REGEX_CALL, needles=("re.",))]),
    )


def queries_in_loops() -> Probe:
    """PERF010: one finding per line, whichever query call it has."""
    return _in_loop(
        "PERF010", _leaves_at_margin,
        lambda x: x["t"].contains(".") & matches(x["t"], pack.QUERY_CALL),
        lambda x: cut(x["t"], 80),
        pattern_gate([pack.Pattern(pack.QUERY_CALL, needles=(".",))]),
    )


def repeated_attributes() -> Probe:
    """PERF008: neighbouring non-blank lines of a loop share an ``object.attribute``."""

    def rows() -> Column:
        def shared(body: Column) -> Column:
            seen = F.transform(
                F.filter(body, lambda x: x["t"] != ""),
                lambda x: F.struct(
                    x["n"].alias("n"), x["t"].alias("t"),
                    F.when(x["t"].contains("."), extract(x["t"], pack.ATTRIBUTE))
                    .otherwise(F.array().cast("ARRAY<STRING>")).alias("attrs"),
                ),
            )
            return bind(seen, lambda rows_: F.filter(
                rows_,
                lambda x, k: F.coalesce(
                    F.arrays_overlap(x["attrs"], F.get(rows_, k - 1)["attrs"]), F.lit(False)
                ),
            ))

        hits = F.flatten(F.transform(loop_bodies(lambda x: _unindented(x["line"])), shared))
        return F.transform(
            hits, lambda x: hit(CHECKS["PERF008"], x["n"], cut(x["t"], 80))
        )

    return Probe("PERF008", "performance",
                 # The dot of an attribute is found faster than the words around it.
                 lambda: _has_loop() & F.regexp_like(content(), F.lit(java_regex(r"\.(?<=[\w]\.)[\w]"))), rows)


FLOOR = -1_000_000_000  # as a step: back to zero, from whatever depth a file can reach


def nested_loops() -> Probe:
    """PERF001: loop depth inside functions is a walk that never goes below zero. Each
    line moves it by one step: up for an indented loop line, down for any other line at
    the margin, and a ``def`` line sends it back to zero. Lines before the first ``def``
    stay outside. A loop line is reported when it is at least the third level.

    A step takes depth x to greatest(x + up, low), and two steps in a row are a step of the
    same form. So the depth behind every line that moves comes from a scan by doubling,
    without a fold that carries its findings along."""

    def rows() -> Column:
        def step_of(line: Column, text: Column, i: Column) -> Column:
            loop = matches(text, pack.LOOP_START)
            head = text.startswith("def ")
            level = F.when(text.startswith("return"), 0).when(
                loop, F.when(_unindented(line), 0).otherwise(1)
            ).otherwise(F.when(_unindented(line), -1).otherwise(0))
            return F.struct(
                (i + 1).alias("n"), head.alias("head"), (loop & ~text.startswith("return") & ~head).alias("loop"),
                F.when(head, FLOOR).otherwise(level).alias("up"), F.lit(0).alias("low"), text.alias("t"),
            )

        steps = F.filter(
            F.transform(lines(), lambda line, i: bind(strip(line), lambda t: step_of(line, t, i))),
            lambda s: s["loop"] | (s["up"] != 0),
        )
        inside = bind(steps, lambda all_: F.slice(
            all_, F.greatest(F.lit(1), F.array_position(F.transform(all_, lambda s: s["head"]), True).cast("int")),
            F.when(F.exists(all_, lambda s: s["head"]), F.size(all_)).otherwise(0),
        ))

        def doubled(scanned: Column, k: Column) -> Column:
            far = F.call_function("shiftleft", F.lit(1), k)

            def joined(first: Column, then: Column) -> Column:
                return F.struct(
                    F.greatest(F.lit(FLOOR), first["up"] + then["up"]).alias("up"),
                    F.greatest(then["low"], first["low"] + then["up"]).alias("low"),
                )

            return F.when(F.size(scanned) > far, F.transform(
                scanned, lambda s, i: F.when(i >= far, joined(F.get(scanned, i - far), s)).otherwise(s)
            )).otherwise(scanned)

        def deep(events: Column) -> Column:
            single = F.transform(events, lambda s: F.struct(s["up"], s["low"]))
            depths = F.transform(
                F.aggregate(F.sequence(F.lit(0), F.lit(30)), single, doubled), lambda s: F.greatest(s["up"], s["low"])
            )
            return F.filter(bind(depths, lambda behind: F.transform(events, lambda s, i: F.struct(
                s["n"], s["t"], s["loop"], F.when(i > 0, F.get(behind, i - 1)).otherwise(0).alias("before")
            ))), lambda s: s["loop"] & (s["before"] >= 2))

        return F.transform(
            bind(inside, deep), lambda s: hit(CHECKS["PERF001"], s["n"], s["t"], count=s["before"] + 1)
        )

    def gate() -> Column:
        loops = count_text(content(), "for") + count_text(content(), "while")
        return content().contains("def ") & (loops >= 3)

    return Probe("PERF001", "performance", gate, rows)


def called_names(text: Column) -> Column:
    """The word in front of every opening bracket that has one, in text order; blanks may lie between them."""
    pieces = F.split(text, r"\(", -1)
    before = F.slice(pieces, 1, F.size(pieces) - 1)
    ends = F.transform(before, lambda piece: F.substring_index(F.rtrim(piece, F.lit(WHITESPACE)), " ", -1))
    names = F.transform(ends, lambda end: F.regexp_extract(end, java_regex(r"(?<![\w])(\w++)\z"), 1))
    return F.filter(names, lambda name: name != "")


def cacheable_functions() -> Probe:
    """PERF012: no ``global`` and no ``print`` in the 500 characters after the head, and
    the name is called more than three times in the file, the head included."""
    effects = r"(?=((?s:.){0,494}?global|(?s:.){0,495}?print)?)"
    head = pack.Pattern(pack.PURE_FUNCTION, needles=DEF, ahead=effects)

    def rows() -> Column:
        pure = F.filter(match_table(head.regex, (1, 2), head.ahead), lambda m: m["g2"] == "")
        calls = called_names(content())

        def entry(name: Column, line: Column) -> Column:
            return F.struct(name.alias("name"), line.alias("n"))

        # Calls (line 0) and heads side by side in the order of names: one run per name.
        named = F.array_sort(F.concat(
            F.transform(calls, lambda c: entry(c, F.lit(0))),
            F.transform(pure, lambda m: entry(m["g1"], m["n"])),
        ))

        def counted(run: Column) -> Column:
            return bind(F.size(F.filter(run, lambda x: x["n"] == 0)), lambda count: F.when(count > 3, F.transform(
                F.filter(run, lambda x: x["n"] > 0),
                lambda x: F.struct(x["n"].alias("n"), x["name"].alias("name"), count.alias("count")),
            )).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<n: INT, name: STRING, count: INT>>)")))

        found = bind(named, lambda x: F.flatten(F.transform(runs(x), counted)))
        return F.transform(
            F.array_sort(found), lambda x: hit(CHECKS["PERF012"], x["n"], what=x["name"], count=x["count"]),
        )

    return Probe("PERF012", "performance", pattern_gate([head]), rows)


def list_copies() -> Probe:
    """PERF004. A match begins where its word does, and words are not taken back letter by letter."""
    pattern = pack.Pattern(r"(?<![\w])" + pack.LIST_COPY.replace("(\\w+)", "(\\w++)"), needles=("[:",))
    return Probe(
        "PERF004", "performance", pattern_gate([pattern]),
        lambda: each_match(CHECKS["PERF004"], pattern, (0, 1), snippet="m.g0", what="m.g1"),
        self_gated=True,
    )


def global_names() -> Probe:
    """PERF007."""
    pattern = pack.Pattern(pack.GLOBAL_NAME, needles=("global",))
    return Probe("PERF007", "performance", pattern_gate([pattern]),
                 lambda: each_match(CHECKS["PERF007"], pattern), self_gated=True)


def probes() -> list[Probe]:
    def file_pattern(check_id, regex, needles):
        gate = pattern_gate([pack.Pattern(regex, needles=needles)])
        return whole_file(CHECKS[check_id], "performance", gate)

    return [
        nested_loops(),
        string_building(),
        file_pattern("PERF003", pack.STRING_CHAIN, ("+",)),
        list_copies(),
        whole_file(CHECKS["PERF005"], "performance", lambda: count_text(content(), "append") > 5),
        file_pattern("PERF006", pack.MEMBERSHIP, ("if",)),
        global_names(),
        repeated_attributes(),
        regexes_in_loops(),
        queries_in_loops(),
        file_pattern("PERF011", pack.LENGTH_OF_RANGE, ("range",)),
        cacheable_functions(),
    ]
