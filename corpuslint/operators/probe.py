"""A probe is one check over one file row: a cheap gate and an array of hits.

Probes are plain column expressions, so any number of them runs in a single narrow
pass over the file table. A hit only says which check, where and about what; the
catalog adds names, texts and severities once the hits have left the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import sql_all, sql_any, sql_matches, sql_text
from ..functions.text import MATCH_LINE, match_table_sql, with_lines
from ..packs import catalog
from ..packs.catalog import Check
from ..packs.probes import MAX_FUNCTION_LINES, MAX_LINE_LENGTH, SUFFIXES, Pattern
from ..schemas import FINDING, HIT, severity_rank

ORDINALS = {check.check_id: i for i, check in enumerate(catalog.ALL)}
LIMITS = {"QUAL001": MAX_LINE_LENGTH, "QUAL002": MAX_FUNCTION_LINES}
FINDING_COLUMNS = (
    "check_id", "check_name", "category", "severity", "message", "line_number",
    "snippet", "suggestion", "rule_id", "metadata", "tags",
)
# Name of the list that a finding carries in its metadata.
LIST_KEYS = {
    "SKILL001": "languages", "SKILL002": "frameworks", "SKILL003": "patterns",
    "SKILL004": "devops", "JAVA001": "dependencies", "JAVA010": "classes",
}


@dataclass(frozen=True)
class Probe:
    check_id: str
    analyzer: str
    gate: Callable[[], Column]
    rows: Callable[[], Column]
    suffixes: tuple[str, ...] | None = None
    self_gated: bool = False

    def _suffix_test(self) -> Column | None:
        suffixes = self.suffixes if self.suffixes is not None else SUFFIXES.get(self.analyzer)
        return F.col("ext").isin(*suffixes) if suffixes else None

    def applies(self) -> Column:
        """Suffix test first, then the text test: the cheap one decides most files."""
        suffix, gate = self._suffix_test(), self.gate()
        return gate if suffix is None else F.when(suffix, gate).otherwise(False)

    def hits(self) -> Column:
        """The guarded rows. Rows that test their own patterns are not tested twice."""
        guard = self._suffix_test() if self.self_gated else self.applies()
        return self.rows() if guard is None else F.when(guard, self.rows()).otherwise(no_hits())


def content() -> Column:
    return F.col("content")


def lines() -> Column:
    return F.col("lines")


def always() -> Column:
    return F.lit(True)


def no_hits() -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{HIT}>)")


def hit(
    check: Check | int | Column,
    line: Column | None = None,
    snippet: Column | None = None,
    what: Column | None = None,
    count: Column | None = None,
    severity: Column | None = None,
    tags: Column | None = None,
) -> Column:
    """One hit; a hit about a whole file has line number 0."""
    number = ORDINALS[check.check_id] if isinstance(check, Check) else check
    return F.struct(
        (number if isinstance(number, Column) else F.lit(number)).alias("check"),
        F.lit(0).alias("line_number") if line is None else line.alias("line_number"),
        F.lit("").alias("snippet") if snippet is None else snippet.alias("snippet"),
        F.lit("").alias("what") if what is None else what.alias("what"),
        F.lit(0).alias("count") if count is None else count.alias("count"),
        F.lit(None).alias("severity") if severity is None else severity.alias("severity"),
        F.lit(None).alias("tags") if tags is None else tags.alias("tags"),
    ).cast(HIT)


def pattern_test(pattern: Pattern, **flags: bool) -> str:
    """SQL: needle test on the bytes, then the regex."""
    tests = [sql_matches("content", pattern.regex, **flags)]
    if pattern.lowered:
        tests.insert(0, sql_matches("folded", pattern.lowered))
    if pattern.folded:
        tests.insert(0, sql_any("folded", pattern.folded))
    if pattern.needles:
        tests.insert(0, sql_any("content", pattern.needles))
    return sql_all(tests)


def pattern_gate(patterns: Iterable[Pattern], **flags: bool) -> Callable[[], Column]:
    """Any of several patterns occurs."""
    patterns = list(patterns)
    text = " OR ".join(pattern_test(pattern, **flags) for pattern in patterns)
    if len(patterns) > 1 and all(pattern.folded for pattern in patterns):
        # One look at the folded text settles most files for all patterns together.
        words = [word for pattern in patterns for word in pattern.folded]
        text = sql_all([sql_any("folded", words), f"({text})"])
    return lambda: F.expr(text)


def each_match(
    check: Check | int,
    pattern: Pattern,
    groups: tuple[int, ...] = (),
    keep: str | None = None,
    snippet: str = MATCH_LINE,
    what: str | None = None,
    **flags: bool,
) -> Column:
    """One hit per match. ``keep``, ``snippet`` and ``what`` are SQL over the match row
    ``m`` with its line ``m.n`` and groups ``m.g0``, ``m.g1``, …"""
    number = check if isinstance(check, int) else ORDINALS[check.check_id]
    table = match_table_sql(pattern.regex, groups, pattern.ahead, **flags)
    if keep is not None:
        table = f"filter({table}, m -> {keep})"
    about = sql_text(pattern.what) if what is None else what
    gate = pattern_test(pattern, **flags)
    return F.expr(
        f"IF({gate}, CAST(transform({table}, m -> named_struct('check', {number}, "
        f"'line_number', m.n, 'snippet', {snippet}, 'what', {about}, 'count', 0, "
        f"'severity', NULL, 'tags', NULL)) AS ARRAY<{HIT}>), CAST(array() AS ARRAY<{HIT}>))"
    )


def whole_file(check: Check, analyzer: str, gate: Callable[[], Column], suffixes=None) -> Probe:
    """A check that says one thing about a file when its gate holds."""
    return Probe(check.check_id, analyzer, gate, lambda: F.array(hit(check)), suffixes)


def catalog_array(checks: Iterable[Check] = catalog.ALL, limits: dict | None = None) -> Column:
    """The catalog as one constant array, looked up by position."""
    limits = {**LIMITS, **(limits or {})}

    def entry(check: Check) -> str:
        fields = {
            name: value.replace("{limit}", str(limits.get(check.check_id, "")))
            for name, value in check._asdict().items()
        }
        fields["list_key"] = LIST_KEYS.get(check.check_id, "")
        return "named_struct(" + ", ".join(
            f"'{name}', {sql_text(value)}" for name, value in fields.items()
        ) + ")"

    return F.expr("array(" + ", ".join(entry(check) for check in checks) + ")")


def _fill(template: Column, h: Column) -> Column:
    numbered = F.replace(template, F.lit("{line}"), h["line_number"].cast("string"))
    counted = F.replace(numbered, F.lit("{count}"), h["count"].cast("string"))
    return F.replace(counted, F.lit("{what}"), h["what"])


def to_finding(h: Column, entry: Column) -> Column:
    """Hit plus catalog entry → finding struct."""
    tags = F.coalesce(h["tags"], F.expr("CAST(array() AS ARRAY<STRING>)"))
    listed = F.create_map(entry["list_key"], F.array_join(tags, ", "))
    metadata = (
        F.when(entry["list_key"] == "", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
        .when(entry["list_key"] == "classes", F.map_concat(F.create_map(F.lit("package"), h["what"]), listed))
        .otherwise(listed)
    )
    columns = {
        "check_id": entry["check_id"],
        "check_name": _fill(entry["name"], h),
        "category": entry["category"],
        "severity": F.coalesce(h["severity"], entry["severity"]),
        "message": _fill(entry["message"], h),
        "line_number": h["line_number"],
        "snippet": h["snippet"],
        "suggestion": _fill(entry["suggestion"], h),
        "rule_id": entry["rule_id"],
        "metadata": metadata,
        "tags": tags,
    }
    return F.struct(*[columns[name].alias(name) for name in FINDING_COLUMNS]).cast(FINDING)


def flatten_hits(found: DataFrame, entries: Column | None = None) -> DataFrame:
    """One finding row per hit from rows with a ``hits`` array.

    The outer form plus a later filter is on purpose: for a plain explode the optimizer
    infers ``size(hits) > 0`` and would evaluate every check a second time for it.
    """
    entries = catalog_array() if entries is None else entries
    rows = found.select("file_id", "path", F.explode_outer("hits").alias("h")).where(
        F.col("h").isNotNull()
    )
    rows = rows.select("file_id", "path", "h", F.get(entries, F.col("h.check")).alias("entry"))
    return (
        rows.select("file_id", "path", to_finding(F.col("h"), F.col("entry")).alias("f"))
        .select("file_id", "path", "f.*")
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )


def flatten_findings(found: DataFrame) -> DataFrame:
    """One row per finding from rows with a ``findings`` array; see ``flatten_hits``."""
    return (
        found.select("file_id", "path", F.explode_outer("findings").alias("f"))
        .where(F.col("f").isNotNull())
        .select("file_id", "path", "f.*")
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )


def check_name(h: Column, entry: Column) -> Column:
    return _fill(entry["name"], h)


def all_hits(probes: Iterable[Probe]) -> Column:
    """Hits of several probes over the columns of one file row."""
    parts = [p.hits() for p in probes]
    return F.concat(*parts) if parts else no_hits()


def run_probes(files: DataFrame, probes: Iterable[Probe], entries: Column | None = None) -> DataFrame:
    """Findings of the given probes, one row each, without any shuffle."""
    found = with_lines(files).select("file_id", "path", all_hits(probes).alias("hits"))
    return flatten_hits(found, entries)
