"""Comparison SQL of the rollups, which all start from every finding of every check."""

from __future__ import annotations

from corpuslint.functions.text import BRANCH_MARKS, BRANCH_WORDS, STRUCTURE
from corpuslint.operators.rollups import ADVICE
from corpuslint.schemas import CATEGORIES, LEVELS, PENALTY, SEVERITIES

from .base import CODE_FILES, LINES, newlines, plain, q, re2
from .checks import CHECK_PARTS, union_ctes
from .skills import (
    JAVA, TRAITS, all_skill_select, java_finding_select, java_select, skill_finding_select,
)

COLUMNS = (
    "file_id, path, check_id, check_name, category, severity, line_number, message, snippet, suggestion, rule_id"
)


def _rank(values, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {q(v)} THEN {i}" for i, v in enumerate(values)) + " END"


RANK = _rank(SEVERITIES, "severity")


def all_findings(check_ids=None, extras: bool = True) -> str:
    """CTE list ending in ``allf`` (findings with rank) and, with extras, ``alls`` (skills)."""
    ctes, union = union_ctes(CHECK_PARTS if check_ids is None else check_ids)
    parts = [union]
    if extras:
        ctes = [*ctes, TRAITS, JAVA]
        parts += [skill_finding_select(), *java_finding_select().values()]
    ctes.append(f"allf AS (SELECT *, {RANK} AS severity_rank FROM ({' UNION ALL '.join(parts)}))")
    if extras:
        ctes.append(f"alls AS ({all_skill_select()})")
    return "WITH " + ",\n".join(ctes) + "\n"


LINE_COUNT = f"({newlines('content')} + CAST(content <> '' AND NOT ends_with(content, chr(10)) AS INT))"
PENALTY_SUM = "coalesce(sum(CASE " + " ".join(
    f"WHEN severity = {q(s)} THEN {v}" for s, v in PENALTY.items()) + " END), 0)"


def totals_cte(skills: str = "(SELECT count(*) FROM alls)") -> str:
    counters = [f"count(*) FILTER (WHERE severity = {q(s)}) AS n_{s}" for s in SEVERITIES]
    counters += [f"count(*) FILTER (WHERE category = {q(c)}) AS n_{c}" for c in CATEGORIES]
    return (
        f"tot AS (SELECT (SELECT count(*) FROM code_files) AS total_files, "
        f"(SELECT CAST(sum({LINE_COUNT}) AS BIGINT) FROM code_files) AS total_lines, count(*) AS total_checks, "
        + ", ".join(counters)
        + f", count(*) FILTER (WHERE contains(check_name, '文档')) AS n_undocumented, "
          f"CAST({PENALTY_SUM} AS BIGINT) AS penalty, {skills} AS n_skills FROM allf)"
    )


SCORE = "round(greatest(0.0, least(100.0, CAST(100 AS DOUBLE) - penalty / greatest(1.0, total_files / 10.0))), 1)"


def _ladder(column: str, steps, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {b} THEN {q(n)}" for b, n in steps) + f" ELSE {q(rest)} END"


GRADE = _ladder("overall_score", [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")
BAND = _ladder("overall_score", [(90, "green"), (70, "yellow"), (50, "orange")], "red")
GATE = "CASE WHEN n_critical > 0 THEN 2 WHEN n_high > 0 THEN 1 ELSE 0 END"


def summary_sql(check_ids=None, extras=True) -> str:
    skills = "(SELECT count(*) FROM alls)" if extras else "0"
    return (
        all_findings(check_ids, extras).rstrip() + ",\n" + totals_cte(skills)
        + f", sc AS (SELECT *, {SCORE} AS overall_score FROM tot)"
        + f" SELECT total_files, total_lines, total_checks, CAST(n_skills AS BIGINT) AS n_skills, overall_score, "
          f"{GRADE} AS grade, {BAND} AS band, {GATE} AS gate, "
        + ", ".join(f"n_{name}" for name in (*SEVERITIES, *CATEGORIES)) + " FROM sc"
    )


def recommendation_sql() -> str:
    def counted(name):
        return f"replace({q(ADVICE[name])}, '{{count}}', CAST(n_{name} AS VARCHAR))"

    tests = [
        ("n_critical > 0", counted("critical")), ("n_high > 0", counted("high")),
        ("n_security > 0", q(ADVICE["security"])),
        ("n_undocumented > total_checks * 0.3", q(ADVICE["documentation"])),
        ("n_performance > 0", q(ADVICE["performance"])), ("n_skills < 3", q(ADVICE["skills"])),
    ]
    listed = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in tests)
    return (
        all_findings().rstrip() + ",\n" + totals_cte()
        + f", adv AS (SELECT ([x FOR x IN [{listed}] IF x IS NOT NULL])[1:10] AS a FROM tot)"
        + " SELECT CAST(generate_subscripts(a, 1) - 1 AS INT) AS ordinal, unnest(a) AS recommendation FROM adv"
    )


def metrics_sql() -> str:
    odd = " OR ".join(
        f"((length(t) - length(replace(t, {q(mark)}, ''))) // 3) % 2 = 1" for mark in ('"""', "'''")
    )
    flat = plain("Q")
    words = [rf"\b{word}\b" for word in BRANCH_WORDS] + [r"\|\|" if m == "||" else m for m in BRANCH_MARKS]
    branches = " + ".join(f"len(regexp_extract_all(flat, {re2(p)}))" for p in words)
    counters = ", ".join(
        f"CAST(len(regexp_extract_all(flat, {re2(p)})) AS INT) AS {n}" for n, p in STRUCTURE.items()
    )
    return f"""WITH {CODE_FILES}, {LINES},
par AS (SELECT *, sum(CAST({odd} AS INT)) OVER (PARTITION BY file_id ORDER BY n) % 2 AS quoted FROM lines),
cl AS (SELECT file_id, CAST(count(*) FILTER (WHERE t <> '' AND quoted = 0 AND NOT starts_with(t, '#')
       AND NOT starts_with(t, '//')) AS INT) AS code_lines FROM par GROUP BY file_id)
SELECT file_id, path, CAST({LINE_COUNT} AS INT) AS line_count, code_lines,
       CAST(1 + {branches} AS INT) AS complexity, {counters}
FROM (SELECT *, {flat} AS flat FROM code_files) JOIN cl USING (file_id)"""


def from_all(select: str) -> str:
    return all_findings() + select


KEY_ORDER = "severity_rank, path, line_number, check_id, message"
ROLLUPS = {
    "rollup_severity": from_all("SELECT severity, count(*) AS issues FROM allf GROUP BY severity"),
    "rollup_category": from_all("SELECT category, count(*) AS issues FROM allf GROUP BY category"),
    "rollup_grouping_sets": from_all(
        "SELECT severity, category, CAST(grouping(severity, category) AS BIGINT) AS level, count(*) AS issues FROM allf "
        "GROUP BY GROUPING SETS ((severity), (category), ())"),
    "min_severity": from_all(f"SELECT {COLUMNS} FROM allf WHERE severity_rank <= 1"),
    "findings_per_file": from_all("SELECT file_id, path, count(*) AS issues FROM allf GROUP BY file_id, path"),
    "file_results": from_all(
        "SELECT path, CAST(coalesce(c, 0) AS INT) AS issues, coalesce(checks, '') AS checks FROM code_files LEFT JOIN "
        "(SELECT path, count(*) AS c, array_to_string(list_sort(list_distinct(list(check_id))), ',') AS checks "
        "FROM allf GROUP BY path) USING (path)"),
    "findings_ordered": from_all(
        f"SELECT {COLUMNS}, severity_rank FROM allf ORDER BY severity_rank, path, line_number, check_id"),
    "topk_key_issues": from_all(
        f"SELECT {KEY_ORDER}, check_name, severity, (SELECT count(*) FROM allf WHERE severity_rank <= 1) AS total, "
        f"greatest((SELECT count(*) FROM allf WHERE severity_rank <= 1) - 5, 0) AS remaining FROM allf "
        f"WHERE severity_rank <= 1 ORDER BY {KEY_ORDER} LIMIT 5"),
    "summary": summary_sql(),
    "recommendations": recommendation_sql(),
    "file_metrics": metrics_sql(),
}

SKILL_CTES = f"WITH {CODE_FILES}, {TRAITS}, {JAVA}, alls AS ({all_skill_select()}), "


def _dedup(keys: str) -> str:
    return (
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
        "ORDER BY confidence DESC, path, seq) AS rn FROM alls) WHERE rn = 1) "
    )


DEDUP_COLUMNS = "name, category, level, confidence, evidence, path, seq"
SKILLS = {
    "skill_dedup": SKILL_CTES + _dedup("name, category") + f"SELECT {DEDUP_COLUMNS} FROM best",
    "skill_dedup_by_name": SKILL_CTES + _dedup("name") + f"SELECT {DEDUP_COLUMNS} FROM best",
    "skill_distribution": SKILL_CTES + _dedup("name, category")
    + "SELECT category, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM best GROUP BY category",
    "skill_counts": SKILL_CTES.rstrip(", ") + " SELECT name, count(*) AS n FROM alls GROUP BY name",
    "java_skill_counts": f"WITH {CODE_FILES}, {JAVA} SELECT name, count(*) AS n FROM ({java_select()}) GROUP BY name",
    "skill_distinct_languages": SKILL_CTES.rstrip(", ")
    + " SELECT DISTINCT name FROM alls WHERE category = '编程语言'",
    "skill_top": SKILL_CTES + _dedup("name, category")
    + f"SELECT name, category, level, confidence, (SELECT count(*) FROM best) AS total, "
      f"greatest((SELECT count(*) FROM best) - 10, 0) AS remaining FROM best "
      f"ORDER BY confidence DESC, {_rank(LEVELS, 'level')} DESC, name, category LIMIT 10",
}
