"""Rollups over findings, files and skills.

Every aggregate has a partial step before its shuffle and a key from a small fixed set
(severity, category, check, skill), so no key ever gathers raw rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from ..functions.text import (
    STRUCTURE, code_line_count, complexity, line_count, with_lines,
)
from ..functions.patterns import occurrences
from ..schemas import CATEGORIES, SEVERITIES, level_rank, severity_rank


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("issues"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("issues"))


def by_severity_and_category(findings: DataFrame) -> DataFrame:
    """Both histograms and the total: counts per pair first (a few dozen rows), then sums of those."""
    severity, category = F.col("severity"), F.col("category")
    pairs = findings.groupBy(severity, category).agg(F.count("*").alias("n"))
    return pairs.groupingSets([[severity], [category], []], severity, category).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("issues")
    )


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings at or above a severity."""
    return findings.where(severity_rank(F.col("severity")) <= SEVERITIES.index(severity))


def findings_per_file(findings: DataFrame) -> DataFrame:
    """Number of findings per file, for ranking."""
    return findings.groupBy("file_id", "path").agg(F.count("*").alias("issues"))


def file_metrics(files: DataFrame) -> DataFrame:
    """Line counts, complexity and structure counters, one row per file, no shuffle."""
    content = F.col("content")
    return with_lines(files).select(
        "file_id", "path",
        line_count(content).alias("line_count"),
        code_line_count(F.col("lines")).alias("code_lines"),
        complexity(content).cast("int").alias("complexity"),
        *[occurrences(content, regex).cast("int").alias(name) for name, regex in STRUCTURE.items()],
    )


def _counters() -> dict[str, Column]:
    """Aggregates over rows with ``severity``, ``category`` and ``check_name``."""
    severity, category = F.col("severity"), F.col("category")
    return {
        "total_checks": F.count("severity"),
        **{f"n_{s}": F.count_if(severity == s) for s in SEVERITIES},
        **{f"n_{c}": F.count_if(category == c) for c in CATEGORIES},
        "n_undocumented": F.count_if(F.col("check_name").contains("文档")),
        "penalty": F.sum(scoring.penalty(severity)),
    }


COUNTERS = ("total_files", "total_lines", "n_skills", *(
    "total_checks", *(f"n_{s}" for s in SEVERITIES), *(f"n_{c}" for c in CATEGORIES),
    "n_undocumented", "penalty",
))


def _one_row(table: DataFrame, values: dict[str, Column]) -> DataFrame:
    return table.agg(*[
        F.coalesce(values.get(name, F.lit(0)), F.lit(0)).cast("bigint").alias(name)
        for name in COUNTERS
    ])


def add_up(*rows: DataFrame) -> DataFrame:
    """Sum of one-row counter tables; nothing is joined."""
    parts = reduce(DataFrame.unionByName, rows)
    return parts.agg(*[F.sum(name).alias(name) for name in COUNTERS])


def finding_totals(findings: DataFrame) -> DataFrame:
    return _one_row(findings, _counters())


def skill_totals(skills: DataFrame) -> DataFrame:
    return _one_row(skills, {"n_skills": F.count("*")})


def totals(files: DataFrame, findings: DataFrame, skills: DataFrame) -> DataFrame:
    """One row with every counter the summary and the recommendations need, from three
    separate tables. Each is reduced to one row and the rows are added up."""
    read = _one_row(files, {
        "total_files": F.count("*"), "total_lines": F.sum(line_count(F.col("content"))),
    })
    return add_up(read, finding_totals(findings), skill_totals(skills))


def totals_of_files(rows: DataFrame) -> DataFrame:
    """The same counters in one pass over per-file rows ``line_count, n_skills, found``,
    where ``found`` is an array of severity, category and check name. A file without
    findings still gives one row, and the first row of a file carries its own counts."""
    exploded = rows.select("line_count", "n_skills", F.posexplode_outer("found").alias("pos", "f"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return _one_row(exploded.select("line_count", "n_skills", "pos", "f.*"), {
        **_counters(),
        "total_files": F.count_if(first),
        "total_lines": F.sum(F.when(first, F.col("line_count"))),
        "n_skills": F.sum(F.when(first, F.col("n_skills"))),
    })


def _histogram(prefix: str, names: tuple[str, ...]) -> Column:
    """map<name, count> of the non-zero counters."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("key"), F.col(f"{prefix}{name}").alias("value")) for name in names
    ])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def summarise(counts: DataFrame, project: str = "") -> DataFrame:
    """Summary row from the counters: histograms, score, grade, band and gate."""
    value = F.when(F.col("total_files") == 0, F.lit(100.0)).otherwise(
        scoring.score(F.col("penalty"), F.col("total_files"))
    )
    scored = counts.withColumn("overall_score", value)
    return scored.select(
        F.lit(project).alias("project_name"),
        "total_files", "total_lines", "total_checks",
        _histogram("n_", SEVERITIES).alias("issues_by_severity"),
        _histogram("n_", CATEGORIES).alias("issues_by_category"),
        "n_skills", "overall_score",
        scoring.grade(F.col("overall_score")).alias("grade"),
        scoring.band(F.col("overall_score")).alias("band"),
        scoring.gate(F.col("n_critical"), F.col("n_high")).alias("gate"),
    )


# Texts of the recommendations, in order.
ADVICE = {
    "critical": "存在 {count} 个严重问题，请优先修复安全问题",
    "high": "存在 {count} 个高优先级问题，建议审查并修复",
    "security": "代码存在安全风险，建议进行安全审计并实施安全最佳实践",
    "documentation": "代码文档覆盖率较低，建议完善API文档和注释",
    "performance": "存在性能优化空间，建议审查数据库查询和算法复杂度",
    "skills": "代码技术栈较为单一，考虑引入更多现代工具和框架",
}


def recommend(counts: DataFrame, limit: int = 10) -> DataFrame:
    """``ordinal, recommendation`` from the counters."""

    def counted(name: str) -> Column:
        return F.replace(F.lit(ADVICE[name]), F.lit("{count}"), F.col(f"n_{name}").cast("string"))

    advice = F.array_compact(F.array(
        F.when(F.col("n_critical") > 0, counted("critical")),
        F.when(F.col("n_high") > 0, counted("high")),
        F.when(F.col("n_security") > 0, F.lit(ADVICE["security"])),
        F.when(F.col("n_undocumented") > F.col("total_checks") * F.lit(0.3), F.lit(ADVICE["documentation"])),
        F.when(F.col("n_performance") > 0, F.lit(ADVICE["performance"])),
        F.when(F.col("n_skills") < 3, F.lit(ADVICE["skills"])),
    ))
    return counts.select(F.posexplode(F.slice(advice, 1, limit)).alias("ordinal", "recommendation"))


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: severity first, then place."""
    return findings.orderBy("severity_rank", "path", "line_number", "check_id")


def serious(findings: DataFrame) -> DataFrame:
    """Critical and high findings with the columns that ``key_issues`` shows."""
    shown = ["severity_rank", "path", "line_number", "check_id", "message", "check_name", "severity"]
    return findings.where(F.col("severity_rank") <= 1).select(*shown)


def key_issues(findings: DataFrame, limit: int = 5) -> DataFrame:
    """The first critical and high findings with the size of the whole group. The total
    is a scalar subquery, and the ordered limit keeps only a few rows per task. Both read ``findings``, so give a saved
    table (``Audit.key_issues`` does)."""
    found = serious(findings)
    total = found.agg(F.count("*").alias("total")).scalar()
    order = ["severity_rank", "path", "line_number", "check_id", "message"]
    return (
        found.select(*order, "check_name", "severity").orderBy(*order).limit(limit)
        .withColumn("total", total)
        .withColumn("remaining", F.greatest(F.col("total") - limit, F.lit(0)))
    )


def dedup_skills(skills: DataFrame, keys: tuple[str, ...] = ("name", "category")) -> DataFrame:
    """Best row per key: highest confidence, then first path and place. A minimum over an
    ordered struct has a partial step, so a skill found in every file stays cheap."""
    rest = [c for c in skills.columns if c not in keys and c not in ("confidence", "path", "seq")]
    best = F.min(F.struct(
        (-F.col("confidence")).alias("neg"), "path", "seq", *rest,
    )).alias("best")
    found = skills.groupBy(*keys).agg(best)
    return found.select(
        *keys, (-F.col("best.neg")).alias("confidence"),
        *[F.col(f"best.{c}").alias(c) for c in ("path", "seq", *rest)],
    ).select(*skills.columns)


def skill_distribution(skills: DataFrame) -> DataFrame:
    """Skills per category with their share; the window sees one row per category."""
    counted = skills.groupBy("category").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return counted.select(
        "category", "n", (F.col("n") / F.sum("n").over(everything)).alias("share")
    )


def skill_counts(skills: DataFrame) -> DataFrame:
    """How often each skill name was found."""
    return skills.groupBy("name").agg(F.count("*").alias("n"))


def distinct_names(skills: DataFrame, category: str) -> DataFrame:
    """The names of one skill category found anywhere."""
    return skills.where(F.col("category") == category).select("name").distinct()


def top_skills(skills: DataFrame, limit: int = 10) -> DataFrame:
    """The first skills of a deduplicated list and how many more there are."""
    total = skills.agg(F.count("*").alias("total")).scalar()
    ranked = skills.withColumn("level_rank", level_rank(F.col("level")))
    return (
        ranked.orderBy(F.desc("confidence"), F.desc("level_rank"), "name", "category").limit(limit)
        .select("name", "category", "level", "confidence")
        .withColumn("total", total)
        .withColumn("remaining", F.greatest(F.col("total") - limit, F.lit(0)))
    )


