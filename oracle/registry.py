"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslint.operators import (
    best_practices, documentation, java, performance, quality, rollups, security, skills,
)
from corpuslint.operators.probe import Probe, run_probes
from corpuslint.packs import java as java_pack
from corpuslint.plans.audit import Audit
from corpuslint.schemas import CATEGORIES, SEVERITIES
from corpuslint.sources.samples import code_files, document_files

from . import rollups as rollup_sql, skills as skill_sql
from .base import CODE_FILES, re2
from .checks import CHECK_PARTS, check_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Checks that follow the lines of a file in order.
LINE_ORDER = (
    "QUAL002", "QUAL003", "QUAL007", "QUAL009", "PERF001", "PERF002", "PERF008", "PERF009",
    "PERF010", "DOC006", "DOC007", "DOC008", "BP008", "BP013",
)
COLUMNS = (
    "file_id", "path", "check_id", "check_name", "category", "severity", "line_number",
    "message", "snippet", "suggestion", "rule_id",
)
PROBES: dict[str, Probe] = {
    probe.check_id: probe
    for module in (quality, best_practices, security, performance, documentation)
    for probe in module.probes()
}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def query_name(check_id: str) -> str:
    prefix = "window" if check_id in LINE_ORDER else "check"
    return f"{prefix}_{check_id.lower().replace('-', '_')}"


def _check_query(check_id: str) -> Query:
    return lambda spark, sf_dir: run_probes(
        code_files(spark, sf_dir), [PROBES[check_id]]
    ).select(*COLUMNS)


for _check_id in CHECK_PARTS:
    register(query_name(_check_id), _check_query(_check_id), check_sql(_check_id))


def _audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Audit(code_files(spark, sf_dir)).findings()


def _audit_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Audit(code_files(spark, sf_dir), analyzers=["skills", "java"]).skills()


def _shown_skills(rows: DataFrame, *columns: str) -> DataFrame:
    """Skill rows with the evidence as one text."""
    return rows.withColumn("evidence", F.array_join("evidence", "|")).select(*columns)


# Findings of every check, rolled up.
_FROM_FINDINGS = {
    "rollup_severity": rollups.by_severity,
    "rollup_category": rollups.by_category,
    "rollup_grouping_sets": rollups.by_severity_and_category,
    "min_severity": lambda found: rollups.at_least(found, "high").select(*COLUMNS),
    "findings_per_file": rollups.findings_per_file,
}
for _name, _roll in _FROM_FINDINGS.items():
    register(_name, lambda spark, sf_dir, roll=_roll: roll(_audit_findings(spark, sf_dir)),
             rollup_sql.ROLLUPS[_name])


register("findings_ordered",
         lambda spark, sf_dir: Audit(code_files(spark, sf_dir)).ordered_findings().select(*COLUMNS, "severity_rank"),
         rollup_sql.ROLLUPS["findings_ordered"])
register("topk_key_issues", lambda spark, sf_dir: Audit(code_files(spark, sf_dir)).key_issues(),
         rollup_sql.ROLLUPS["topk_key_issues"])


def _file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Audit(code_files(spark, sf_dir)).findings_by_file()
    ids = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["check_id"])))
    return found.select("path", F.size("findings").alias("issues"), F.array_join(ids, ",").alias("checks"))


def _flat_summary(audit: Audit) -> DataFrame:
    counts = audit.totals()
    summary = rollups.summarise(counts, audit.project)

    def count(column: str, name: str):
        return F.coalesce(F.col(column)[name], F.lit(0)).alias(f"n_{name}")

    return summary.select(
        "total_files", "total_lines", "total_checks", "n_skills", "overall_score", "grade", "band", "gate",
        *[count("issues_by_severity", name) for name in SEVERITIES],
        *[count("issues_by_category", name) for name in CATEGORIES],
    )


register("file_results", _file_results, rollup_sql.ROLLUPS["file_results"])
register("summary", lambda spark, sf_dir: _flat_summary(Audit(code_files(spark, sf_dir))),
         rollup_sql.ROLLUPS["summary"])
register("recommendations", lambda spark, sf_dir: Audit(code_files(spark, sf_dir)).recommendations(),
         rollup_sql.ROLLUPS["recommendations"])
register("file_metrics", lambda spark, sf_dir: rollups.file_metrics(code_files(spark, sf_dir)),
         rollup_sql.ROLLUPS["file_metrics"])
for _analyzer in ("quality", "best_practices", "performance", "documentation", "security"):
    _ids = [check_id for check_id, probe in PROBES.items() if probe.analyzer == _analyzer]
    register(
        f"score_{_analyzer}",
        lambda spark, sf_dir, analyzer=_analyzer: _flat_summary(
            Audit(code_files(spark, sf_dir), analyzers=analyzer)
        ),
        rollup_sql.summary_sql(_ids, extras=False),
    )

# Skills.
SKILL_COLUMNS = ("file_id", "path", "seq", "name", "category", "level", "confidence", "evidence", "description")
for _kind in skills.TRAITS:
    register(
        f"skill_{_kind}",
        lambda spark, sf_dir, kind=_kind: _shown_skills(
            skills.skill_rows(code_files(spark, sf_dir), (kind,)), *SKILL_COLUMNS),
        skill_sql.skill_sql((_kind,)),
    )
register("skill_rows",
         lambda spark, sf_dir: _shown_skills(skills.skill_rows(code_files(spark, sf_dir)), *SKILL_COLUMNS),
         skill_sql.skill_sql())
register("skill_findings",
         lambda spark, sf_dir: skills.skill_findings(code_files(spark, sf_dir)).select(*COLUMNS),
         f"WITH {CODE_FILES}, {skill_sql.TRAITS} {skill_sql.skill_finding_select()}")
register("java_skills",
         lambda spark, sf_dir: _shown_skills(java.java_skill_rows(code_files(spark, sf_dir)), *SKILL_COLUMNS),
         skill_sql.java_sql())
DEDUP_COLUMNS = ("name", "category", "level", "confidence", "evidence", "path", "seq")
_FROM_SKILLS = {
    "skill_dedup": lambda rows: _shown_skills(rollups.dedup_skills(rows), *DEDUP_COLUMNS),
    "skill_dedup_by_name": lambda rows: _shown_skills(rollups.dedup_skills(rows, ("name",)), *DEDUP_COLUMNS),
    "skill_distribution": lambda rows: rollups.skill_distribution(rollups.dedup_skills(rows)),
    "skill_counts": rollups.skill_counts,
    "skill_distinct_languages": lambda rows: rollups.distinct_names(rows, "编程语言"),
}
for _name, _roll in _FROM_SKILLS.items():
    register(_name, lambda spark, sf_dir, roll=_roll: roll(_audit_skills(spark, sf_dir)),
             rollup_sql.SKILLS[_name])
register("skill_top",
         lambda spark, sf_dir: Audit(code_files(spark, sf_dir), analyzers=["skills", "java"]).top_skills(),
         rollup_sql.SKILLS["skill_top"])
register("java_skill_counts",
         lambda spark, sf_dir: rollups.skill_counts(java.java_skill_rows(code_files(spark, sf_dir))),
         rollup_sql.SKILLS["java_skill_counts"])

# Java findings, structure and dependencies.
JAVA_PROBES = {probe.check_id: probe for probe in java.probes()}
for _check_id, _probe in JAVA_PROBES.items():
    register(f"check_{_check_id.lower()}",
             lambda spark, sf_dir, probe=_probe: run_probes(code_files(spark, sf_dir), [probe]).select(*COLUMNS),
             skill_sql.java_finding_sql(_check_id))
register("java_dependencies", lambda spark, sf_dir: java.maven_dependencies(code_files(spark, sf_dir)),
         f"WITH {CODE_FILES}, {skill_sql.JAVA} SELECT file_id, path, CAST(i - 1 AS INT) AS ordinal, "
         "group_id, artifact_id FROM deps")


def _java_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = java.java_structure(code_files(spark, sf_dir))
    lists = [c for c in rows.columns if c not in ("file_id", "path", "package")]
    return rows.select("file_id", "path", "package", *[F.array_join(c, "|").alias(c) for c in lists])


_LISTS = {"imports": java_pack.IMPORT, **java_pack.STRUCTURE}
register("java_structure", _java_structure,
         f"WITH {CODE_FILES} SELECT file_id, path, regexp_extract(content, {re2(java_pack.PACKAGE)}, 1) AS package, "
         + ", ".join(f"array_to_string(regexp_extract_all(content, {re2(p)}, 1), '|') AS {n}" for n, p in _LISTS.items())
         + " FROM code_files WHERE ends_with(path, '.java')")
register("java_practices", lambda spark, sf_dir: java.practice_scores(code_files(spark, sf_dir)).withColumn(
    "evidence", F.array_join("evidence", "|")), skill_sql.practices_sql())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines of the plain documents, rolled up per severity with score and grade."""
    files = document_files(spark, sf_dir)
    found = run_probes(files, [PROBES["QUAL001"]])
    counts = rollups.totals(files, found, found.limit(0))
    return rollups.summarise(counts, "documents").select(
        "project_name", "total_files", "total_lines", "total_checks", "overall_score", "grade", "gate"
    )


from . import sources as source_queries  # noqa: E402  (needs PROBES)

for _name, (_query, _sql) in source_queries.REGISTERED.items():
    register(_name, _query, _sql)
