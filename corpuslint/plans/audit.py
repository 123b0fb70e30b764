"""The whole audit: files in, findings, skills and rollups out."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.patterns import LEAST_TOGETHER, marks, searched_together
from ..functions.text import line_count, with_lines
from ..operators import (
    best_practices, documentation, java, performance, quality, rollups, security, skills,
)
from ..operators.custom_rules import rule_findings
from ..operators.probe import (
    FINDING_COLUMNS, Probe, all_hits, catalog_array, check_name, flatten_findings, flatten_hits, to_finding,
)
from ..packs.probes import MAX_FUNCTION_LINES, MAX_LINE_LENGTH, SUFFIXES
from ..schemas import FINDING, SEVERITIES
from ..sources.files import scan, scan_paths, scan_table
from .storage import saved, shared_folder

# Analyzer → (name, description, category).
ANALYZERS = {
    "quality": ("代码质量分析器", "检查代码质量指标，包括行长度、函数长度、复杂度等", "code_quality"),
    "best_practices": ("最佳实践分析器", "检查代码是否遵循业界最佳实践和编码规范", "best_practices"),
    "security": ("安全性分析器", "检查代码中的安全漏洞和潜在风险", "security"),
    "performance": ("性能分析器", "检查代码中的性能问题和优化机会", "performance"),
    "documentation": ("文档分析器", "检查代码文档的完整性和质量", "documentation"),
    "skills": ("技能识别分析器", "识别代码中使用的技术栈、框架、库和开发技能", "professional"),
    "java": ("Java/Maven技能分析器", "识别Java项目和Maven配置中的专业技能、技术栈和最佳实践", "professional"),
}
EXTRA_FINDING_COLUMNS = ["file_id", "path", *FINDING_COLUMNS, "severity_rank"]
LANGUAGES = ("Python", "JavaScript", "TypeScript", "Java", "Go", "Rust", "C", "C++")

@dataclass(frozen=True)
class Extension:
    """An added analyzer: what makes its rows, which files it sees (none given: all) and what the catalog says."""

    make: Callable
    suffixes: tuple[str, ...] = ()
    title: str = ""
    description: str = ""
    category: str = "professional"

    def rows(self, files: DataFrame) -> DataFrame:
        return self.make(files.where(F.col("ext").isin(*self.suffixes)) if self.suffixes else files)


# Extension points by analyzer name: more checks over file rows, and whole tables of findings or skills.
EXTRA_PROBES: dict[str, Extension] = {}
EXTRA_FINDINGS: dict[str, Extension] = {}
EXTRA_SKILLS: dict[str, Extension] = {}


def register_probes(name: str, make: Callable[[], list[Probe]], **about) -> None:
    """Add checks that run inside the pass over the files; their suffixes are their own."""
    EXTRA_PROBES[name] = Extension(make, **about)


def register_findings(name: str, make: Callable[[DataFrame], DataFrame], suffixes: tuple[str, ...] = (), **about) -> None:
    """Add an analyzer that maps the file table to a findings table."""
    EXTRA_FINDINGS[name] = Extension(make, tuple(suffixes), **about)


def register_skills(name: str, make: Callable[[DataFrame], DataFrame], suffixes: tuple[str, ...] = (), **about) -> None:
    """Add a source of skill rows."""
    EXTRA_SKILLS[name] = Extension(make, tuple(suffixes), **about)


def extensions() -> dict[str, Extension]:
    return EXTRA_PROBES | EXTRA_SKILLS | EXTRA_FINDINGS


def python_analyzer(check: Callable) -> Callable[[DataFrame], DataFrame]:
    """Wrap ``check(path, content) -> iterable of finding dicts`` as an analyzer; Arrow
    batches go through ``mapInPandas`` and stay in the partition they came from."""
    import pandas as pd

    columns = ["file_id", "path", "check_id", "check_name", "category", "severity", "message",
               "line_number", "snippet", "suggestion", "rule_id"]

    def run(batches):
        for batch in batches:
            for file_id, path, text in zip(batch["file_id"], batch["path"], batch["content"]):
                rows = [
                    {"file_id": file_id, "path": path, "line_number": 0, "snippet": "",
                     "suggestion": "", "rule_id": "", "severity": "info",
                     "category": "professional", **found}
                    for found in check(path, text)
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{c} {'INT' if c == 'line_number' else 'STRING'}" for c in columns)

    def make(files: DataFrame) -> DataFrame:
        found = files.select("file_id", "path", "content").mapInPandas(run, schema)
        empty = F.expr("CAST(map() AS MAP<STRING, STRING>)")
        ranked = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")) - 1
        return found.select(
            *columns, empty.alias("metadata"),
            F.expr("CAST(array() AS ARRAY<STRING>)").alias("tags"),
            ranked.cast("int").alias("severity_rank"),
        )

    return make


def analyzer_catalog(spark: SparkSession) -> DataFrame:
    """``analyzer, name, description, category, suffixes``."""
    rows = [(key, *texts, list(SUFFIXES.get(key, ()))) for key, texts in ANALYZERS.items()]
    rows += [(key, e.title or key, e.description, e.category, list(e.suffixes)) for key, e in extensions().items()]
    return spark.createDataFrame(
        rows, "analyzer STRING, name STRING, description STRING, category STRING, suffixes ARRAY<STRING>"
    )


def chosen_analyzers(enabled: str | list[str] = "all") -> list[str]:
    names = [enabled] if isinstance(enabled, str) else list(enabled)
    known = [*ANALYZERS, *extensions()]
    return known if "all" in names else [name for name in known if name in names]


# Column expressions do not depend on the data, so equal audits share the last few. The key holds the callables, so
# none of them can be taken for another.
_BUILT: OrderedDict[tuple, tuple[Column, Column, list[Column], Column | None]] = OrderedDict()


class Audit:
    """One audit over a file table.

    ``analyzers`` and ``min_severity`` choose what runs and what is kept; ``rules`` is a
    rule table; ``per_file`` limits empty comments, open marks and undescribed routes per file (``None`` reports all).
    All results are lazy. Every file is read once: ``file_results`` holds its
    hits and skills, and findings, skills and rollups are read off that table, which
    ``save`` can write out first.
    """

    def __init__(
        self,
        files: DataFrame,
        analyzers: str | list[str] = "all",
        rules: DataFrame | None = None,
        min_severity: str | None = None,
        max_line_length: int = MAX_LINE_LENGTH,
        max_function_lines: int = MAX_FUNCTION_LINES,
        project: str = "Multi-file Audit",
        per_file: tuple[int | None, int | None, int | None] = (3, 5, 5),
        max_recommendations: int = 10,
    ) -> None:
        self.files = files
        self.analyzers = chosen_analyzers(analyzers)
        self.rules = rules
        self.min_severity = min_severity
        self.limits = {"QUAL001": max_line_length, "QUAL002": max_function_lines}
        self.project = project
        self.per_file = per_file
        self.max_recommendations = max_recommendations
        self._stored: DataFrame | None = None
        self._stored_extra: dict[str, DataFrame] = {}
        self._rule_findings: Column | None = None

    def probes(self) -> list[Probe]:
        made = {
            "quality": lambda: quality.probes(self.limits["QUAL001"], self.limits["QUAL002"]),
            "best_practices": best_practices.probes,
            "security": security.probes,
            "performance": performance.probes,
            "documentation": lambda: documentation.probes(*self.per_file),
            "java": java.probes,
        }
        chosen = [probe for name, make in made.items() if name in self.analyzers for probe in make()]
        return chosen + [probe for extra in self._active(EXTRA_PROBES) for probe in extra.make()]

    def _active(self, registered: dict[str, Extension]) -> list[Extension]:
        return [extra for name, extra in registered.items() if name in self.analyzers]

    def _skills(self) -> Column:
        parts = []
        if "skills" in self.analyzers:
            parts.append(skills.trait_skills())
        if "java" in self.analyzers:
            parts.append(java.java_skill_array())
        return F.concat(*parts) if parts else F.expr(skills.no_skills())

    def file_results(self) -> DataFrame:
        """``file_id, path, line_count, hits, rule_findings, skills``: one row per file in
        one narrow pass, no shuffle."""
        if self._stored is not None:
            return self._stored
        hits, found_skills, traits, marked = self._columns()
        rows = with_lines(self.files if marked is None else self.files.withColumn("marks", marked))
        if traits:
            rows = rows.select("*", *traits)
        if self._rule_findings is None:
            self._rule_findings = rule_findings(self.files.sparkSession, self.rules)
        return rows.select(
            "file_id", "path", line_count(F.col("content"), F.col("lines")).alias("line_count"),
            hits.alias("hits"), self._rule_findings.alias("rule_findings"),
            found_skills.alias("skills"),
        )

    def _columns(self) -> tuple[Column, Column, list[Column], Column | None]:
        """Hits and skills of one file row, the traits that they read, and the plain texts found, if many are searched."""
        gateway = SparkContext._gateway
        key = (gateway, *self.analyzers, *self.limits.values(), self.per_file, *self._active(EXTRA_PROBES))
        if key not in _BUILT:
            with searched_together() as texts:
                built = self._made_columns()
            if len(texts) < LEAST_TOGETHER:
                _BUILT[key] = (*self._made_columns(), None)
            else:
                _BUILT[key] = (*built, marks(texts))
            if len(_BUILT) > 8:
                _BUILT.popitem(last=False)
        return _BUILT[key]

    def _made_columns(self) -> tuple[Column, Column, list[Column]]:
        hits, traits = all_hits(self.probes()), []
        if "skills" in self.analyzers:
            hits, traits = F.concat(hits, skills.trait_hits()), skills.trait_columns(only_readable=True)
        return hits, self._skills(), traits

    def save(self, path: str | None = None) -> "Audit":
        """Write the per-file results once; later rollups read them instead of the files.
        The table also cuts the lineage, so a lost executor costs a re-read, not a re-audit.
        Without a path it goes below the shared folder that the session names."""
        if path is None:
            path = f"{shared_folder(self.files.sparkSession)}/audit-{uuid.uuid4().hex}"
        spark = self.files.sparkSession
        tables = {"": self.file_results(), **{f"-{kind}": made for kind, made in self._extra_tables().items()}}
        for ending, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path.rstrip('/')}{ending}")
        self._stored_extra = {
            ending[1:]: spark.read.parquet(f"{path.rstrip('/')}{ending}") for ending in tables if ending
        }
        self._stored = spark.read.parquet(path)
        return self

    def is_saved(self) -> bool:
        return self._stored is not None

    def _entries(self) -> Column:
        return catalog_array(limits=self.limits)

    def _kept(self, found: DataFrame) -> DataFrame:
        return rollups.at_least(found, self.min_severity) if self.min_severity else found

    def _extra_tables(self) -> dict[str, DataFrame]:
        """Rows of the active extensions, by kind; a kind without any is left out."""
        if self._stored is not None:
            return self._stored_extra
        kinds = {"findings": (EXTRA_FINDINGS, EXTRA_FINDING_COLUMNS), "skills": (EXTRA_SKILLS, None)}
        made = {}
        for kind, (registered, columns) in kinds.items():
            rows = [extra.rows(self.files) for extra in self._active(registered)]
            rows = [r.select(*columns) for r in rows] if columns else rows
            if rows:
                made[kind] = reduce(DataFrame.unionByName, rows)
        return made

    def _extension_findings(self, columns: list[str]) -> list[DataFrame]:
        made = self._extra_tables()
        return [made["findings"].select(*columns)] if "findings" in made else []

    def _extension_skills(self) -> list[DataFrame]:
        made = self._extra_tables()
        return [made["skills"]] if "skills" in made else []

    def findings(self) -> DataFrame:
        """One row per finding, with the rule and extension findings."""
        results = self.file_results()
        parts = [flatten_hits(results, self._entries())]
        if self.rules is not None:
            parts.append(flatten_findings(results.withColumnRenamed("rule_findings", "findings")))
        parts += self._extension_findings(parts[0].columns)
        return self._kept(reduce(DataFrame.unionByName, parts))

    def ordered_findings(self) -> DataFrame:
        """Findings in report order. They are saved first, as the sort reads its input twice."""
        return rollups.ordered(saved(self.findings()))

    def key_issues(self, limit: int = 5) -> DataFrame:
        """First critical and high findings; see ``rollups.key_issues``. The serious ones are saved once."""
        return rollups.key_issues(saved(rollups.serious(self.findings())), limit)

    def top_skills(self, limit: int = 10) -> DataFrame:
        return rollups.top_skills(saved(self.unique_skills()), limit)

    def findings_by_file(self) -> DataFrame:
        """``path, findings``: every file once, clean files with an empty array. Findings
        never leave their row, so a file with many of them needs no grouping."""
        rows = self.file_results().select(
            "file_id", "path", "hits", "rule_findings", self._entries().alias("entries")
        )
        built_in = F.transform("hits", lambda h: to_finding(h, F.get(F.col("entries"), h["check"])))
        parts = [built_in.cast(f"ARRAY<{FINDING}>"), F.col("rule_findings")]
        for extra in self._extension_findings(EXTRA_FINDING_COLUMNS):
            # Only extensions make a table of their own; theirs are joined by file.
            listed = extra.groupBy("file_id").agg(
                F.collect_list(F.struct(*FINDING_COLUMNS).cast(FINDING)).alias("extension_findings")
            )
            rows = rows.join(listed, "file_id", "left")
            parts.append(F.coalesce("extension_findings", F.expr(f"CAST(array() AS ARRAY<{FINDING}>)")))
        found = F.concat(*parts)
        if self.min_severity:
            last = SEVERITIES.index(self.min_severity) + 1
            found = F.filter(found, lambda f: f["severity"].isin(*SEVERITIES[:last]))
        return rows.select("path", found.alias("findings"))

    def skills(self) -> DataFrame:
        parts = [skills.explode_skills(self.file_results())]
        parts += [extra.select(*parts[0].columns) for extra in self._extension_skills()]
        return reduce(DataFrame.unionByName, parts)

    def unique_skills(self, keys: tuple[str, ...] = ("name", "category")) -> DataFrame:
        return rollups.dedup_skills(self.skills(), keys)

    def totals(self) -> DataFrame:
        """Counters of the whole audit in one pass over the per-file rows."""
        rows = self.file_results().select(
            "line_count", F.size("skills").alias("n_skills"), "hits", "rule_findings",
            self._entries().alias("entries"),
        )

        def brief(h: Column) -> Column:
            entry = F.get(F.col("entries"), h["check"])
            return F.struct(
                F.coalesce(h["severity"], entry["severity"]).alias("severity"),
                entry["category"].alias("category"), check_name(h, entry).alias("check_name"),
            )

        named = F.expr(
            "transform(rule_findings, f -> named_struct('severity', f.severity, "
            "'category', f.category, 'check_name', f.check_name))"
        )
        found = F.concat(F.transform("hits", brief), named)
        if self.min_severity:
            last = SEVERITIES.index(self.min_severity) + 1
            found = F.filter(found, lambda f: f["severity"].isin(*SEVERITIES[:last]))
        counted = [rollups.totals_of_files(rows.select("line_count", "n_skills", found.alias("found")))]
        needed = ["severity", "category", "check_name"]
        counted += [
            rollups.finding_totals(self._kept(extra)) for extra in self._extension_findings(needed)
        ]
        counted += [rollups.skill_totals(extra) for extra in self._extension_skills()]
        return rollups.add_up(*counted) if len(counted) > 1 else counted[0]

    def summary(self) -> DataFrame:
        return rollups.summarise(self.totals(), self.project)

    def recommendations(self) -> DataFrame:
        return rollups.recommend(self.totals(), self.max_recommendations)


def audit_path(spark: SparkSession, path: str, recursive: bool = True, **options) -> Audit:
    """Audit one file or directory."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return Audit(scan(spark, path, recursive), project=name, **options)


def audit_paths(spark: SparkSession, paths: list[str], **options) -> Audit:
    """Audit several files or directories, every file once."""
    return Audit(scan_paths(spark, paths), **options)


def audit_table(paths: DataFrame, **options) -> Audit:
    """Audit of the files that a table names in its column ``path``; no path passes through the driver."""
    return Audit(scan_table(paths), **options)
