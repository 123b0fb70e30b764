"""Table layouts and the small enumerations shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities in report order with their score penalty.
SEVERITIES = ("critical", "high", "medium", "low", "info")
PENALTY = {"critical": 25, "high": 15, "medium": 5, "low": 2, "info": 0}

# Finding categories.
CATEGORIES = (
    "code_quality",
    "best_practices",
    "security",
    "performance",
    "documentation",
    "testing",
    "maintainability",
    "professional",
)

# Skill levels, weakest first.
LEVELS = ("beginner", "intermediate", "advanced", "expert")

FILES = "file_id STRING, path STRING, file_name STRING, ext STRING, content STRING"

FINDING = (
    "STRUCT<check_id: STRING, check_name: STRING, category: STRING, severity: STRING, "
    "message: STRING, line_number: INT, snippet: STRING, suggestion: STRING, rule_id: STRING, "
    "metadata: MAP<STRING, STRING>, tags: ARRAY<STRING>>"
)

# What a check leaves in the file row; the catalog turns it into a finding afterwards.
HIT = (
    "STRUCT<check: INT, line_number: INT, snippet: STRING, what: STRING, count: INT, "
    "severity: STRING, tags: ARRAY<STRING>>"
)

SKILL = (
    "STRUCT<name: STRING, category: STRING, level: STRING, confidence: DOUBLE, "
    "evidence: ARRAY<STRING>, description: STRING, version_hint: STRING>"
)

RULE = (
    "rule_id STRING, name STRING, description STRING, category STRING, severity STRING, "
    "pattern STRING, suggestion STRING, fix_template STRING, file_extensions ARRAY<STRING>, "
    "enabled BOOLEAN, metadata MAP<STRING, STRING>"
)


def rank_of(values: tuple[str, ...], column: Column) -> Column:
    """Position of a value in one of the ordered enumerations above."""
    return (F.array_position(F.array(*[F.lit(v) for v in values]), column) - 1).cast("int")


def severity_rank(column: Column) -> Column:
    """critical = 0 … info = 4."""
    return rank_of(SEVERITIES, column)


def level_rank(column: Column) -> Column:
    """beginner = 0 … expert = 3."""
    return rank_of(LEVELS, column)
