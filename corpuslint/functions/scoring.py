"""Score, grade, gate and colour band as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import PENALTY


def penalty(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in PENALTY.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def score(total_penalty: Column, file_count: Column) -> Column:
    """100 minus the penalty per ten files, between 0 and 100, one decimal."""
    spread = F.greatest(F.lit(1.0), file_count / F.lit(10.0))
    raw = F.lit(100.0) - total_penalty / spread
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)


def _ladder(value: Column, steps, rest: str) -> Column:
    result = F.lit(rest)
    for bound, name in reversed(steps):
        result = F.when(value >= bound, F.lit(name)).otherwise(result)
    return result


def grade(value: Column) -> Column:
    return _ladder(value, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def band(value: Column) -> Column:
    """Traffic-light band of the report."""
    return _ladder(value, [(90, "green"), (70, "yellow"), (50, "orange")], "red")


def gate(critical: Column, high: Column) -> Column:
    """Exit code of a build gate."""
    return F.when(critical > 0, 2).when(high > 0, 1).otherwise(0)
