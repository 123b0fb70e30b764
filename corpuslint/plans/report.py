"""Report sinks: the report document as JSON lines next to each other, one folder per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .audit import Audit


def nested_findings(findings: DataFrame) -> DataFrame:
    """Findings with the place as a nested ``location``."""
    place = F.struct(
        F.col("path").alias("file_path"), "line_number",
        F.lit(0).alias("column_number"), "snippet",
    )
    return findings.select(
        "check_id", "check_name", "category", "severity", "message", place.alias("location"),
        "suggestion", "rule_id", "metadata",
    )


def as_json(table: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return table.select(F.to_json(F.struct(*table.columns)).alias("value"))


def write_report(audit: Audit, path: str) -> None:
    """Write summary, recommendations, skills, findings and findings by file. Each part is
    a folder of JSON lines written by its own tasks; nothing passes through the driver. The audit is saved first (in
    ``audit`` next to the parts, unless the caller saved it), so its files are read once."""
    if not audit.is_saved():
        audit.save(f"{path}/audit")
    head = audit.summary().withColumn("audit_date", F.current_timestamp())
    parts = {
        "summary": head,
        "recommendations": audit.recommendations(),
        "skills_detected": audit.unique_skills(),
        "skills_inventory": audit.skills(),
        "results": nested_findings(audit.findings()),
        "file_results": audit.findings_by_file(),
    }
    for name, table in parts.items():
        as_json(table).write.mode("overwrite").text(f"{path}/{name}")


def write_findings(audit: Audit, path: str) -> None:
    """Findings as a table partitioned by severity."""
    audit.findings().write.mode("overwrite").partitionBy("severity").parquet(path)
