"""Audit corpora of source and text files as Spark tables."""

from .plans.audit import Audit, audit_path, audit_paths, audit_table

__all__ = ["Audit", "audit_path", "audit_paths", "audit_table"]
