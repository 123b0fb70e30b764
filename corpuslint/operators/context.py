"""Context windows and repair texts for findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import sql_text
from ..functions.text import context_window, split_lines, with_lines
from ..packs.catalog import FIX_LAYOUT, FIXES, NO_FIX
from ..schemas import severity_rank
from .probe import Probe, all_hits, catalog_array, to_finding


def attach_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of checks with a repair template get ``fix``: the lines around the place,
    the template and the reason.

    One equi join on the file id: only files with such findings take part, each file row
    appears once, and a file with very many findings is split by the skew handling of the
    join because the file side can be repeated.
    """
    wanted = findings.where(F.col("check_id").isin(*FIXES))
    texts = files.select("file_id", split_lines(F.col("content")).alias("lines"))
    joined = wanted.join(texts, "file_id")
    return _with_fix(joined.select(*findings.columns, context_window(F.col("lines"), F.col("line_number")).alias("context")))


def _with_fix(findings: DataFrame) -> DataFrame:
    """Findings with ``context`` get ``fix``."""
    template = F.expr("CASE check_id " + " ".join(
        f"WHEN {sql_text(check)} THEN {sql_text(text)}" for check, (text, _) in FIXES.items()) + " END")
    why = F.expr("CASE check_id " + " ".join(
        f"WHEN {sql_text(check)} THEN {sql_text(text)}" for check, (_, text) in FIXES.items()) + " END")
    layout = F.replace(F.replace(F.lit(FIX_LAYOUT), F.lit("{template}"), template),
                       F.lit("{why}"), why)
    return findings.withColumn("fix", F.replace(layout, F.lit("{context}"), F.col("context")))


def findings_with_context(files: DataFrame, probes: Iterable[Probe]) -> DataFrame:
    """Findings of those ``probes`` that have a repair template, with ``context`` and ``fix``, in the pass over the files:
    the few lines around a hit leave the row with it, so no text is read twice and nothing is shuffled."""
    wanted = [probe for probe in probes if probe.check_id in FIXES]
    around = F.transform(all_hits(wanted), lambda h: F.struct(
        h.alias("h"), context_window(F.col("lines"), h["line_number"]).alias("context")
    ))
    # The outer form plus a later filter keeps the checks from running a second time; see ``flatten_hits``.
    rows = with_lines(files).select("file_id", "path", around.alias("hits")).select(
        "file_id", "path", F.explode_outer("hits").alias("x")
    ).where(F.col("x").isNotNull())
    entry = F.get(catalog_array(), F.col("x.h.check"))
    named = rows.select("file_id", "path", "x.h", "x.context", entry.alias("entry"))
    found = named.select("file_id", "path", to_finding(F.col("h"), F.col("entry")).alias("f"), "context").select(
        "file_id", "path", "f.*", "context"
    )
    return _with_fix(found.withColumn("severity_rank", severity_rank(F.col("severity"))))


def repair_hint(findings: DataFrame) -> DataFrame:
    """Findings of checks without a template point to the documentation."""
    return findings.where(~F.col("check_id").isin(*FIXES)).withColumn("fix", F.lit(NO_FIX))
