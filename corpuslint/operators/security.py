"""Security checks: one finding per match of a risky construct."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.patterns import sql_text
from ..functions.text import MATCH_LINE, contains_any, sql_strip
from ..packs import catalog
from ..packs.probes import CREDENTIAL_SNIPPET, DANGEROUS, SECURITY, Pattern
from .probe import Probe, content, each_match, pattern_gate, whole_file


OUTSIDE_COMMENT = f"NOT startswith({sql_strip(MATCH_LINE)}, '#')"


def _probe(check: catalog.Check, patterns: list[Pattern]) -> Probe:
    flags = {"ignore_case": True} if check.check_id == "SEC013" else {}
    options = dict(flags)
    if check.check_id in ("SEC013", "SEC016"):
        options["keep"] = OUTSIDE_COMMENT
    if check.check_id == "SEC013":
        options["snippet"] = sql_text(CREDENTIAL_SNIPPET)

    def rows() -> Column:
        found = [each_match(check, pattern, **options) for pattern in patterns]
        return F.concat(*found) if len(found) > 1 else found[0]

    return Probe(check.check_id, "security", pattern_gate(patterns, **flags), rows, self_gated=True)


def _unprotected_form() -> Column:
    lowered = F.lower(content())
    return (
        content().contains("action=")
        & lowered.contains("form")
        & ~contains_any(lowered, ("csrf", "token"))
    )


def probes() -> list[Probe]:
    by_id = {check.check_id: check for check in catalog.SECURITY}
    found = [
        _probe(check, [pattern])
        for check, (_, pattern, _, _) in zip(catalog.DANGEROUS_CHECKS, DANGEROUS)
    ]
    found += [_probe(by_id[check_id], patterns) for check_id, patterns in SECURITY.items()]
    found.append(whole_file(by_id["SEC019"], "security", _unprotected_form))
    return found
