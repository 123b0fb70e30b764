"""Registered queries against their comparison SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canonical

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "check_qual005", "check_qual008", "check_bp006", "check_bp010", "check_sec013", "check_perf012", "check_doc003",
    "window_qual002", "window_qual003", "window_perf001", "window_perf008", "window_doc007", "window_doc008",
    "rollup_grouping_sets", "topk_key_issues", "summary", "file_results", "file_metrics", "score_documentation",
    "skill_rows", "skill_dedup", "java_skills", "java_dependencies", "rules_custom", "context_window", "source_decode",
    "pages_markup_checks",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(result.columns)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == canonical(result.columns, result.fetchall())


def test_every_check_is_registered():
    from corpuslint.packs.catalog import ALL

    names = set(entry.queries())
    for check in ALL:
        if not check.check_id.startswith("SKILL"):
            key = check.check_id.lower().replace("-", "_")
            assert f"check_{key}" in names or f"window_{key}" in names, check.check_id


def test_entry(spark):
    assert entry.entry(spark).count() == 1
