"""Near-duplicates in groups of many different near copies."""

import random
import re

import pytest
from pyspark.sql import DataFrame

from corpuslint.llm import near_dup

from .test_documents import brute_components


def near_copies(n, changed, seed, length=100):
    """Copies of one text with some words changed; the text itself is not among them."""
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    rows = []
    for k in range(n):
        words = list(base)
        for i in draw.sample(range(length), changed):
            words[i] = f"n{k}x{i}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.fixture
def compared(monkeypatch):
    """Numbers of pairs whose full sets are compared."""
    made = []
    original = near_dup._compared

    def counting(pairs: DataFrame, *rest):
        made.append(pairs.count())
        return original(pairs, *rest)

    monkeypatch.setattr(near_dup, "_compared", counting)
    return made


@pytest.mark.parametrize("percent, changed", [(80, 2), (85, 1)])
def test_linear_in_near_copies(make_docs, compared, percent, changed):
    per_row = []
    for n in (100, 400):
        compared.clear()
        rows = near_copies(n, changed, n)
        found = near_dup.near_duplicates(make_docs(rows), percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, percent)
        per_row.append(sum(compared) / n)
    assert per_row[1] < 2 * per_row[0] and max(per_row) < 80


def test_several_groups_and_rounds(make_docs):
    rows = near_copies(120, 3, 1, 60) + [(200 + k, t) for k, t in near_copies(150, 2, 2, 90)]
    rows += [(400 + k, re.sub(r"b(\d)\b", r"b\1 y", t)) for k, t in near_copies(60, 2, 3, 90)]
    found = near_dup.near_duplicates(make_docs(rows), 80, leaf=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 80)


def test_repeated_ids_and_rows_without_id(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (4, a + " words"), (3, b + " more"), (5, b + " words"), (6, c), (6, c),
            (None, a), (None, "no id at all here now"), (None, "no id at all here now")]
    found = near_dup.near_duplicates(make_docs(rows)).collect()
    got = sorted((str(r.doc_id), str(r.component_id), r.kept, r.stays) for r in found)
    assert got == sorted([
        ("1", "1", True, True), ("1", "1", True, True), ("2", "1", False, False), ("4", "1", False, False),
        ("3", "1", False, False), ("5", "1", False, False), ("6", "6", True, True), ("6", "6", True, False),
        ("None", "1", False, False), ("None", "None", True, True), ("None", "None", False, False),
    ])


def test_pipeline_decides_rows(spark, make_docs):
    """A repeated id, null ids and repeated rows, in a table with a column more and some less."""
    import corpus_pipeline

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (None, b + " words"), (None, "alone and without an id"), (7, "twice the same"),
            (7, "twice the same"), (8, None), (9, "")]
    docs = make_docs(rows).select("doc_id", "text", "key", "row")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert got == sorted([("1", a), ("1", b), ("None", "alone and without an id"), ("7", "twice the same"), ("8", "None"), ("9", "")])
    clean = corpus_pipeline.secret_scan(spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(rows)


def test_one_smaller_group_for_the_same_members(spark):
    """Ten members of two components with the same six differences meet once, not once a difference."""
    rows = [(1, i, i // 5, 3, 3, 10, 3.0, [1, 2, 3, 4, 5, 6, 100 + i]) for i in range(10)]
    described = spark.createDataFrame(rows, "g long, id long, component long, lacks int, beside int, hub_size int, cost double, "
                                            "features array<long>")
    found = near_dup.smaller_groups(described, 0.8)
    groups, kept = found if isinstance(found, tuple) else (found, None)
    members = groups.select("g", "id").collect()
    assert len({r.g for r in members}) == 1 and {r.id for r in members} == set(range(10))
    # Differences that one member has alone are not looked at again.
    assert {tuple(sorted(r.features)) for r in kept.collect()} == {(1, 2, 3, 4, 5, 6)}
