"""Thousands of user rules: one automaton names the rules to try."""

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from corpuslint.functions.literals import LEAST, fold, needed_literals
from corpuslint.operators import custom_rules
from corpuslint.schemas import RULE
from corpuslint.sources import rules as rule_source

from test_user_patterns import PATTERNS

WORDS = ["open", "close", "Render", "fetch", "ΟΔΟΣ", "straße", "İstanbul", "naïve", "token", "ſecret", "Kelvin"]


@pytest.mark.parametrize("pattern, wanted", [
    ("abc", ("abc",)), (r"\bprint\s*\(", ("print",)), ("(?i)PassWord", ("password",)), ("a|b", ()), ("foo|barre", ("barre", "foo")),
    ("(foo|ba)r", ()), ("x*abc?", ()), ("(?:abcd)+e", ("abcd",)), ("(?:abcd)*e", ()), ("(?i)stra\xdfe", ("stra",)), ("[ad]bc", ()),
    ("(?=abcd)x", ()), ("TODO: \\w+ by (?:ann|bob)", ("todo: ",)), ("(?i:AB)Cde", ("cde",)), ("", ()),
])
def test_needed_literals(pattern, wanted):
    assert needed_literals(pattern) == wanted


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAkKsSiIſKıİΣσς̇éÉß ", max_size=12), st.integers(0, 11), st.integers(0, 12))
def test_folding_keeps_what_is_inside(text, a, b):
    assert fold(text[min(a, b) : max(a, b)]) in fold(text)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_no_match_without_a_needed_literal(pattern):
    draw = random.Random(pattern)
    literals = needed_literals(pattern)
    alphabet = sorted(set(pattern)) + list("ab kKſiİ1_\n ")
    for _ in range(300):
        text = "".join(draw.choices(alphabet, k=draw.randrange(25)))
        if re.search(pattern, text) and literals:
            assert any(t in fold(text) for t in literals)
    assert all(len(t) >= LEAST for t in literals)


def rule_rows(n):
    """Rules of many forms, some without a literal, one invalid, some for one suffix."""
    draw, rows = random.Random(n), []
    for i in range(n):
        word = draw.choice(WORDS)
        pattern = draw.choice([
            f"{word}{i % 50}\\b", f"(?i){word}_{i % 40}", f"(?:{word}|load{i % 30})\\s*\\(", f"{word}\\.(\\w+){i % 9}", f"call{i}\\(",
        ])
        if i % 97 == 0:
            pattern = draw.choice([r"x\d", r"[a-c]z", "(", "a|b{3}"])
        rows.append((f"R{i}", f"n{i}", "d", "security", "low", pattern, "", "", [".py"] if i % 5 == 0 else [], True, {}))
    return rows


def text_rows(n, rules):
    draw = random.Random(1)
    pieces = [f"{w}{j}" for w in WORDS for j in range(50)] + [f"{w.upper()}_{j} " for w in WORDS for j in range(40)]
    pieces += [f"load{j} (" for j in range(30)] + [f"call{j}(" for j in range(rules)] + ["x1", "az", "bbb", "a.b", "\n", "\n\n", " "]
    return {f"f{i}.{'py' if i % 2 else 'js'}": "\n".join(draw.choices(pieces, k=draw.randrange(300))) for i in range(n)}


@pytest.mark.parametrize("n", [150, 700])
def test_no_match_is_lost(spark, make_files, n):
    rows, texts = rule_rows(n), text_rows(40, n)
    found = custom_rules.apply_rules(make_files(texts), spark.createDataFrame(rows, RULE)).collect()
    wanted = Counter()
    for path, text in texts.items():
        for rule_id, *_, pattern, _, _, suffixes, _, _ in rows:
            if suffixes and not path.endswith(tuple(suffixes)):
                continue
            try:
                matches = list(re.finditer(pattern, text))
            except re.error:
                wanted[path, rule_id, 0, None] += 1
                continue
            for m in matches:
                wanted[path, rule_id, text[: m.start()].count("\n") + 1, m.group()] += 1
    assert Counter((r.path, r.check_id, r.line_number, r.metadata.get("match")) for r in found) == wanted
    assert sum(wanted.values()) > n


def test_two_thousand_rules_cost_less_than_three_times_twenty(spark, make_files):
    draw = random.Random(7)
    filler = ["value = compute(left, right)", "if value > 10:", "    print(value)", "# plain words of a comment", ""]
    texts = {}
    for i in range(400):
        lines = draw.choices(filler, k=1000)
        for _ in range(5):
            lines[draw.randrange(1000)] = draw.choice([f"call{draw.randrange(2000)}(", f"open{draw.randrange(50)}", "Render.x3"])
        texts[f"f{i}.py"] = "\n".join(lines)
    files = make_files(texts).repartition(4).checkpoint()

    def seconds(n):
        rows = [r for r in rule_rows(2100) if rule_source.pattern_problem(r[5]) is None and needed_literals(r[5])]
        rules = spark.createDataFrame(rows[:n], RULE)
        best = []
        for _ in range(2):
            start = time.time()
            custom_rules.apply_rules(files, rules).groupBy("check_id").count().collect()
            best.append(time.time() - start)
        return min(best)

    few, many = seconds(20), seconds(2000)
    assert many < 3 * few + 2
