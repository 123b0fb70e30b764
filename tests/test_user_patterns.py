"""User patterns mean in the engine what they mean in ``re``."""

import re

import pytest
from pyspark.sql import functions as F

from corpuslint.functions.text import with_lines
from corpuslint.functions.user_patterns import Unsupported, user_regex
from corpuslint.operators.custom_rules import apply_rules
from corpuslint.schemas import RULE
from corpuslint.sources.rules import pattern_problem

TEXT = (
    "PASSWORD = 1\npassword: ÄÖ straße 42\n\tfoo-bar foo-foo  a1b22\n[y] o-oo- a&b && x\nend\nlast_line = 'q' # Ünï\n"
    "aaa aba abba 7٣ \u2028z\r\nend\n"
)
PATTERNS = [
    r"(?i)password", r"\x50ASS", r"\101\d?", "(?x) foo - bar # dash", r"end\Z", r"end$", r"(?m)end$", r"(?m)^end", r"^PASS",
    r"[a&&b]", r"[[]y", r"o{,2}-", r"(?a)\w+b", r"(?a:\w+)\s", r"a(?#note)b", r"(?P<a_b>a)(?P<ab>b)(?P=a_b)", r"(?P<q>['\"])q(?P=q)",
    r"(\w)\1", r"\bfoo\b", r"\Bo", r"[^\W\d_]+", r"[\d]+", r"\d+", r"(?s)1.p", r"1.p", r"(?<=foo-)\w+", r"(?<!foo-)foo", r"foo(?!-bar)",
    r"a{2,}", r"a{2}?", r"(?:ab|abb)a", r"a*", r"x|", r"[]y]", r"[^]y]+\]", r"[a-c\-]+", r"\$|\#|\.", r"\u00c4|\N{LATIN SMALL LETTER SHARP S}",
    r"(?i)ÜNÏ", r"(?i:STRASSE|straße)", r"\t", r"(?>a+)b", r"a++", r"\s+$", r"\A\w", r"(?i)[^a-z\s]+", r"((a)|b)+", r"[\s\S]{3}", r"(?-i:x)|(?i:P)",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(TEXT,)], "content string")


def test_same_matches_as_re(frame):
    found = frame.select(
        *[F.regexp_extract_all("content", F.lit(str(user_regex(p))), F.lit(0)).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    ).first()
    for i, pattern in enumerate(PATTERNS):
        assert found[f"p{i}"] == [m.group() for m in re.finditer(pattern, TEXT)], pattern
    assert len(PATTERNS) >= 40


def test_problems():
    assert pattern_problem("(") and pattern_problem("*a") and pattern_problem("[z-a]")
    assert "not supported" in pattern_problem(r"(a)?(?(1)b|c)")
    assert all(pattern_problem(p) is None for p in PATTERNS)
    with pytest.raises(Unsupported):
        user_regex(r"(a)?(?(1)b|c)")


def test_rules_lose_no_match(spark, make_files):
    files = make_files({"a.py": TEXT})
    rules = spark.createDataFrame(
        [(f"R{i:02d}", "n", "d", "code_quality", "low", p, "s", "", [], True, {}) for i, p in enumerate(PATTERNS)], RULE
    )
    got = {}
    for r in apply_rules(files, rules).collect():
        got.setdefault(r.check_id, []).append((r.line_number, r.metadata["match"]))
    text = with_lines(files).select("content").first()[0]
    for i, pattern in enumerate(PATTERNS):
        want = [(text.count("\n", 0, m.start()) + 1, m.group()) for m in re.finditer(pattern, text)]
        assert sorted(got.get(f"R{i:02d}", [])) == sorted(want), pattern
