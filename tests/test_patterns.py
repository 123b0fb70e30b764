"""Every pattern finds what the plain regex engine of Python finds, on the same lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslint.functions.patterns import FOLDED, is_plain, required_text
from corpuslint.functions.text import match_table, with_lines
from corpuslint.packs import java, probes as pack, skills
from randomtext import random_text

MULTILINE = {pack.EMPTY_EXCEPT}


def _patterns():
    found = [(p, {}) for _, p, _, _ in pack.DANGEROUS]
    found += [(p, {"ignore_case": True} if check == "SEC013" else {})
              for check, patterns in pack.SECURITY.items() for p in patterns]
    found += [(p, {}) for p in (*pack.HARDCODED, *pack.API_ROUTES)]
    found += [(p, {"ignore_case": True}) for p in pack.TODO_WORDS]
    plain = (
        pack.FUNCTION_HEAD, pack.EMPTY_EXCEPT, *pack.NAME_STYLES, pack.MAGIC_NUMBER, pack.BARE_EXCEPT, pack.RERAISE,
        pack.OPENING_CALL, pack.TYPED_FUNCTION, pack.PUBLIC_FUNCTION, pack.FROM_IMPORT, pack.UPPERCASE_NAME,
        pack.MUTABLE_DEFAULT, pack.PRINT_CALL, pack.BOOL_COMPARISON, pack.VAR_KEYWORD, pack.LOOSE_EQUALITY,
        pack.CONSOLE_LOG, pack.STRING_APPEND, pack.STRING_CHAIN, pack.LIST_COPY, pack.MEMBERSHIP, pack.GLOBAL_NAME,
        pack.ATTRIBUTE, pack.REGEX_CALL, pack.QUERY_CALL, pack.LENGTH_OF_RANGE, pack.PURE_FUNCTION,
        pack.DOCUMENTED_FUNCTION, pack.DOCUMENTED_CLASS, *java.STRUCTURE.values(), java.PACKAGE, java.IMPORT,
        java.DEPENDENCY, java.PLUGIN, java.CATCH_EXCEPTION,
    )
    found += [(pack.Pattern(p), {"multiline": True} if p in MULTILINE else {}) for p in plain]
    found += [(pack.Pattern(p), {}) for info in skills.LANGUAGES.values() for p, _ in info["patterns"]]
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["", "\n", "\u0001\n\u0001"] + [random_text(rng) for _ in range(250)]


def test_matches_and_lines(spark, texts):
    patterns = _patterns()
    files = spark.createDataFrame(list(enumerate(texts)), "i INT, content STRING").repartition(8)
    for start in range(0, len(patterns), 25):
        group = patterns[start : start + 25]
        rows = with_lines(files).select("i", *[
            match_table(p.regex, tuple(range(re.compile(p.regex).groups + 1)), **flags).alias(f"p{k}")
            for k, (p, flags) in enumerate(group)
        ]).collect()
        for row in rows:
            text = texts[row.i]
            for k, (p, flags) in enumerate(group):
                mode = (re.IGNORECASE if "ignore_case" in flags else 0) | (re.MULTILINE if "multiline" in flags else 0)
                want = [
                    (text[: m.start()].count("\n") + 1, m.group(0), *(g or "" for g in m.groups()))
                    for m in re.finditer(p.regex, text, mode)
                ]
                assert [tuple(m) for m in row[f"p{k}"]] == want, (p.regex, text)


def test_needles_are_necessary(texts):
    for p, flags in _patterns():
        if p.needles:
            mode = re.IGNORECASE if "ignore_case" in flags else 0
            for text in texts:
                if re.search(p.regex, text, mode):
                    assert any(needle in text for needle in p.needles), (p, text)


def test_required_text(texts):
    assert required_text(r"\bimport\s+\w+") == "import" and required_text(r"a|b") == ""
    assert required_text(r"https?://x") == "http" and required_text(r"x[ab]yz+(cd)?") == "yz"
    assert required_text(r"\.\.[/\\]") == ".." and required_text(r"[\]a]b") == "b"
    assert is_plain(r"std::") and is_plain(r"org\.junit\.") and not is_plain(r"a\w") and not is_plain("a+")
    assert is_plain(r"any\(\)") and not is_plain(r"any()") and not is_plain(r"Queue\b")
    for p, flags in _patterns():
        if not flags:
            for text in texts:
                if re.search(p.regex, text):
                    assert required_text(p.regex) in text, (p, text)


def test_folded_words(spark):
    words = ["TODO", "FİXME", "fıxme", "HAC\u212a", "\u017fecret x", "AWS_\u017fecret", "é Todo"]
    rows = spark.createDataFrame([(w,) for w in words], "content STRING").select(F.expr(FOLDED).alias("f")).collect()
    assert [r.f for r in rows] == ["todo", "fixme", "fixme", "hack", "secret x", "aws_secret", "é todo"]


def test_java_pack_patterns(spark):
    assert java.SKILLS["Spring Framework"][1][:3] == [
        (r"org\.springframework\.", 0.8), ("@Controller", 0.7), ("@RestController", 0.8)]
    assert java.import_probe(r"org\.hibernate\.") == "org.hibernate."
    samples = ["@Test", "when(x)", "orElse(", ".orElse(", "FROM  maven", "any()", "::go", "<%@ page", "a -> {", "System.out.print"]
    table = spark.createDataFrame([(s,) for s in samples], "content STRING")
    from corpuslint.operators.java import feature

    patterns = [p for _, features in java.SKILLS.values() for p, _ in features]
    rows = table.select("content", *[F.expr(feature(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for row in rows:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == bool(re.search(p, row.content)), (p, row.content)
