"""Plain texts that are searched together, and line numbers of matches in texts of any bytes."""

import random

from pyspark.sql import functions as F

from corpuslint import Audit
from corpuslint.functions.patterns import (
    java_regex, marks, needed_texts, rare_end, searched_together, sql_contains, sql_matches,
)
from corpuslint.functions.text import count_text, line_count, match_lines, with_lines
from corpuslint.operators.performance import called_names

NEEDLES = (
    "eval", "execute", "cursor.execute", "pickle.load", "pickle.loads", "django", "django.db", "react", "Query", "@Query",
    "EventHandler", "CommandHandler", "aaa", "aaab", "baaa", 'resource "', " lifetimes", "..\\", "<%@", "it's", "x=1",
    "new", "next", "-----", "a b", "ab", "é=é",
)


def test_texts_searched_together_are_found_as_one_by_one(spark):
    random.seed(5)
    pieces = [*NEEDLES, *[n[:-1] for n in NEEDLES], *[n[1:] for n in NEEDLES], "\n", " ", "é", "a", "b", "𝒳"]
    rows = [(i, "".join(random.choices(pieces, k=i % 9))) for i in range(400)] + [(400, None)]
    texts = spark.createDataFrame(rows, "id INT, content STRING")
    with searched_together() as ends:
        tests = [sql_contains("content", n) for n in NEEDLES]
    assert "ab" not in ends and ends == {rare_end(n) for n in NEEDLES if len(n) > 2 and n.isascii()}
    table = texts.withColumn("marks", marks(ends)).select(
        "id", "content", F.array(*map(F.expr, tests)).alias("together"),
        F.array(*[F.col("content").contains(n) for n in NEEDLES]).alias("single"),
    )
    found = table.collect()
    assert all(row.together == row.single for row in found)
    assert [row.together == [None] * len(NEEDLES) for row in found].count(True) == 1
    assert sql_contains("content", "execute") == "contains(content, 'execute')"


def test_an_audit_searches_the_text_for_all_plain_texts_at_once(spark, make_files):
    files = make_files({"p/a.py": "import os\npickle.loads(x)\n", "p/b.java": "import a;\n@Autowired Query q;\n"})
    plan = Audit(files).file_results()._jdf.queryExecution().analyzed().toString()
    assert "marks#" in plan
    few = Audit(files, analyzers="documentation").file_results()._jdf.queryExecution().analyzed().toString()
    assert "marks#" not in few


def test_lines_of_matches_in_bytes_that_are_no_text(spark):
    rows = spark.createDataFrame(
        [(1, bytearray(b"a x\n\xff x\xe4 x\n\xc3")), (2, bytearray("é x\n\x01x \x01\n".encode()))], "id INT, raw BINARY"
    )
    files = rows.select("id", F.col("raw").cast("string").alias("content"))
    found = with_lines(files).select("id", match_lines("x").alias("n")).orderBy("id").collect()
    assert [row.n for row in found] == [[1, 2, 2], [1, 2]]


def test_counts_of_lines_and_plain_texts(spark):
    texts = ["", "a", "a\n", "\n\na", "append", "appendappend\n xappend", "é\nappen", None]
    table = with_lines(spark.createDataFrame([(t,) for t in texts], "content STRING"))
    found = table.select(
        "content", line_count(F.col("content")).alias("searched"), line_count(F.col("content"), F.col("lines")).alias("sized"),
        count_text(F.col("content"), "append").alias("n"),
    ).collect()
    for row in found:
        expected = None if row.content is None else len(row.content.splitlines())
        assert row.searched == row.sized == expected
        assert row.n == (None if row.content is None else row.content.count("append"))


def test_a_match_contains_a_text_of_every_needed_set():
    assert needed_texts(r"new\s+\w+\[\]") == (("new",), ("[]",))
    assert needed_texts(r":\s*(?:string|any)\b") == (("any", "string"), (":",))
    assert needed_texts(r"(?i)password") == needed_texts(r"\p{L}+x") == needed_texts(r"a?|b") == ()
    for pattern, text in [(r"(ab|cd)+e{2}x*", "cdabeex"), (r"a\.b|a\.cd", "a.cd"), (r"def\s+\w+(?:\s*->\s*\w+)?:", "def f:")]:
        assert all(any(part in text for part in parts) for parts in needed_texts(pattern))


def test_called_names_are_those_of_the_regex(spark):
    random.seed(7)
    pieces = ["f", "g1", "(", "((", " (", "\t(", " (", "\n", " ", "é", ".", "_x", ")", "𝒳", "̇"]
    texts = ["".join(random.choices(pieces, k=i % 14)) for i in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "content STRING")
    regex = F.lit(java_regex(r"\b(\w+)\s*\("))
    found = rows.select("content", called_names(F.col("content")).alias("names"),
                        F.regexp_extract_all("content", regex, F.lit(1)).alias("expected")).collect()
    assert all(row["names"] == row["expected"] for row in found)


def test_gates_test_nothing_behind_a_text_that_is_missing():
    with searched_together():
        test = sql_matches("content", r"print\s*\(")
    assert test.startswith("IF((contains(marks, 'print')), IF((contains(content, '(')), regexp_like(") and "AND" not in test
    assert sql_matches("content", r"print\s*\(").startswith("(contains(content, 'print') AND regexp_like(")


def test_sections_names_and_secrets_are_found_as_before(spark, make_files):
    code = (
        'def f(a): int: "text"\n    g(1); f (2); f(3); f(4)\n\n'
        "def h(b):\n    '''Args'''\n    return other_name + camelCase\n"
        'x.y = {"password" : "hidden", "api\\u0307": 1}\nAWS_KEY = gitHub_token\ncopy = rows[:]\nn = 77\n'
    )
    found = Audit(make_files({"p/a.py": code})).findings().groupBy("check_id").count().collect()
    counts = {row.check_id: row["count"] for row in found}
    assert counts["DOC004"] == 1 and counts["PERF004"] == 1 and counts["QUAL008"] >= 1 and counts["SEC013"] >= 2
