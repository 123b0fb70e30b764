import json

import pytest
from pyspark.sql import functions as F

from corpuslint import Audit, audit_path, audit_paths
from corpuslint.functions import scoring
from corpuslint.operators import context, java, rollups, skills
from corpuslint.plans import audit as audit_plan, report
from corpuslint.sources import rules as rule_source
from corpuslint.streaming.arrivals import arriving_files, audit_stream

TEXTS = {
    "p/a.py": "import os\ndef f(x=[]):\n    eval(x)\n    return x\n",
    "p/b.py": '"""Doc."""\nVALUE = 1\n',
    "p/C.java": "package a;\nimport org.springframework.stereotype.Service;\n@Service\npublic class C extends D { @Autowired E e; }\n",
    "p/pom.xml": "<dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId></dependency>"
                 "<plugin><artifactId>maven-surefire-plugin</artifactId></plugin>",
    "p/application.yml": "server:\nspring:\n  redis:\n",
    "p/app.properties": "spring.x=1\njdbc.url=2",
    "p/Dockerfile.txt": "",
}


@pytest.fixture(scope="module")
def files(make_files):
    return make_files(TEXTS)


def test_totals_agree_however_they_are_computed(files):
    audit = Audit(files)
    one_pass = audit.totals().first().asDict()
    separate = rollups.totals(files, audit.findings(), audit.skills()).first().asDict()
    assert one_pass == separate
    assert one_pass["total_files"] == len(TEXTS) and one_pass["n_critical"] == 2
    assert one_pass["total_lines"] == 4 + 2 + 4 + 1 + 3 + 2 + 0


def test_summary_and_recommendations(files):
    audit = Audit(files, project="p")
    row = audit.summary().first()
    counts = audit.totals().first()
    want = round(max(0.0, 100 - counts.penalty / max(1, len(TEXTS) / 10)), 1)
    assert row.overall_score == want and row.gate == 2 and row.project_name == "p"
    assert row.issues_by_severity["critical"] == 2 and sum(row.issues_by_category.values()) == row.total_checks
    advice = [r.recommendation for r in audit.recommendations().orderBy("ordinal").collect()]
    assert advice[0].startswith("存在 2 个严重问题") and any("安全风险" in a for a in advice)


def test_empty_corpus(files):
    row = Audit(files.where("false")).summary().first()
    assert (row.total_files, row.overall_score, row.grade, row.gate) == (0, 100.0, "A", 0)
    advice = [r.recommendation for r in Audit(files.where("false")).recommendations().collect()]
    assert advice == ["代码技术栈较为单一，考虑引入更多现代工具和框架"]


def test_scores(spark):
    rows = spark.createDataFrame([(0, 5), (7, 1), (40, 100), (1000, 1), (45, 20)], "penalty INT, n INT")
    value = scoring.score(F.col("penalty"), F.col("n"))
    got = rows.select(value.alias("s"), scoring.grade(value).alias("g"), scoring.band(value).alias("b")).collect()
    assert [tuple(r) for r in got] == [
        (100.0, "A", "green"), (93.0, "A", "green"), (96.0, "A", "green"), (0.0, "F", "red"), (77.5, "C", "yellow")]
    gates = spark.createDataFrame([(1, 0), (0, 3), (0, 0)], "c INT, h INT")
    assert [r[0] for r in gates.select(scoring.gate(F.col("c"), F.col("h"))).collect()] == [2, 1, 0]


def test_choice_of_analyzers_and_severity(files):
    only = Audit(files, analyzers=["security"]).findings()
    assert {r.category for r in only.select("category").distinct().collect()} == {"security"}
    audit = Audit(files, min_severity="high")
    assert {r.severity for r in audit.findings().collect()} <= {"critical", "high"}
    assert audit.totals().first().total_checks == audit.findings().count()
    assert audit.findings_by_file().select(F.sum(F.size("findings"))).first()[0] == audit.findings().count()
    assert Audit(files, analyzers="quality", max_line_length=10).findings().where("check_id = 'QUAL001'").count() > 3
    assert audit_plan.analyzer_catalog(files.sparkSession).count() == 7


def test_findings_by_file_keeps_clean_files(files):
    rows = {r.path: r.findings for r in Audit(files).findings_by_file().collect()}
    assert set(rows) == set(TEXTS) and rows["p/Dockerfile.txt"] == []
    assert {f.check_id for f in rows["p/a.py"]} >= {"BP011", "SEC001-eval", "SKILL001"}


def test_saved_results_give_the_same(files, tmp_path):
    fresh, saved = Audit(files), Audit(files).save(str(tmp_path / "results"))
    order = ["path", "check_id", "line_number", "message"]
    assert fresh.findings().orderBy(*order).collect() == saved.findings().orderBy(*order).collect()
    assert fresh.totals().first() == saved.totals().first()


def test_save_goes_below_the_shared_folder(spark, files):
    audit = Audit(files, analyzers="security")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            audit.save()
        return
    folder = audit_plan.shared_folder(spark)
    assert all(f"{folder}/audit-" in name for name in audit.save().file_results().inputFiles())


def test_rules_and_extensions_take_part(spark, files, tmp_path):
    docs = spark.createDataFrame([('{"rule_id": "R1", "pattern": "eval", "severity": "low"}',)], "value STRING")
    audit = Audit(files, analyzers="documentation", rules=rule_source.parse_rules(docs))
    plain = Audit(files, analyzers="documentation").totals().first().total_checks
    assert audit.totals().first().total_checks == plain + 1

    def shouting(path, text):
        if "VALUE" in text:
            yield {"check_id": "EXT1", "check_name": "upper", "message": path, "severity": "high"}

    audit_plan.register_findings("shouting", audit_plan.python_analyzer(shouting))
    try:
        found = Audit(files, analyzers=["documentation", "shouting"])
        flat = found.findings_by_file().selectExpr("path", "inline(findings)").select("path", "check_id", "line_number")
        assert sorted(flat.collect()) == sorted(found.findings().select("path", "check_id", "line_number").collect())
        found.save(f"{tmp_path}/a")
        assert sorted(flat.collect()) == sorted(found.findings().select("path", "check_id", "line_number").collect())
        assert Audit(files, analyzers="documentation").findings().where("check_id = 'EXT1'").count() == 0
        assert audit_plan.analyzer_catalog(spark).where("analyzer = 'shouting'").count() == 1
        assert [r.path for r in found.findings().where("check_id = 'EXT1'").collect()] == ["p/b.py"]
        assert found.totals().first().total_checks == plain + 1
    finally:
        audit_plan.EXTRA_FINDINGS.clear()


def test_skills(files):
    rows = {(r.path, r.name, r.category): r for r in Audit(files).skills().collect()}
    java_row = rows[("p/C.java", "Java", "编程语言")]
    assert java_row.confidence == 0.8 and java_row.evidence == ["通过p/C.java识别"]
    spring = rows[("p/C.java", "Spring Framework", "Java框架")]
    assert spring.confidence == 1.0 and spring.evidence == [r"org\.springframework\.", "@Service", "@Autowired"]
    for key in [("p/pom.xml", "Spring Boot Web", "Maven依赖"), ("p/pom.xml", "单元测试", "测试"), ("p/pom.xml", "Spring Boot", "框架"),
                ("p/application.yml", "Redis缓存", "缓存"), ("p/app.properties", "数据库配置", "数据访问"),
                ("p/C.java", "Spring DI", "框架组件"), ("p/a.py", "Python", "编程语言")]:
        assert key in rows, key
    structure = java.java_structure(files).first()
    assert structure.package == "a" and structure.classes == ["C"] and "Service" in structure.annotations
    assert java.maven_dependencies(files).first().artifact_id == "spring-boot-starter-web"
    assert java.practice_scores(files).count() == 1


def test_dedup_keeps_best_then_first(spark):
    schema = "file_id STRING, path STRING, seq INT, name STRING, category STRING, level STRING, confidence DOUBLE, evidence ARRAY<STRING>"
    rows = spark.createDataFrame([
        ("2", "b", 0, "X", "c", "expert", 0.9, ["1"]), ("1", "a", 1, "X", "c", "beginner", 0.9, ["2"]),
        ("1", "a", 0, "X", "d", "beginner", 0.5, ["3"]), ("3", "c", 0, "X", "c", "beginner", 0.1, ["4"])], schema)
    got = {(r.name, r.category): r.evidence for r in rollups.dedup_skills(rows).collect()}
    assert got == {("X", "c"): ["2"], ("X", "d"): ["3"]}
    assert rollups.dedup_skills(rows, ("name",)).count() == 1
    shares = {r.category: r.share for r in rollups.skill_distribution(rows).collect()}
    assert shares == {"c": 0.75, "d": 0.25}


def test_context(files):
    found = Audit(files, analyzers=["security", "best_practices"]).findings()
    rows = {r.check_id: r for r in context.attach_context(found, files).collect()}
    assert rows["SEC001-eval"].context == "    import os\n    def f(x=[]):\n>>>     eval(x)\n        return x\n    "
    assert "ast.literal_eval" in rows["SEC001-eval"].fix and "BP011" in rows
    assert context.repair_hint(found).where("fix is null").count() == 0
    from corpuslint.operators import best_practices, documentation, performance, quality, security

    probes = [p for m in (best_practices, documentation, performance, quality, security) for p in m.probes()]
    direct = context.findings_with_context(files, probes)
    assert "Join" not in direct._jdf.queryExecution().executedPlan().toString()
    columns = ["path", "check_id", "line_number", "message", "context", "fix"]
    stored = context.attach_context(Audit(files, analyzers=["quality", "best_practices", "security", "performance", "documentation"]).findings(), files)
    assert sorted(map(tuple, direct.select(*columns).collect())) == sorted(map(tuple, stored.select(*columns).collect()))


def test_metrics(make_files):
    text = 'class A:\n    """One\n    two"""\n    # note\n\n    x = 1 if y and z else 2\n'
    row = rollups.file_metrics(make_files({"a.py": text})).first()
    assert (row.line_count, row.code_lines, row.complexity, row.classes, row.comments) == (6, 3, 4, 1, 1)


def test_report(files, tmp_path):
    out = str(tmp_path / "report")
    report.write_report(Audit(files, project="p"), out)
    read = files.sparkSession.read.text
    summary = json.loads(read(out + "/summary").first().value)
    assert summary["project_name"] == "p" and summary["grade"]
    result = json.loads(read(out + "/results").where("value like '%SEC001-eval%'").first().value)
    assert result["location"] == {"file_path": "p/a.py", "line_number": 3, "column_number": 0, "snippet": "    eval(x)"}
    assert read(out + "/file_results").count() == len(TEXTS)
    report.write_findings(Audit(files), str(tmp_path / "table"))
    assert files.sparkSession.read.parquet(str(tmp_path / "table")).where("severity = 'critical'").count() == 2


def test_paths(spark, tmp_path):
    (tmp_path / "one.py").write_text("x = 1\n")
    (tmp_path / "two.py").write_text("y = 2\n")
    row = audit_path(spark, str(tmp_path)).summary().first()
    assert (row.total_files, row.total_lines, row.project_name) == (2, 2, tmp_path.name)
    both = audit_paths(spark, [str(tmp_path / "one.py"), str(tmp_path)]).summary().first()
    assert both.total_files == 2 and both.project_name == "Multi-file Audit"


def test_stream(spark, files, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.write.parquet(source)
    for _ in range(2):
        audit_stream(arriving_files(spark, source), out, str(tmp_path / "state"), analyzers="security").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == Audit(files, analyzers="security").findings().count()


def test_trait_order(files):
    rows = skills.file_traits(files).where("path = 'p/C.java'").first()
    assert rows.languages == ["Java"] and rows.frameworks == ["Spring"]


def test_per_file_limits_are_parameters(make_files):
    files = make_files({"a.py": "".join(f"# TODO item {i}\n" for i in range(9))})

    def marks(**options):
        return Audit(files, analyzers="documentation", **options).findings().where("check_id = 'DOC007'").count()

    assert (marks(), marks(per_file=(3, None, 5)), marks(per_file=(3, 2, 5))) == (5, 9, 2)
