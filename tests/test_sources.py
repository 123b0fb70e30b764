import json

import pytest
from pyspark.sql import functions as F

from corpuslint.operators.custom_rules import apply_rules
from corpuslint.sources import files as source, rules as rule_source


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "build" / "proj"
    for name, data in {
        "a.py": b"x = 1\r\ny = 2\rz\xff = 3\n", "B.JS": b"var a", "notes.txt": b"no", "node_modules/x.js": b"no",
        "src/dist/y.py": b"no", "src/c.go": b"package m", ".hidden": b"no", "src/.py": b"no",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def _names(files):
    return sorted(r.file_name for r in files.collect())


def test_scan(spark, project):
    files = source.scan(spark, str(project))
    assert _names(files) == ["B.JS", "a.py", "c.go"]
    row = files.where("file_name = 'a.py'").first()
    assert row.content == "x = 1\ny = 2\nz = 3\n" and row.ext == ".py" and row.path.startswith("/")
    assert _names(source.scan(spark, str(project), recursive=False)) == ["B.JS", "a.py"]
    assert _names(source.scan(spark, str(project / "a.py"))) == ["a.py"]
    both = source.scan_paths(spark, [str(project), str(project / "a.py")])
    assert _names(both) == ["B.JS", "a.py", "c.go"]
    inner = source.scan_paths(spark, [str(project), str(project / "src/dist"), str(project / "src")])
    assert _names(inner) == ["B.JS", "a.py", "c.go", "y.py"]
    flat = source.scan_paths(spark, [str(project), str(project / "a.py")], recursive=False)
    assert _names(flat) == ["B.JS", "a.py"]


def test_suffix_and_language(spark):
    rows = spark.createDataFrame([("a/b.PY",), ("a/.py",), ("a.b/c",), ("x/d.tar.gz",)], "p STRING")
    assert [r[0] for r in rows.select(source.suffix(F.col("p"))).collect()] == [".py", "", "", ".gz"]
    assert [r[0] for r in rows.select(source.language(F.col("p"))).collect()] == ["python", "python", "unknown", "unknown"]


def test_only_paths_and_lines(spark, make_files):
    files = make_files({"a.py": "1\n\n  2", "b.py": ""})
    kept = source.only_paths(files, spark.createDataFrame([("a.py",)], "path STRING"))
    lines = source.explode_lines(kept).orderBy("line_number").collect()
    assert [(r.line_number, r.line, r.stripped, r.indent) for r in lines] == [(1, "1", "1", 0), (2, "", "", 0), (3, "  2", "2", 2)]


def test_scan_reads_every_name(spark, tmp_path):
    names = ["a.py", "__init__.py", "_private.py", "B.Py", "C.PY", "_internal/x.py", ".github/y.py", ".hidden.js"]
    for name in [*names, ".git/z.py", ".py", "build/w.py"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    root = str(tmp_path)
    assert sorted(r.path.removeprefix(root + "/") for r in source.scan(spark, root).collect()) == sorted(names)
    assert _names(source.scan(spark, f"{root}/__init__.py")) == ["__init__.py"]
    assert _names(source.scan(spark, root, recursive=False)) == sorted(n for n in names if "/" not in n)
    with pytest.raises(FileNotFoundError):
        source.scan(spark, f"{root}/absent")
    errors = source.scan_errors(spark, [root, f"{root}/absent.py"]).collect()
    assert [r.path for r in errors] == [f"{root}/absent.py"]


def test_many_paths_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(3000):
        path = tmp_path / f"d{i % 7}" / f"_f{i}.py"
        path.parent.mkdir(exist_ok=True)
        path.write_text(str(i))
        paths.append(str(path))
    found = source.scan_paths(spark, [*paths, *paths[:50], str(tmp_path)])
    assert sorted(r.content for r in found.select("content").collect()) == sorted(map(str, range(3000)))


def test_too_large_files_are_errors(spark, tmp_path):
    (tmp_path / "a.py").write_text("x" * 100)
    (tmp_path / "b.py").write_text("x")
    rows = {r.path[-4:]: r for r in source.raw_files(spark, [str(tmp_path)], most_bytes=50).collect()}
    assert rows["a.py"].content is None and "50 bytes" in rows["a.py"].error and rows["b.py"].error is None


def test_decode_keeps_genuine_marks(spark):
    raws = [b"a\xff\xef\xbf\xbdb", b"\xef\xbf\xbd", b"\xef\xbf\xbe\xff1", b"\xe4\xef\xbf\xbd\xef\xbf", b"ok", b"\xc3\xa9\xc3"]
    rows = spark.createDataFrame([(r,) for r in raws], "r binary").select(source.decode(F.col("r"))).collect()
    assert [r[0] for r in rows] == [r.decode(errors="ignore") for r in raws]


RULES = {
    "list.json": [{"id": "CUSTOM1", "pattern": r"\bprint\s*\(", "file_extensions": ".py", "suggestion": "log"},
                  {"name": "no id"}, "text", {"rule_id": "OFF", "pattern": "x", "enabled": False}],
    "object.json": {"rules": [{"rule_id": "R2", "pattern": "(", "name": "bad"},
                              {"rule_id": "R3", "pattern": "(?P<a_b>todo)", "severity": "HIGH", "category": "security",
                               "metadata": {"k": "v"}, "fix_template": "t"}]},
    "deep/one.json": {"rule_id": "R4", "pattern": "", "severity": "odd", "category": "odd"},
}


@pytest.fixture()
def rule_dir(tmp_path):
    for name, data in RULES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(data))
    (tmp_path / "broken.json").write_text("{nope")
    return tmp_path


def test_rules(spark, rule_dir, make_files):
    rules = rule_source.load_rule_directory(spark, str(rule_dir))
    rows = {r.rule_id: r for r in rules.collect()}
    assert set(rows) == {"CUSTOM1", "OFF", "R2", "R3", "R4"}
    assert rows["CUSTOM1"].name == "CUSTOM1" and rows["CUSTOM1"].file_extensions == [".py"]
    assert (rows["R3"].severity, rows["R3"].category, rows["R3"].metadata) == ("high", "security", {"k": "v"})
    assert (rows["R4"].severity, rows["R4"].category, rows["OFF"].enabled) == ("medium", "code_quality", False)
    top = rule_source.load_rule_directory(spark, str(rule_dir), recursive=False)
    assert {r.rule_id for r in top.collect()} == {"CUSTOM1", "OFF", "R2", "R3"}
    assert rule_source.by_category(rules, "security").count() == 1
    assert rule_source.by_extension(rules, ".js").count() == 4
    errors = rule_source.rule_errors(spark, str(rule_dir / "broken.json"), str(rule_dir / "absent.json"))
    assert errors.count() == 2
    (rule_dir / "_r.json").write_text('{"rule_id": "HIDDEN", "pattern": "x"}')
    assert rule_source.load_rule_directory(spark, str(rule_dir)).where("rule_id = 'HIDDEN'").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in rule_source.rule_errors(spark, str(rule_dir)).collect()] == ["broken.json"]
    assert rule_source.load_rules(spark, str(rule_dir / "object.json")).count() == 2

    files = make_files({"a.py": "print(1)\n# todo {line}", "b.js": "print(2)"})
    found = {(r.path, r.check_id): r for r in apply_rules(files, rules).collect()}
    assert set(found) == {("a.py", "CUSTOM1"), ("a.py", "R2"), ("b.js", "R2"), ("a.py", "R3")}
    custom = found[("a.py", "CUSTOM1")]
    assert custom.metadata == {"rule": "CUSTOM1", "match": "print("} and custom.suggestion.startswith("log\n\n推荐使用:")
    assert custom.category == "professional" and custom.line_number == 1
    assert found[("a.py", "R3")].severity == "high" and "```\nt\n```" in found[("a.py", "R3")].suggestion
    bad = found[("b.js", "R2")]
    assert bad.severity == "medium" and bad.check_name.endswith("bad") and bad.line_number == 0


def test_rule_pages_keep_every_rule(spark, make_files, monkeypatch):
    monkeypatch.setattr(rule_source, "RULES_PER_PASS", 2)
    docs = spark.createDataFrame([(json.dumps([{"rule_id": f"R{i}", "pattern": f"w{i}\\b"} for i in range(5)]),)], "value STRING")
    found = apply_rules(make_files({"a.py": "w0 w1 w2 w3 w4 w44"}), rule_source.parse_rules(docs))
    assert sorted(r.check_id for r in found.collect()) == [f"R{i}" for i in range(5)]


def test_zero_width_rule(spark, make_files):
    docs = spark.createDataFrame([('{"rule_id": "Z", "pattern": "x*"}',)], "value STRING")
    rows = apply_rules(make_files({"a.py": "axx\nb"}), rule_source.parse_rules(docs)).collect()
    import re

    want = [("axx\nb"[: m.start()].count("\n") + 1, m.group()) for m in re.finditer("x*", "axx\nb")]
    assert sorted((r.line_number, r.metadata["match"]) for r in rows) == sorted(want)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A folder and its name in a store that only Spark's readers open."""
    folder = tmp_path_factory.mktemp("store")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.corpus.link./data", f"file://{folder}")
    return folder, "viewfs://corpus/data"


def test_scan_of_a_store_that_only_spark_opens(spark, store):
    folder, name = store
    for path in ("p/a.py", "p/b/C.JS", "p/b/d.txt", "p/dist/e.py", "p/b/c/f.go", "dist/g.py"):
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text("x = 1\r\ny")
    files = source.scan(spark, f"{name}/p")
    assert _names(files) == ["C.JS", "a.py", "f.go"] and {r.content for r in files.collect()} == {"x = 1\ny"}
    assert _names(source.scan(spark, f"{name}/p", recursive=False)) == ["a.py"]
    assert _names(source.scan(spark, f"{name}/dist")) == ["g.py"]
    assert _names(source.scan(spark, f"{name}/p/b/C.JS")) == ["C.JS"]
    both = source.scan_paths(spark, [f"{name}/p", str(folder / "dist"), f"{name}/p/a.py"])
    assert _names(both) == ["C.JS", "a.py", "f.go", "g.py"]
    with pytest.raises(FileNotFoundError):
        source.scan(spark, f"{name}/absent")
    errors = source.scan_errors(spark, [f"{name}/p", f"{name}/absent"]).collect()
    assert [(r.path, r.error) for r in errors] == [(f"{name}/absent", "no such file or directory")]
    large = source.raw_files(spark, [f"{name}/p"], most_bytes=3).collect()
    assert len(large) == 5 and all(r.content is None and "3 bytes" in r.error for r in large)


def test_levels_of_folders(spark, tmp_path, monkeypatch):
    """One job a depth, every folder dealt on its own; an excluded folder is never entered."""
    from corpuslint.sources import raw

    for i in range(40):
        path = tmp_path / f"a{i % 4}" / f"_b{i % 8}" / f".c{i}"
        path.mkdir(parents=True, exist_ok=True)
        (path / f"_f{i}.py").write_text(str(i))
    (tmp_path / "a0" / "dist").mkdir()
    levels = []
    keep = raw.saved
    monkeypatch.setattr(raw, "saved", lambda frame: levels.append(frame.rdd.getNumPartitions()) or keep(frame))
    found = source.scan(spark, str(tmp_path), excluded=("dist",))
    assert sorted(r.content for r in found.collect()) == sorted(map(str, range(40)))
    assert len(levels) == 4 and min(levels) >= 8


def test_table_of_paths(spark, tmp_path):
    """Every path of a table is read where a task finds it, once, with a row for what cannot be read."""
    rows = []
    for i in range(400):
        (tmp_path / f"_{i}.py").write_text(f"print({i})\r\n")
        rows.append((i, f"{tmp_path}/_{i}.py", "s"))
    rows += [(500, f"{tmp_path}/_1.py", "s"), (501, f"{tmp_path}/gone.py", "s"), (502, str(tmp_path), "s"), (503, None, "s"),
             (504, "nostore://x/y.py", "s")]
    paths = spark.createDataFrame(rows, "n int, path string, content string")
    found = source.scan_table(paths)
    assert sorted(r.content for r in found.collect()) == sorted(f"print({i})\n" for i in range(400))
    errors = {r.path: r.error for r in source.scan_table_errors(paths).collect()}
    assert set(errors) == {f"{tmp_path}/gone.py", str(tmp_path), "nostore://x/y.py"}
    assert errors[f"{tmp_path}/gone.py"] == "no such file" and errors[str(tmp_path)] == "not a file"
    assert source.scan_table(paths, (".js",)).count() == 0 and source.scan_table(paths.limit(0)).count() == 0


def test_audit_of_a_table_of_paths(spark, tmp_path):
    from corpuslint import audit_table

    (tmp_path / "a.py").write_text("eval(x)\n")
    paths = spark.createDataFrame([(f"{tmp_path}/a.py",)], "path string")
    found = audit_table(paths, analyzers=["security"]).findings().select("check_id").distinct().collect()
    assert "SEC001-eval" in {r.check_id for r in found}


def test_rule_statuses(spark, tmp_path):
    """Missing, locked, broken and partly rejected files side by side, from real files."""
    (tmp_path / "ok.json").write_text('{"rules": [{"rule_id": "A", "pattern": "a"}, {"id": "B"}]}')
    (tmp_path / "bad.json").write_text('[{"rule_id": "C"}, {"name": "no id"}, {"rule_id": ""}]')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "folder.json").mkdir()
    names = ["ok", "bad", "broken", "empty", "absent"]
    documents = rule_source._documents(spark, [f"{tmp_path}/{n}.json" for n in names])
    large = documents.limit(1).select(F.lit("x/large.json").alias("path"), F.lit(None).cast("string").alias("value"),
                                      F.lit("larger than 5 bytes").alias("error"))
    found = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in rule_source.rule_statuses(documents.unionByName(large)).collect()}
    assert found == {
        "ok.json": ("ok", 2, 0), "bad.json": ("bad_rule", 1, 2), "broken.json": ("not_json", 0, 0), "empty.json": ("not_json", 0, 0),
        "absent.json": ("missing", 0, 0), "large.json": ("unreadable", 0, 0),
    }
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in rule_source.rule_errors(spark, *[f"{tmp_path}/{n}.json" for n in names]).collect()}
    assert set(errors) == {"broken.json", "empty.json", "absent.json"} and "不存在" in errors["absent.json"]
