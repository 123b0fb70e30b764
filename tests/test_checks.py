"""One small file per behaviour: which checks speak up, and where."""

import pytest

from corpuslint.operators import best_practices, documentation, java, performance, quality, security
from corpuslint.operators.probe import run_probes

PROBES = [
    p for module in (quality, best_practices, security, performance, documentation, java) for p in module.probes()
]

CASES = {
    "a/long.py": ("x = 1\n" + "y" * 121 + "\n# " + "z" * 200 + "\nu = 'http://" + "w" * 150 + "'", {"QUAL001": [2]}, set()),
    "a/limit.py": ("v" * 120, {}, {"QUAL001"}),
    "a/except.py": ("try:\n    a()\nexcept:\n    pass\n", {"QUAL004": [3], "BP001": [3]}, set()),
    "a/named.py": ("try:\n    a()\nexcept ValueError:\n    log()\n", {}, {"QUAL004", "BP001"}),
    "a/eval.py": ("r = eval(user_text)", {"SEC001-eval": [1]}, {"SEC010", "SEC011"}),
    "a/sql.py": ('q = "select " + name\ncursor.execute(q)', {}, {"SEC010", "SEC001-sql_raw"}),
    "a/sql2.py": ("cursor.execute('a' +\n  b)", {"SEC010": [1], "SEC001-sql_raw": [1]}, set()),
    "a/keys.py": ('API_KEY = "abc"\npassword = "def"', {}, {"SEC013", "SEC001-hardcoded_password"}),
    "a/keys2.py": ("d = {'Password': 'x'}\n# {'password': 'x'}\nAWS_secret = 1", {"SEC013": [1, 3]}, set()),
    "a/defaults.py": ("def create(name, tags=[]):\n    return tags", {"BP011": [1], "BP005": [1], "BP006": [1]}, set()),
    "a/typed.py": ("def f(a: int) -> int:\n    return a", {}, {"BP005", "BP006"}),
    "a/nested_head.py": ("def f(def g(x: int):\n", {"BP006": []}, set()),
    "a/doc.py": ('def f(a):\n    """Text."""\n    return a', {"DOC003": [1], "DOC001": [0]}, {"DOC002", "BP007"}),
    "a/doc2.py": ('"""M."""\ndef f(a):\n    """Text.\n\n    Args: a"""', {}, {"DOC003", "DOC002", "DOC001"}),
    "a/magic.py": ("a = 150\nb = 77\nc = 42\nd = x7\ne = 10000", {"QUAL008": [1, 2, 2]}, set()),
    "a/names.py": ("one two three four five six seven eight nine ten someName OtherName", {"QUAL006": [0]}, set()),
    "a/nplus.py": ("for a in b:\n    Q.filter(a)\nQ.filter(b)", {"PERF010": [2]}, set()),
    "a/concat.py": ('for a in b:\n    s += str(a)\n    t += "x"', {"PERF002": [3]}, set()),
    "a/reraise.py": ("try: pass\nexcept A: raise\n", {"BP002": [2]}, set()),
    "a/const.py": ("MAX_A = B_C\nMAX_A =B\nMIN_B =C", {"BP010": [1]}, set()),
    "a/é.py": ("éeval(x)\neval (x)", {"SEC001-eval": [2]}, set()),
    "a/todo.py": ("# todo one\nx = 1 # FIXME\n# métodotodo\n", {"DOC007": [1, 2]}, set()),
    "a/route.py": ("@app.route('/a')\ndef a():\n    pass\n", {"DOC008": [1, 1]}, set()),
    "a/route2.py": ('@app.route("/a")\ndef a():\n    """Doc."""\n', {"DOC008": []}, set()),
    "a/cache.py": ("def f(a):\n    return a\nf(1); f(2); f(3)", {"PERF012": [1]}, set()),
    "a/cache2.py": ("def f(a):\n    print(a)\nf(1); f(2); f(3)", {}, {"PERF012"}),
    "a/README.md": ("# Title\nhow to install and usage and license", {}, {"DOC009"}),
    "b/README.rst": ("nothing", {"DOC009": [1]}, set()),
    "a/page.js": ("<form action='x'>", {"SEC019": [0], "BP017": [0]}, set()),
    "a/page.rb": ("<form action='x'> csrf", {}, {"SEC019"}),
    "a/Job.java": ("package a.b;\n@Data class J { void f() { synchronized (x) { } } }", {"JAVA010": [0], "JAVA020": [0], "JAVA024": [0]}, {"JAVA021"}),
    "m/pom.xml": ("<dependency><groupId>g</groupId>\n<artifactId>lombok</artifactId></dependency>", {"JAVA001": [0]}, {"QUAL001"}),
    "a/notes.txt": ("eval(x) TODO except:", {}, {"SEC001-eval", "DOC007", "BP001"}),
}


@pytest.fixture(scope="module")
def found(make_files):
    rows = run_probes(make_files({p: c for p, (c, _, _) in CASES.items()}), PROBES).collect()
    result = {}
    for row in rows:
        result.setdefault(row.path, {}).setdefault(row.check_id, []).append(row)
    return result


@pytest.mark.parametrize("path", CASES)
def test_case(found, path):
    _, expected, absent = CASES[path]
    got = found.get(path, {})
    for check_id, lines in expected.items():
        assert sorted(r.line_number for r in got.get(check_id, [])) == lines, check_id
    assert not absent & set(got)


def test_texts(found):
    row = found["a/long.py"]["QUAL001"][0]
    assert (row.severity, row.severity_rank, row.snippet) == ("low", 3, "y" * 100 + "...")
    assert "121" in row.message and "120" in row.message and "120" in row.suggestion
    assert found["a/keys2.py"]["SEC013"][0].snippet == "[敏感信息已隐藏]"
    assert found["a/Job.java"]["JAVA010"][0].metadata == {"package": "a.b", "classes": "J"}
    assert found["m/pom.xml"]["JAVA001"][0].tags == ["g:lombok"]
    magic = found["a/magic.py"]["QUAL008"]
    assert {r.snippet for r in magic} == {"数字: 150", "数字: 7"}
    assert {r.suggestion for r in magic} >= {"考虑定义一个具有描述性名称的常量，如 MAX_150 = 150"}


def test_checks_are_narrow(make_files):
    """The whole pack runs without an exchange."""
    plan = run_probes(make_files({"a.py": "x"}), PROBES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
