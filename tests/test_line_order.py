"""Checks that follow line order, against direct definitions on random files."""

import random
import re

import pytest

from corpuslint.operators import best_practices, documentation, performance, quality
from corpuslint.operators.probe import run_probes
from randomtext import random_lines


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return {f"r/f{i}.py": random_lines(rng) for i in range(400)}


@pytest.fixture(scope="module")
def found(corpus, make_files):
    wanted = ("QUAL002", "QUAL003", "QUAL007", "QUAL009", "PERF001", "PERF002", "PERF008", "PERF009", "PERF010",
              "BP008", "BP013", "DOC006")
    probes = [
        p for module in (quality, best_practices, performance, documentation) for p in module.probes()
        if p.check_id in wanted and p.check_id != "QUAL002"
    ] + [quality.long_functions(3)]
    result = {}
    for row in run_probes(make_files(corpus).repartition(8), probes).collect():
        result.setdefault((row.path, row.check_id), []).append((row.line_number, row.message))
    return {key: sorted(rows) for key, rows in result.items()}


def _same(corpus, found, check_id, define):
    hits = 0
    for path, text in corpus.items():
        want = sorted(define(text.split("\n")))
        got = [n for n, _ in found.get((path, check_id), [])]
        assert got == want, (check_id, text)
        hits += len(want)
    assert hits > 0, f"{check_id} was never exercised"


def _latest(events, i):
    """The last event at or before line i."""
    return next((events[j] for j in range(i, -1, -1) if events[j]), None)


def _loop_lines(lines, leaves):
    events = [
        "in" if "for " in s.strip() or "while " in s.strip() else "out" if leaves(s) else None for s in lines
    ]
    return [i for i in range(len(lines)) if _latest(events, i) == "in"], events


def _margin(s):
    return not s.startswith("    ")


def test_concat_in_loop(corpus, found):
    def define(lines):
        inside, _ = _loop_lines(lines, lambda s: s.strip().startswith("def ") or _margin(s))
        return [i + 1 for i in inside if re.search(r"""\+=?\s*["']""", lines[i])]

    _same(corpus, found, "PERF002", define)


def test_regex_and_query_in_loop(corpus, found):
    def define(pattern):
        def run(lines):
            inside, _ = _loop_lines(lines, lambda s: _margin(s) and s.strip() != "")
            return [i + 1 for i in inside if re.search(pattern, lines[i])]

        return run

    _same(corpus, found, "PERF009", define(r"re\.(compile|search|match|findall)"))
    _same(corpus, found, "PERF010", define(r"\.(query|filter|all|get|find|select)\s*\(|cursor\.execute"))


def test_repeated_attributes(corpus, found):
    def define(lines):
        inside, events = _loop_lines(lines, _margin)
        seen = [i for i in inside if lines[i].strip()]
        pairs = zip(seen, seen[1:])
        return [
            b + 1 for a, b in pairs
            if events[b] != "in" and not any(e == "out" for e in events[a + 1 : b + 1])
            and set(re.findall(r"\w+\.\w+", lines[a])) & set(re.findall(r"\w+\.\w+", lines[b]))
        ]

    _same(corpus, found, "PERF008", define)


def test_loop_depth(corpus, found):
    def define(lines):
        heads = [i for i, s in enumerate(lines) if s.strip().startswith("def ")]
        hits = []
        for k, head in enumerate(heads):
            depths = [0]
            for i in range(head + 1, heads[k + 1] if k + 1 < len(heads) else len(lines)):
                text, loop = lines[i].strip(), re.match(r"(for|while)\b", lines[i].strip())
                if loop and depths[-1] >= 2:
                    hits.append(i + 1)
                step = 0 if text.startswith("return") else (1 if loop else 0) - (1 if _margin(lines[i]) else 0)
                depths.append(max(0, depths[-1] + step))
        return hits

    _same(corpus, found, "PERF001", define)


def test_unreachable(corpus, found):
    def define(lines):
        texts = [s.strip() for s in lines]
        hits = []
        for i, t in enumerate(texts):
            before = [j for j in range(i + 1) if texts[j].startswith("def ")]
            if before and t and not t.startswith(("#", "return", "def ")):
                if any(x.startswith("return") for x in texts[before[-1] : i]):
                    hits.append(i + 1)
        return hits

    _same(corpus, found, "QUAL009", define)


def test_repeats(corpus, found):
    def define(lines):
        code = [s.strip() for s in lines if s.strip() and not s.strip().startswith("#")]
        long_at = [i for i, t in enumerate(code) if len(t) > 20]
        fresh = [k for k, i in enumerate(long_at) if code[i] not in {code[j] for j in long_at[:k]}]
        return [long_at[a] + 1 for a, b in zip(fresh, fresh[1:]) if b - a >= 3]

    _same(corpus, found, "QUAL003", define)


def test_function_length(corpus, found):
    def define(lines):
        text = "\n".join(lines)
        hits = []
        for m in re.finditer(r"(?:def|async\s+def)\s+(\w+)\s*\([^)]*\)\s*(?:->\s*\w+)?\s*:", text):
            n = text[: m.start()].count("\n") + 1
            ends = [i for i, s in enumerate(lines, 1)
                    if i > n and s.strip() and not s.strip().startswith("#") and s == s.lstrip()]
            size = ends[0] - n - 1 if ends else len(lines) - n
            if size > 3:
                hits.append(n)
        return hits

    _same(corpus, found, "QUAL002", define)


def test_late_imports_and_first_print(corpus, found):
    def late(lines):
        importing = ["import " in s or "from " in s for s in lines]
        code = [i for i, s in enumerate(lines) if s.strip() and not s.strip().startswith("#")]
        top = min(5, code[0] if code else 0)
        return [0] if any(importing[5:]) and not any(importing[:top]) else []

    def printing(lines):
        return [i for i, s in enumerate(lines, 1) if re.search(r"\bprint\s*\(", s)][:1]

    _same(corpus, found, "BP008", late)
    _same(corpus, found, "BP013", printing)


def test_nested_loops_in_time_linear_in_the_file(make_files):
    """Every second line of a file is a finding; twice the file takes about twice the time."""
    import time

    probe = [p for p in performance.probes() if p.check_id == "PERF001"]

    def seconds(n):
        text = "def f():\n    for a in b:\n        for c in d:\n" + "            for e in f:\n            x = 1\n" * n
        files = make_files({"a.py": text})
        best = []
        for _ in range(2):
            start = time.time()
            assert run_probes(files, probe).count() == n
            best.append(time.time() - start)
        return min(best)

    seconds(1000)
    assert seconds(80_000) < 3 * seconds(40_000) + 1
