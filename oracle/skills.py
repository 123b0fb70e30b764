"""Comparison SQL of skill recognition, Java skills and their findings."""

from __future__ import annotations

from corpuslint.operators.skills import tenths
from corpuslint.operators.java import skill_category
from corpuslint.packs import java, skills as pack
from corpuslint.packs.probes import SUFFIXES

from .base import CODE_FILES, LINES, any_of, finding, plain, q, re2, suffix_test


def named(tests: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN {q(name)} END" for name, test in tests.items())
    return f"[x FOR x IN [{cases}] IF x IS NOT NULL]"


def _languages() -> str:
    limit = tenths(pack.LANGUAGE_THRESHOLD)
    by_suffix = {n: suffix_test(i["suffixes"]) for n, i in pack.LANGUAGES.items()}
    by_pattern = {
        n: "(" + " + ".join(
            f"CASE WHEN regexp_matches(flat, {re2(p)}) THEN {tenths(w)} ELSE 0 END" for p, w in i["patterns"]
        ) + f") >= {limit} AND NOT {by_suffix[n]}"
        for n, i in pack.LANGUAGES.items()
    }
    return f"list_concat({named(by_suffix)}, {named(by_pattern)})"


def _either(*tests) -> str:
    return "(" + " OR ".join(any_of(c, words) for c, words in tests if words) + ")"


def _trait_sql() -> dict[str, str]:
    def count(words):
        return " + ".join(f"CAST(contains(content, {q(w)}) AS INT)" for w in words)

    return {
        "languages": _languages(),
        "frameworks": named({n: _either(("content", w), ("path", p)) for n, (w, p) in pack.FRAMEWORKS.items()}),
        "architectures": named({n: f"({count(w)}) >= 2" for n, w in pack.ARCHITECTURES.items()}),
        "devops": named({n: _either(("path", p), ("content", w)) for n, (p, w) in pack.DEVOPS.items()}),
        "cloud": named({n: any_of("lower(content)", w) for n, w in pack.CLOUD.items()}),
    }


TRAITS = (
    "traits AS (SELECT file_id, path, ext, content, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _trait_sql().items())
    + f" FROM (SELECT *, {plain('Q')} AS flat FROM code_files) WHERE {suffix_test(SUFFIXES['skills'])})"
)


def _level() -> str:
    branches = []
    for language, info in pack.LANGUAGES.items():
        words = " ".join(f"WHEN contains(content, {q(w)}) THEN {q(level)}" for w, level in info["levels"])
        branches.append(f"WHEN name = {q(language)} THEN CASE {words} ELSE 'beginner' END")
    return f"CASE {' '.join(branches)} ELSE 'beginner' END"


def _fill(template: str) -> str:
    return f"replace(replace({q(template)}, '{{name}}', name), '{{path}}', path)"


def _kind(kind: str, order: int) -> str:
    category, level, confidence, description, evidence = pack.KINDS[kind]
    return (
        f"SELECT file_id, path, {order} AS kind, i, name, {q(category)} AS category, "
        f"{_level() if level is None else q(level)} AS level, CAST({confidence} AS DOUBLE) AS confidence, "
        f"{_fill(evidence)} AS evidence, {_fill(description)} AS description FROM "
        f"(SELECT file_id, path, content, unnest({kind}) AS name, generate_subscripts({kind}, 1) AS i FROM traits)"
    )


def skill_select(kinds=tuple(pack.KINDS)) -> str:
    """file_id, path, seq, name, category, level, confidence, evidence, description."""
    union = " UNION ALL ".join(_kind(kind, i) for i, kind in enumerate(kinds))
    return (
        "SELECT file_id, path, CAST(row_number() OVER (PARTITION BY file_id ORDER BY kind, i) - 1 AS INT) AS seq, "
        f"name, category, level, confidence, evidence, description FROM ({union})"
    )


def skill_sql(kinds=tuple(pack.KINDS)) -> str:
    return f"WITH {CODE_FILES}, {TRAITS} {skill_select(kinds)}"


def skill_finding_select() -> str:
    parts = []
    for check_id, kind in zip(("SKILL001", "SKILL002", "SKILL003", "SKILL004"), pack.KINDS):
        parts.append(f"SELECT {finding(check_id, what=f'array_to_string({kind}, chr(44) || chr(32))')} "
                     f"FROM traits WHERE len({kind}) > 0")
    return " UNION ALL ".join(parts)


def _extract(pattern: str, group: int) -> str:
    return f"regexp_extract_all(content, {re2(pattern)}, {group})"


_PATTERNS = ",\n".join(
    f"({i}, {q(name)}, {q(skill_category(name))}, {q(level)}, {j}, {q(p)}, {re2(p)}, {tenths(w)}, {q(java.import_probe(p))})"
    for i, (name, (level, patterns)) in enumerate(java.SKILLS.items())
    for j, (p, w) in enumerate(patterns)
)
JAVA = f"""patterns(sk, name, category, level, ord, raw, rx, w, probe) AS (VALUES {_PATTERNS}),
jf AS (SELECT * FROM code_files WHERE ends_with(path, '.java')),
jhit AS (SELECT file_id, path, sk, ord, raw, w FROM jf, patterns WHERE regexp_matches(content, rx)),
jimp AS (SELECT file_id, path, unnest({_extract(java.IMPORT, 1)}) AS imp,
         generate_subscripts({_extract(java.IMPORT, 1)}, 1) AS i FROM jf),
jbon AS (SELECT file_id, path, sk, count(DISTINCT i) AS c FROM jimp, patterns WHERE contains(imp, probe) GROUP BY ALL),
jsum AS (SELECT file_id, path, sk, sum(w) AS w, list(raw ORDER BY ord)[1:3] AS ev FROM jhit GROUP BY ALL),
jscore AS (SELECT file_id, path, sk, coalesce(w, 0) + 3 * coalesce(c, 0) AS score, coalesce(ev, []) AS ev
           FROM jsum FULL JOIN jbon USING (file_id, path, sk)),
jskill AS (SELECT file_id, path, 0 AS grp, sk AS i, p.name, p.category, p.level,
           least(CAST(score AS DOUBLE) / 20, 1.0) AS confidence, array_to_string(ev, '|') AS evidence
           FROM jscore JOIN (SELECT DISTINCT sk, name, category, level FROM patterns) p USING (sk) WHERE score >= 8),
amap(a, skill) AS (VALUES {', '.join(f'({q(a)}, {q(s)})' for a, s in java.ANNOTATION_SKILLS.items())}),
auses AS (SELECT file_id, path, unnest({_extract(java.STRUCTURE['annotations'], 1)}) AS a,
          generate_subscripts({_extract(java.STRUCTURE['annotations'], 1)}, 1) AS i FROM jf),
askill AS (SELECT file_id, path, 1 AS grp, i, skill AS name, '框架组件' AS category, 'intermediate' AS level,
           CAST(0.7 AS DOUBLE) AS confidence, '@' || a || '注解' AS evidence FROM auses JOIN amap USING (a)),
pf AS (SELECT * FROM code_files WHERE ends_with(path, '.xml') AND contains(path, 'pom.xml')),
deps AS (SELECT file_id, path, unnest({_extract(java.DEPENDENCY, 1)}) AS group_id,
         unnest({_extract(java.DEPENDENCY, 2)}) AS artifact_id,
         generate_subscripts({_extract(java.DEPENDENCY, 1)}, 1) AS i FROM pf),
dmap(k, dkey, skill) AS (VALUES {', '.join(f'({i}, {q(k)}, {q(s)})' for i, (k, s) in enumerate(java.DEPENDENCY_SKILLS.items()))}),
dskill AS (SELECT file_id, path, 2 AS grp, i * 1000 + k AS i, skill AS name, 'Maven依赖' AS category,
           'intermediate' AS level, CAST(0.8 AS DOUBLE) AS confidence, 'Maven依赖: ' || artifact_id AS evidence
           FROM deps, dmap WHERE contains(group_id || ':' || artifact_id, dkey)),
plug AS (SELECT file_id, path, unnest({_extract(java.PLUGIN, 1)}) AS p,
         generate_subscripts({_extract(java.PLUGIN, 1)}, 1) AS i FROM pf)"""


def _fixed(source, test, grp, order, rest) -> str:
    name, category, level, confidence, evidence = rest
    return (
        f"SELECT file_id, path, {grp} AS grp, {order} AS i, {q(name)} AS name, {q(category)} AS category, "
        f"{q(level)} AS level, CAST({confidence} AS DOUBLE) AS confidence, {q(evidence)} AS evidence "
        f"FROM {source} WHERE {test}"
    )


def java_select() -> str:
    parts = [f"SELECT * FROM {t}" for t in ("jskill", "askill", "dskill")]
    parts += [_fixed("plug", f"contains(p, {q(word)})", 3, f"i * 10 + {k}", rest)
              for k, (word, *rest) in enumerate(java.POM_PLUGINS)]
    parts += [_fixed("pf", any_of("content", words), 4, k, rest) for k, (words, *rest) in enumerate(java.POM_WORDS)]
    parts += [_fixed("code_files", f"ends_with(path, '.properties') AND {any_of('content', words)}", 0, k, rest)
              for k, (words, *rest) in enumerate(java.PROPERTY_WORDS)]
    parts += [_fixed("code_files", f"(ends_with(path, '.yml') OR ends_with(path, '.yaml')) AND {any_of('content', words)}",
                     0, k, rest) for k, (words, *rest) in enumerate(java.YAML_WORDS)]
    return (
        "SELECT file_id, path, CAST(row_number() OVER (PARTITION BY file_id ORDER BY grp, i) - 1 AS INT) AS seq, name, "
        f"category, level, confidence, evidence, '' AS description FROM ({' UNION ALL '.join(parts)})"
    )


def java_sql() -> str:
    return f"WITH {CODE_FILES}, {JAVA} {java_select()}"


def practices_sql() -> str:
    """The practice pack; the pattern with a look-ahead is written as what it matches and what it does not."""
    plain = {r"extends\s+\w+\s*(?!\.)": r"extends\s+\w(?:[^.]|\z)"}  # a name of two letters or not before a dot
    rows = ", ".join(
        f"({i}, {q(name)}, {q(level)}, {j}, {q(p)}, {re2(plain.get(p, p))}, {tenths(w)}, {q(java.import_probe(p))})"
        for i, (name, (level, patterns)) in enumerate(java.PRACTICES.items()) for j, (p, w) in enumerate(patterns)
    )
    return f"""WITH {CODE_FILES}, {JAVA}, rules(sk, name, level, ord, raw, rx, w, probe) AS (VALUES {rows}),
hits AS (SELECT file_id, path, sk, sum(w) AS w, array_to_string(list(raw ORDER BY ord)[1:3], '|') AS ev
         FROM jf, rules WHERE regexp_matches(content, rx) GROUP BY ALL),
used AS (SELECT file_id, path, sk, count(DISTINCT i) AS c FROM jimp, rules WHERE contains(imp, probe) GROUP BY ALL)
SELECT file_id, path, name, level, CAST(coalesce(w, 0) + 3 * coalesce(c, 0) AS INT) AS score, coalesce(ev, '') AS evidence
FROM hits FULL JOIN used USING (file_id, path, sk) JOIN (SELECT DISTINCT sk, name, level FROM rules) USING (sk)"""


def all_skill_select() -> str:
    """Traits and Java skills of one file in one numbering, traits first."""
    return (
        "SELECT file_id, path, CAST(row_number() OVER (PARTITION BY file_id ORDER BY src, seq) - 1 AS INT) AS seq, "
        "name, category, level, confidence, evidence, description FROM ("
        f"SELECT 0 AS src, * FROM ({skill_select()}) UNION ALL SELECT 1 AS src, * FROM ({java_select()}))"
    )


def java_finding_select() -> dict[str, str]:
    """Java checks: the findings of every file kind."""
    deps = f"{_extract(java.DEPENDENCY, 1)}"
    package = f"regexp_extract(content, {re2(java.PACKAGE)}, 1)"

    def source(check_id, test):
        return f"SELECT {finding(check_id)} FROM jf WHERE {test}"

    return {
        "JAVA001": f"SELECT {finding('JAVA001', count=f'len({deps})')} FROM pf",
        "JAVA010": f"SELECT {finding('JAVA010', what=package)} FROM jf WHERE {package} <> ''",
        "JAVA020": source("JAVA020", f"regexp_matches(content, {re2(java.SYNCHRONIZED)})"),
        "JAVA021": source("JAVA021", "contains(content, '.stream()')"),
        "JAVA022": source("JAVA022", "contains(content, 'Optional<')"),
        "JAVA023": source("JAVA023", f"regexp_matches(content, {re2(java.CATCH_EXCEPTION)})"),
        "JAVA024": source("JAVA024", any_of("content", java.LOMBOK.split("|"))),
    }


def java_finding_sql(check_id: str) -> str:
    return f"WITH {CODE_FILES}, {LINES}, {JAVA} {java_finding_select()[check_id]}"
