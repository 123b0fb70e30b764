"""Comparison SQL of every check: check id → (CTEs, select)."""

from __future__ import annotations

from corpuslint.packs import probes as pack
from corpuslint.packs.probes import SUFFIXES

from .base import (
    CODE_FILES, LINES, SPACE, WORD, any_of, count_text, finding, match_cte, plain, q, re2, strip,
    suffix_test, with_line,
)

QUAL, BEST, SEC = SUFFIXES["quality"], SUFFIXES["best_practices"], SUFFIXES["security"]
PERF, DOC = SUFFIXES["performance"], SUFFIXES["documentation"]
Parts = tuple[list[str], str]


def _file(check_id: str, suffixes, where: str) -> Parts:
    return [], f"SELECT {finding(check_id)} FROM code_files WHERE {suffix_test(suffixes)} AND ({where})"


def _rx(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {re2(pattern, flags)})"


def _text(pattern: str, letter: str = "Q") -> str:
    return plain(letter) if r"\b" in pattern else "content"


def _matches(check_id: str, patterns, suffixes, flags="", where="true", snippet="line", groups=(),
             what=None, letter="Q") -> Parts:
    """One finding per match of each pattern."""
    ctes, selects = [], []
    for i, pattern in enumerate(patterns):
        name = f"m{i}"
        ctes.append(match_cte(name, pattern.regex, suffixes, flags, _text(pattern.regex, letter), groups))
        about = q(pattern.what) if what is None else what
        selects.append(
            f"SELECT {finding(check_id, 'n', snippet, about)} FROM {with_line(name)} WHERE {where}"
        )
    return ctes, " UNION ALL ".join(selects)


def _security() -> dict[str, Parts]:
    found = {}
    for name, pattern, _, _ in pack.DANGEROUS:
        found[f"SEC001-{name}"] = _matches(f"SEC001-{name}", [pattern], SEC)
    for check_id, patterns in pack.SECURITY.items():
        options = {}
        if check_id in ("SEC013", "SEC016"):
            options["where"] = "NOT starts_with(t, '#')"
        if check_id == "SEC013":
            options.update(flags="i", snippet=q(pack.CREDENTIAL_SNIPPET))
        found[check_id] = _matches(check_id, patterns, SEC, **options)
    found["SEC019"] = _file(
        "SEC019", SEC,
        "contains(lower(content), 'form') AND contains(content, 'action=') "
        "AND NOT contains(lower(content), 'csrf') AND NOT contains(lower(content), 'token')")
    return found


INDENT = f"(length(line) - length(regexp_replace(line, '^[{SPACE}]+', '')))"


def _quality() -> dict[str, Parts]:
    inside = suffix_test(QUAL)
    long_line = (
        f"{inside} AND length(line) > 120 AND NOT contains(line, 'http://') "
        "AND NOT contains(line, 'https://') AND NOT starts_with(t, '#') AND NOT starts_with(t, '//')"
    )
    head = match_cte("m", pack.FUNCTION_HEAD, QUAL, groups=(1,))
    ends = (
        "ends AS (SELECT file_id, n AS e FROM lines WHERE t <> '' AND NOT starts_with(t, '#') "
        f"AND {INDENT} = 0)"
    )
    sized = (
        "sized AS (SELECT m.file_id, m.path, m.k, m.n, any_value(m.g1) AS g1, coalesce(min(e) - m.n - 1, "
        "any_value(total) - m.n) AS len FROM m JOIN (SELECT file_id, max(n) AS total FROM lines GROUP BY 1) USING (file_id) "
        "LEFT JOIN ends ON ends.file_id = m.file_id AND e > m.n GROUP BY m.file_id, m.path, m.k, m.n)"
    )
    code = (
        "code AS (SELECT file_id, path, t, row_number() OVER (PARTITION BY file_id ORDER BY n) AS pos "
        f"FROM lines WHERE {inside} AND t <> '' AND NOT starts_with(t, '#'))"
    )
    fresh = (
        "fresh AS (SELECT *, row_number() OVER (PARTITION BY file_id, t ORDER BY pos) = 1 AS is_new "
        "FROM code WHERE length(t) > 20)"
    )
    grouped = (
        "grouped AS (SELECT *, sum(CAST(is_new AS INT)) OVER (PARTITION BY file_id ORDER BY pos) AS grp, "
        "sum(CAST(is_new AS INT)) OVER (PARTITION BY file_id) AS last_grp FROM fresh)"
    )
    blocks = (
        "blocks AS (SELECT file_id, path, grp, min(pos) AS n, arg_min(t, pos) AS t, count(*) AS c FROM grouped "
        "WHERE grp < last_grp GROUP BY file_id, path, grp HAVING count(*) >= 3)"
    )
    magic_text = (
        "regexp_replace(regexp_replace(content, '([A-Za-z_])[0-9]', '\\1' || chr(2), 'g'), "
        "'[0-9]([A-Za-z_])', chr(2) || '\\1', 'g')"
    )
    magic = match_cte("m", "[2-9]|[1-9][0-9]{2,}", QUAL, text=magic_text,
                      extra=", regexp_extract(part, '^([2-9]|[1-9][0-9]{2,})') AS g0")
    ordinary = ", ".join(q(str(v)) for v in pack.ORDINARY_NUMBERS)
    styles = [
        f"len(regexp_extract_all({plain(letter)}, {re2(p)}))"
        for p, letter in zip(pack.NAME_STYLES, "Z00")
    ]
    section = (
        f"s AS (SELECT *, sum(CAST(starts_with(t, 'def ') AS INT)) OVER (PARTITION BY file_id ORDER BY n) AS g "
        f"FROM lines WHERE {inside})"
    )
    returned = (
        "r AS (SELECT *, max(CAST(starts_with(t, 'return') AS INT)) OVER (PARTITION BY file_id, g ORDER BY n "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ret FROM s WHERE g >= 1)"
    )
    hard_ctes, hard_selects = [], []
    for i, p in enumerate(pack.HARDCODED):
        anchored = re2(f"^(?:{p.regex})")
        hard_ctes.append(match_cte(f"m{i}", p.regex, QUAL, text=_text(p.regex),
                                   extra=f", regexp_extract(part, {anchored}) AS g0"))
        hard_selects.append(f"SELECT {finding('QUAL005', 'n', 'g0', q(p.what))} FROM m{i}")
    return {
        "QUAL001": ([], "SELECT " + finding(
            "QUAL001", "n", "line[1:100] || '...'", count="length(line)",
            severity="CASE WHEN length(line) < 200 THEN 'low' ELSE 'medium' END")
            + f" FROM lines WHERE {long_line}"),
        "QUAL002": ([head, ends, sized], "SELECT " + finding(
            "QUAL002", "n", "'def ' || g1 || '(...)'", "g1", "len") + " FROM sized WHERE len > 50"),
        "QUAL003": ([code, fresh, grouped, blocks], "SELECT " + finding(
            "QUAL003", "n", "t[1:80]", count="c") + " FROM blocks"),
        "QUAL004": _matches("QUAL004", [pack.Pattern(pack.EMPTY_EXCEPT)], QUAL, flags="m"),
        "QUAL005": (hard_ctes, " UNION ALL ".join(hard_selects)),
        "QUAL006": _file("QUAL006", QUAL, f"({' + '.join(styles)}) > 10 AND "
                         f"({' + '.join(f'CAST({s} > 0 AS INT)' for s in styles)}) >= 2"),
        "QUAL007": ([], "SELECT " + finding("QUAL007", "n", "t[1:80]", count=f"{INDENT} // 4")
                    + f" FROM lines WHERE {inside} AND {INDENT} // 4 > 4"),
        "QUAL008": ([magic], "SELECT " + finding("QUAL008", "n", "'数字: ' || g0", "g0")
                    + f" FROM m WHERE length(g0) <= 4 AND g0 NOT IN ({ordinary})"),
        "QUAL009": ([section, returned], "SELECT " + finding("QUAL009", "n", "t[1:80]")
                    + " FROM r WHERE ret = 1 AND t <> '' AND NOT starts_with(t, '#') "
                      "AND NOT starts_with(t, 'return') AND NOT starts_with(t, 'def ')"),
    }


def _best_practices() -> dict[str, Parts]:
    inside = suffix_test(BEST)
    public = "(NOT starts_with(g1, '_') OR g1 IN ('__init__', '__str__', '__repr__'))"
    typed = match_cte("m", pack.TYPED_FUNCTION, BEST, groups=(1, 2))
    plain_head = ("regexp_extract(content, 'def[" + SPACE + "]+' || g1 || '[" + SPACE
                  + "]*\\([^)]*\\):')")
    triple = any_of("near", ('"""', "'''"))
    public_head = match_cte(
        "m", pack.PUBLIC_FUNCTION, BEST, groups=(1,),
        extra=", substr(content, CAST(off + length(regexp_extract(part, "
              + re2(f"^(?:{pack.PUBLIC_FUNCTION})") + ")) + 1 AS BIGINT), 200) AS near")
    first_code = (
        "fc AS (SELECT file_id, coalesce(min(n) FILTER (WHERE t <> '' AND NOT starts_with(t, '#')), 1) AS first_n "
        "FROM lines GROUP BY file_id)"
    )
    late = (
        "late AS (SELECT file_id, path, bool_or(imp AND n < first_n AND n <= 5) AS top, bool_or(imp AND n > 5) AS below "
        "FROM (SELECT *, contains(line, 'import ') OR contains(line, 'from ') AS imp FROM lines "
        f"WHERE {inside}) JOIN fc USING (file_id) GROUP BY file_id, path)"
    )
    uses = match_cte("m", pack.UPPERCASE_NAME, BEST, text=plain("q"), groups=(1,),
                     extra=", substr(content, CAST(off + length(regexp_extract(part, "
                           + re2(f"^(?:{pack.UPPERCASE_NAME})") + ")) + 1 AS BIGINT), 1) AS nxt")
    words = any_of("g1", pack.CONSTANT_WORDS)
    named = (
        f"named AS (SELECT file_id, path, g1, min(n) AS n FROM m WHERE {words} GROUP BY file_id, path, g1 "
        "HAVING bool_or(NOT regexp_matches(nxt, '^[A-Z_]')))"
    )
    raised = (
        "(instr(line, 'raise') > 0 AND NOT contains(line[1:instr(line, 'raise') - 1] "
        "|| line[instr(line, 'raise') + 5:], 'raise '))"
    )
    printing = _rx(plain("Q", "line"), pack.PRINT_CALL)
    first_print = (
        f"p AS (SELECT file_id, path, min(n) AS n FROM lines WHERE ext = '.py' AND {printing} "
        "AND NOT contains(line, 'def __repr__') GROUP BY file_id, path)"
    )
    crowded = (
        f"{inside} AND contains(line, 'for') AND contains(line, '[') AND "
        f"({count_text('line', 'for')} > 2 OR {count_text('line', 'if')} > 2)"
    )
    imports = (
        f"im AS (SELECT file_id, path, unnest(regexp_extract_all(content, {re2(pack.FROM_IMPORT)}, 1)) AS x "
        f"FROM code_files WHERE {inside})"
    )
    py, js = (".py",), (".js", ".ts")
    return {
        "BP001": _matches("BP001", [pack.Pattern(pack.BARE_EXCEPT)], BEST),
        "BP002": _matches("BP002", [pack.Pattern(pack.RERAISE)], BEST, where=raised, snippet="''"),
        "BP003": _file("BP003", BEST, "contains(content, 'open(') AND NOT contains(content, 'with open(')"),
        "BP004": _file("BP004", BEST, _rx("content", pack.OPENING_CALL)
                       + " AND NOT contains(content, 'with') AND NOT contains(content, 'finally')"),
        "BP005": ([typed], "SELECT " + finding("BP005", "n", "'def ' || g1 || '(...):'", "g1")
                  + f" FROM m WHERE {public} AND g2 = '' AND g1 <> '__init__'"),
        "BP006": ([typed], "SELECT " + finding("BP006", "n", what="g1")
                  + f" FROM (SELECT *, {plain_head} AS head FROM m) WHERE {public} AND head <> '' "
                    "AND NOT contains(head, '->') AND NOT contains(head, ': ')"),
        "BP007": ([public_head], "SELECT " + finding("BP007", "n", "'def ' || g1 || '(...):'", "g1")
                  + f" FROM m WHERE NOT {triple}"),
        "BP008": ([first_code, late], "SELECT " + finding("BP008")
                  + " FROM late WHERE below AND NOT coalesce(top, false)"),
        "BP009": ([imports], "SELECT " + finding("BP009", what="x") + " FROM im WHERE NOT contains(x, '.')"),
        "BP010": ([uses, named], "SELECT " + finding("BP010", "n", what="g1") + " FROM named"),
        "BP011": _matches("BP011", [pack.Pattern(pack.MUTABLE_DEFAULT)], BEST),
        "BP012": ([], "SELECT " + finding("BP012", "n", "t[1:80]") + f" FROM lines WHERE {crowded}"),
        "BP013": ([first_print], "SELECT " + finding("BP013", "n") + " FROM p"),
        "BP014": _file("BP014", py, _rx("content", pack.BOOL_COMPARISON)),
        "BP015": _file("BP015", py, "contains(content, 'def ') AND NOT contains(content, '__all__')"),
        "BP016": _file("BP016", js, _rx(plain("Q"), pack.VAR_KEYWORD)),
        "BP017": _file("BP017", js, _rx("content", pack.LOOSE_EQUALITY)),
        "BP018": _file("BP018", js, _rx("content", pack.CONSOLE_LOG)),
    }


def _loop_state(out: str, where: str) -> str:
    """Lines inside a loop: the last loop or exit line decides."""
    loop = "(contains(t, 'for ') OR contains(t, 'while '))"
    return f"""st AS (SELECT *, {loop} AS is_loop FROM lines WHERE {suffix_test(PERF)}),
ev AS (SELECT *, last_value(CASE WHEN is_loop THEN 1 WHEN {out} THEN 0 END IGNORE NULLS) OVER (
  PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_loop,
  sum(CASE WHEN is_loop OR ({out}) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n) AS run FROM st),
inl AS (SELECT * FROM ev WHERE in_loop = 1 AND ({where}))"""


def _performance() -> dict[str, Parts]:
    margin = "NOT starts_with(line, '    ')"
    attrs = re2(r"\w+\.\w+")
    shared = (
        "sh AS (SELECT *, lag(attrs) OVER (PARTITION BY file_id, run ORDER BY n) AS prev FROM "
        f"(SELECT *, regexp_extract_all(t, {attrs}) AS attrs FROM inl WHERE t <> ''))"
    )
    loop = "regexp_matches(t, '^(for|while)($|[^" + WORD + "])')"
    walk = f"""dl AS (SELECT *, {loop} AS lp, starts_with(t, 'def ') AS hd,
  sum(CAST(starts_with(t, 'def ') AS INT)) OVER (PARTITION BY file_id ORDER BY n) AS g
  FROM lines WHERE {suffix_test(PERF)}),
mv AS (SELECT *, CASE WHEN hd OR starts_with(t, 'return') THEN 0 WHEN lp THEN CASE WHEN {margin} THEN 0 ELSE 1 END
  WHEN {margin} THEN -1 ELSE 0 END AS d FROM dl WHERE g >= 1),
sm AS (SELECT *, sum(d) OVER (PARTITION BY file_id, g ORDER BY n) AS s FROM mv),
dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY file_id, g ORDER BY n)) AS depth FROM sm),
pv AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY file_id, g ORDER BY n), 0) AS before FROM dp)"""
    effect = match_cte(
        "m", pack.PURE_FUNCTION, PERF, groups=(1,),
        extra=", substr(content, CAST(off + length(regexp_extract(part, "
              + re2(f"^(?:{pack.PURE_FUNCTION})") + ")) + 1 AS BIGINT), 500) AS body")
    calls = f"len(regexp_extract_all({plain('Q')}, '\\b' || g1 || '[{SPACE}]*\\('))"
    copies = match_cte("m", pack.LIST_COPY, PERF, groups=(1,),
                       extra=f", regexp_extract(part, {re2('^(?:' + pack.LIST_COPY + ')')}) AS g0")
    return {
        "PERF001": ([walk], "SELECT " + finding("PERF001", "n", "t", count="before + 1")
                    + " FROM pv WHERE lp AND NOT hd AND before + 1 >= 3"),
        "PERF002": ([_loop_state(f"starts_with(t, 'def ') OR {margin}", _rx("line", pack.STRING_APPEND))],
                    "SELECT " + finding("PERF002", "n", "line") + " FROM inl"),
        "PERF003": _file("PERF003", PERF, _rx("content", pack.STRING_CHAIN)),
        "PERF004": ([copies], "SELECT " + finding("PERF004", "n", "g0", "g1") + " FROM m"),
        "PERF005": _file("PERF005", PERF, f"{count_text('content', 'append')} > 5"),
        "PERF006": _file("PERF006", PERF, _rx(plain("Q"), pack.MEMBERSHIP)),
        "PERF007": _matches("PERF007", [pack.Pattern(pack.GLOBAL_NAME)], PERF),
        "PERF008": ([_loop_state(margin, "true"), shared],
                    "SELECT " + finding("PERF008", "n", "t[1:80]")
                    + " FROM sh WHERE NOT is_loop AND list_has_any(attrs, prev)"),
        "PERF009": ([_loop_state(f"{margin} AND t <> ''", _rx("t", pack.REGEX_CALL))],
                    "SELECT " + finding("PERF009", "n", "t") + " FROM inl"),
        "PERF010": ([_loop_state(f"{margin} AND t <> ''", _rx("t", pack.QUERY_CALL))],
                    "SELECT " + finding("PERF010", "n", "t[1:80]") + " FROM inl"),
        "PERF011": _file("PERF011", PERF, _rx("content", pack.LENGTH_OF_RANGE)),
        "PERF012": ([effect], "SELECT " + finding("PERF012", "n", what="g1", count="c")
                    + f" FROM (SELECT *, {calls} AS c FROM m WHERE NOT contains(body, 'global') "
                      "AND NOT contains(body, 'print')) WHERE c > 3"),
    }


def _documentation() -> dict[str, Parts]:
    inside = suffix_test(DOC)
    kept = "(NOT starts_with(g1, '_') OR g1 IN (" + ", ".join(q(n) for n in pack.DOCUMENTED_ANYWAY) + "))"
    functions = match_cte(
        "m", pack.DOCUMENTED_FUNCTION, DOC, groups=(1, 2, 3, 4),
        extra=", substr(content, CAST(off + length(regexp_extract(part, "
              + re2(f"^(?:{pack.DOCUMENTED_FUNCTION})") + ")) + 1 AS BIGINT), 500) AS body")
    documented = f"{kept} AND g4 <> '' AND {strip('g2')} <> ''"
    classes = match_cte("m", pack.DOCUMENTED_CLASS, DOC, groups=(1, 2))
    code_top = (
        f"ct AS (SELECT DISTINCT file_id FROM lines WHERE {inside} AND n <= 10 AND t <> '' AND NOT starts_with(t, '#'))"
    )
    empty = [
        r"^\s*#.*\b(the|a|an)\s+\w+\s*$", r"^\s*#.*\b(and|or|but)\s+\w+\s*$",
        r"^\s*#\s*(ok|okay|yes|no)\s*$", r"^\s*#(.*[^a-zA-Z])?([a-z])\s*$",
    ]
    # The last pattern reads letters, so it sees the original text.
    tests = " OR ".join(
        _rx(plain("Q", "t") if i < 3 else "t", p, "i") for i, p in enumerate(empty)
    )
    header = any_of("lower(t)", pack.HEADER_WORDS)
    comments = (
        "cm AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS rk FROM lines "
        f"WHERE {inside} AND starts_with(t, '#') AND NOT {header} AND ({tests}))"
    )
    todo_ctes = [match_cte(f"w{i}", p.regex, DOC, "i", plain("Q")) for i, p in enumerate(pack.TODO_WORDS)]
    todo_union = " UNION ALL ".join(
        f"SELECT file_id, path, ext, n, k, {i} AS kind, {q(p.what)} AS what FROM w{i}"
        for i, p in enumerate(pack.TODO_WORDS)
    )
    todo = (
        "td AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY kind, k) AS rk "
        f"FROM ({todo_union}))"
    )
    api_ctes = [match_cte(f"r{i}", p.regex, DOC) for i, p in enumerate(pack.API_ROUTES)]
    api_union = " UNION ALL ".join(
        f"SELECT file_id, path, ext, n, k, {i} AS kind, {q(p.what)} AS what FROM r{i}"
        for i, p in enumerate(pack.API_ROUTES)
    )
    api = (
        "ap AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY kind, k) AS rk "
        f"FROM ({api_union}))"
    )
    bare = (
        "bare AS (SELECT * FROM ap WHERE rk <= 5 AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.file_id = ap.file_id "
        f"AND l.n BETWEEN ap.n + 1 AND ap.n + 5 AND {any_of('l.line', pack.DOC_MARKS)}))"
    )
    parts = [
        f"CASE WHEN NOT {_rx('content', pack.README_TITLE, 'm')} THEN {q(pack.README_PARTS[0])} END",
        f"CASE WHEN NOT contains(lower(content), 'install') THEN {q(pack.README_PARTS[1])} END",
        f"CASE WHEN NOT {any_of('lower(content)', ('usage', 'example'))} THEN {q(pack.README_PARTS[2])} END",
        f"CASE WHEN NOT contains(lower(content), 'license') THEN {q(pack.README_PARTS[3])} END",
    ]
    readme = (
        f"rd AS (SELECT file_id, path, concat_ws(', ', {', '.join(parts)}) AS missing FROM code_files "
        f"WHERE {inside} AND contains(lower(path), 'readme'))"
    )
    return {
        "DOC001": ([code_top], "SELECT " + finding("DOC001") + " FROM code_files JOIN ct USING (file_id) "
                   f"WHERE NOT starts_with(content, {q(chr(34) * 3)}) AND NOT starts_with(content, {q(chr(39) * 3)})"),
        "DOC002": ([functions], "SELECT " + finding(
            "DOC002", "n", "'def ' || g1 || '(' || g2 || '):'", "g1") + f" FROM m WHERE {kept} AND g4 = ''"),
        "DOC003": ([functions], "SELECT " + finding("DOC003", "n", what="g1")
                   + f" FROM m WHERE {documented} AND NOT regexp_matches(body, 'Args|Arguments|Parameters|参数')"),
        "DOC004": ([functions], "SELECT " + finding("DOC004", "n", what="g1")
                   + f" FROM m WHERE {documented} AND g3 NOT IN ('', 'None') "
                     "AND NOT regexp_matches(body, 'Returns?|返回')"),
        "DOC005": ([classes], "SELECT " + finding("DOC005", "n", "'class ' || g1 || ':'", "g1")
                   + " FROM m WHERE NOT starts_with(g1, '_') AND g2 = ''"),
        "DOC006": ([comments], "SELECT " + finding("DOC006", "n", "t[1:80]") + " FROM cm WHERE rk <= 3"),
        "DOC007": ([*todo_ctes, todo], "SELECT " + finding("DOC007", "n", "t[1:100]", "what")
                   + " FROM td JOIN lines USING (file_id, path, ext, n) WHERE rk <= 5"),
        "DOC008": ([*api_ctes, api, bare], "SELECT " + finding("DOC008", "n", "t[1:80]", "what")
                   + " FROM bare JOIN lines USING (file_id, path, ext, n)"),
        "DOC009": ([readme], "SELECT " + finding("DOC009", "1", what="missing") + " FROM rd WHERE missing <> ''"),
    }


CHECK_PARTS: dict[str, Parts] = {**_quality(), **_best_practices(), **_security(), **_performance(), **_documentation()}


def check_sql(check_id: str) -> str:
    ctes, select = CHECK_PARTS[check_id]
    return "WITH " + ",\n".join([CODE_FILES, LINES, *ctes]) + "\n" + select


def union_ctes(check_ids) -> tuple[list[str], str]:
    """CTEs and one select for the findings of several checks; each check keeps its own
    CTEs in a nested query."""
    selects = []
    for check_id in check_ids:
        ctes, select = CHECK_PARTS[check_id]
        inner = f"WITH {', '.join(ctes)} {select}" if ctes else select
        selects.append(f"SELECT * FROM ({inner})")
    return [CODE_FILES, LINES], " UNION ALL ".join(selects)
