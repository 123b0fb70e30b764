"""Registered queries over sources, rules, context and raw tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslint.functions import scoring
from corpuslint.functions.text import NAMING, naming_style
from corpuslint.functions.patterns import extract
from corpuslint.operators.context import findings_with_context
from corpuslint.operators.custom_rules import (
    BAD_RULE_MESSAGE, BAD_RULE_NAME, BAD_RULE_SUGGESTION, DEFAULT_SUGGESTION, FIX_EXAMPLE, PRINT_HINT,
    TODO_HINT, apply_rules,
)
from corpuslint.operators.probe import run_probes
from corpuslint.packs.catalog import FIX_LAYOUT, FIXES
from corpuslint.packs.probes import SUFFIXES
from corpuslint.plans import audit as audit_plan
from corpuslint.plans.report import as_json, nested_findings
from corpuslint.schemas import RULE
from corpuslint.sources import files as file_source, rules as rule_source
from corpuslint.sources.samples import code_files, document_files, page_files

from .base import CODE_FILES, LINES, SPACE, match_cte, plain, q, re2, suffix_test
from .checks import CHECK_PARTS, union_ctes
from .rollups import PENALTY_SUM

# Our own rules for the registered rule queries.
RULES = [
    ("CUSTOM01", "no print", "use a logger", "best_practices", "medium", r"\bprint\s*\(", "log it", "",
     [".py"], True, {}),
    ("CUSTOM02", "open work", "finish it", "maintainability", "low", r"TODO|FIXME", "", "", [], True, {}),
    ("R03", "no eval", "evaluates text", "security", "high", r"eval\s*\([^)]*\)", "parse it",
     "ast.literal_eval(x)", [".py", ".js", ".ts"], True, {}),
    ("R04", "wrapped words", "ends a line", "code_quality", "info", r",\s*\n\w+", "", "", [".md", ".java"], True, {}),
    ("R05", "switched off", "never runs", "code_quality", "info", r"\w", "", "", [], False, {}),
    ("R06", "broken", "does not compile", "code_quality", "info", r"(", "", "", [".xml"], True, {}),
    ("R07", "no pattern", "matches nothing", "code_quality", "info", "", "", "", [], True, {}),
]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE)


RULE_COLUMNS = (
    "file_id", "path", "check_id", "check_name", "category", "severity", "line_number", "message",
    "snippet", "suggestion", "rule_id", "rule", "match",
)


def rules_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(code_files(spark, sf_dir), rule_table(spark))
    return found.select(
        "*", F.coalesce(F.col("metadata")["rule"], F.lit("")).alias("rule"),
        F.coalesce(F.col("metadata")["match"], F.lit("")).alias("match"),
    ).select(*RULE_COLUMNS)


def _rule_sql() -> str:
    ctes, selects = [], []
    everything = [".py", ".js", ".java", ".xml", ".ts", ".md", ".yml", ".properties"]
    for rule_id, name, text, _, severity, pattern, hint, fix, suffixes, enabled, _ in RULES:
        if not enabled or not pattern or rule_id == "R06":
            continue
        letter = "Q" if r"\b" in pattern else ""
        source = plain(letter) if letter else "content"
        anchored = re2(f"^(?:{pattern})")
        ctes.append(match_cte(rule_id, pattern, suffixes or everything, text=source,
                              extra=f", regexp_extract(part, {anchored}) AS hit"))
        parts = [hint] if hint else []
        if fix:
            parts.append(FIX_EXAMPLE.replace("{template}", fix))
        base = "\n".join(parts)
        suggestion = q(base or DEFAULT_SUGGESTION)
        if rule_id.startswith("CUSTOM"):
            lead = base + "\n" if base else ""
            suggestion = (
                f"CASE WHEN contains(lower(hit), 'print') THEN {q(lead + PRINT_HINT)} WHEN contains(hit, 'TODO') "
                f"OR contains(hit, 'FIXME') THEN {q(lead + TODO_HINT)} ELSE {suggestion} END"
            )
        selects.append(
            f"SELECT file_id, path, {q(rule_id)} AS check_id, {q(name)} AS check_name, 'professional' AS category, "
            f"{q(severity)} AS severity, CAST(n AS INTEGER) AS line_number, {q(text + ' (行 ')} || CAST(n AS BIGINT) || ')' AS message, "
            f"line AS snippet, {suggestion} AS suggestion, {q(rule_id)} AS rule_id, {q(rule_id)} AS rule, hit AS match "
            f"FROM {rule_id} JOIN lines USING (file_id, path, ext, n)"
        )
    problem = rule_source.pattern_problem("(")
    message = BAD_RULE_MESSAGE.replace("{rule_id}", "R06").replace("{error}", problem)
    selects.append(
        f"SELECT file_id, path, 'R06', {q(BAD_RULE_NAME.replace('{name}', 'broken'))}, 'professional', 'medium', 0, "
        f"{q(message)}, '', {q(BAD_RULE_SUGGESTION)}, '', '', '' FROM code_files WHERE ext = '.xml'"
    )
    return f"WITH {', '.join([CODE_FILES, LINES, *ctes])} {' UNION ALL '.join(selects)}"


def rules_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per rule. Files are counted per suffix first, so the join sees a few rows."""
    suffixes = code_files(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"))
    rules = rule_table(spark)
    everywhere = rules.where(F.size("file_extensions") == 0).select("rule_id")
    limited = rules.select("rule_id", F.explode("file_extensions").alias("ext"))
    total = suffixes.agg(F.sum("n").alias("total")).scalar()
    some = limited.join(suffixes, "ext", "left").groupBy("rule_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files")
    )
    return some.unionByName(everywhere.withColumn("files", total))


def _rules_by_extension_sql() -> str:
    rows = ", ".join(
        f"({q(r[0])}, [{', '.join(q(s) for s in r[8])}]::VARCHAR[])" for r in RULES
    )
    return (
        f"WITH {CODE_FILES}, rules(rule_id, exts) AS (VALUES {rows}) "
        "SELECT rule_id, CAST(count(ext) AS BIGINT) AS files FROM rules LEFT JOIN code_files "
        "ON len(exts) = 0 OR list_contains(exts, ext) GROUP BY rule_id"
    )


def rules_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every suffix and category, with the files they see."""
    rules = rule_table(spark)
    counts = code_files(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"))
    found = [
        rule_source.by_category(rule_source.by_extension(rules, ext), category)
        .select("rule_id", "category", F.lit(ext).alias("ext"))
        for ext in (".py", ".js", ".java", ".xml", ".ts") for category in ("security", "code_quality")
    ]
    return reduce(DataFrame.unionByName, found).join(counts, "ext").select("rule_id", "category", "ext", "n")


def _rules_lookup_sql() -> str:
    rows = ", ".join(f"({q(r[0])}, {q(r[3])}, [{', '.join(q(s) for s in r[8])}]::VARCHAR[])" for r in RULES)
    return (
        f"WITH {CODE_FILES}, rules(rule_id, category, exts) AS (VALUES {rows}) "
        "SELECT rule_id, category, ext, count(*) AS n FROM rules JOIN code_files ON len(exts) = 0 OR list_contains(exts, ext) "
        "WHERE ext IN ('.py', '.js', '.java', '.xml', '.ts') AND category IN ('security', 'code_quality') GROUP BY ALL"
    )


def rules_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file per document, as a list, an object or one rule, parsed with all defaults."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rule = ("named_struct('id', concat('R', doc_id), 'pattern', text, 'severity', CASE doc_id % 3 WHEN 0 THEN 'HIGH' "
            "WHEN 1 THEN 'odd' END, 'category', IF(doc_id % 2 = 0, 'security', NULL), 'file_extensions', "
            "IF(doc_id % 5 = 0, array('.py', '.js'), NULL), 'enabled', doc_id % 4 <> 0)")
    value = (f"CASE doc_id % 3 WHEN 0 THEN to_json(array({rule})) WHEN 1 THEN to_json(named_struct('rules', array({rule}))) "
             f"ELSE to_json({rule}) END")
    parsed = rule_source.parse_rules(docs.selectExpr(f"{value} AS value"))
    return parsed.select("rule_id", "name", "category", "severity", "pattern", F.array_join("file_extensions", ",").alias("suffixes"), "enabled")


PARSED_SQL = """SELECT 'R' || doc_id AS rule_id, 'R' || doc_id AS name,
  CASE WHEN doc_id % 2 = 0 THEN 'security' ELSE 'code_quality' END AS category,
  CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, coalesce(text, '') AS pattern,
  CASE WHEN doc_id % 5 = 0 THEN '.py,.js' ELSE '' END AS suffixes, doc_id % 4 <> 0 AS enabled FROM documents"""


def rules_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule document per text: gone, locked, broken, with a rule that has no id, or whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rule = "named_struct('id', concat('R', doc_id), 'pattern', text)"
    nameless = "named_struct('name', 'n', 'pattern', text)"
    documents = docs.selectExpr(
        "concat('rules/', doc_id, '.json') AS path",
        f"CASE doc_id % 6 WHEN 2 THEN concat('{{', text) WHEN 3 THEN concat('[', to_json({rule}), ',', to_json({nameless}), ']') "
        f"WHEN 4 THEN to_json(named_struct('rules', array({rule}, {rule}))) WHEN 5 THEN to_json({rule}) END AS value",
        "CASE doc_id % 6 WHEN 0 THEN 'no such file or directory' WHEN 1 THEN 'permission denied' END AS error",
    )
    return rule_source.rule_statuses(documents)


STATUSES_SQL = """SELECT 'rules/' || doc_id || '.json' AS path,
  ['missing', 'unreadable', 'not_json', 'bad_rule', 'ok', 'ok'][doc_id % 6 + 1] AS status,
  CAST([0, 0, 0, 1, 2, 1][doc_id % 6 + 1] AS INT) AS rules, CAST([0, 0, 0, 1, 0, 0][doc_id % 6 + 1] AS INT) AS rejected
FROM documents"""


def analyzer_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files each analyzer reads, from the counts per suffix."""
    gates = audit_plan.analyzer_catalog(spark).select("analyzer", F.explode("suffixes").alias("ext"))
    counts = code_files(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"))
    return counts.join(gates, "ext").groupBy("analyzer").agg(F.sum("n").alias("files"))


HOOK = "function_words"


def _function_words(files: DataFrame) -> DataFrame:
    """Skill rows of a registered hook: scripts that say ``function``."""
    return files.where(F.col("content").contains("function")).select(
        "file_id", "path", F.lit(0).alias("seq"), F.lit("Functions").alias("name"), F.lit("script").alias("category"),
        F.lit("beginner").alias("level"), F.lit(0.5).alias("confidence"), F.array(F.lit("function")).alias("evidence"),
        F.lit("").alias("description"), F.lit("").alias("version_hint"),
    )


def skills_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of an audit in which a user's hook takes part, for its suffixes only, and its line of the catalog."""
    audit_plan.register_skills(HOOK, _function_words, (".js", ".ts"), title="Function words", category="professional")
    try:
        rows = audit_plan.Audit(code_files(spark, sf_dir), analyzers=[HOOK]).skills()
        shown = audit_plan.analyzer_catalog(spark).select(
            "analyzer", F.col("name").alias("analyzer_name"), F.array_join("suffixes", ",").alias("suffixes")
        )
        found = rows.select("file_id", "path", "name", "category", "level", "confidence", F.lit(HOOK).alias("analyzer"))
        return found.join(shown, "analyzer").drop("analyzer")
    finally:
        del audit_plan.EXTRA_SKILLS[HOOK]


HOOK_SQL = f"""WITH {CODE_FILES} SELECT file_id, path, 'Functions' AS name, 'script' AS category, 'beginner' AS level,
  CAST(0.5 AS DOUBLE) AS confidence, 'Function words' AS analyzer_name, '.js,.ts' AS suffixes
FROM code_files WHERE contains(content, 'function') AND (ends_with(path, '.js') OR ends_with(path, '.ts'))"""


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the labelled documents, named by path."""
    files = code_files(spark, sf_dir)
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("file_id")
    )
    paths = files.select("file_id", "path").join(labelled, "file_id", "left_semi")
    return file_source.only_paths(files, paths).select("file_id", "path", "ext")


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    scripts = file_source.supported(files, (".py", ".js"))
    some = file_source.outside_directories(files, "src", ("m4", "m5", "m6"))
    return file_source.union_files(scripts, some).select("file_id", "path", "ext")


def source_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with stray bytes around, Windows line ends and a genuine U+FFFD comes out clean."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.expr("concat(X'FF', CAST(replace(text, '\\n', '\\r\\n') AS BINARY), X'EFBFBDC3')").alias("raw"),
    )
    text = file_source.universal_newlines(file_source.decode(F.col("raw")))
    return raw.select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("n_chars"))


def naming_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct defined names and the conventions they follow."""
    names = code_files(spark, sf_dir).select(
        F.explode(extract(F.col("content"), r"(?:def|class|interface)\s+(\w+)", 1)).alias("name")
    ).distinct()
    return names.select("name", *[naming_style(F.col("name"), c).alias(c.lower()) for c in NAMING])


CONTEXT_CHECKS = [c for c in FIXES]


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import PROBES

    found = findings_with_context(code_files(spark, sf_dir), [PROBES[c] for c in CONTEXT_CHECKS])
    return found.select(
        "file_id", "path", "check_id", "line_number", "message", "context", "fix"
    )


def _context_sql() -> str:
    ctes, union = union_ctes(CONTEXT_CHECKS)
    cases = " ".join(
        f"WHEN check_id = {q(c)} THEN " + " || context || ".join(
            q(part) for part in FIX_LAYOUT.replace("{template}", template).replace("{why}", why).split("{context}"))
        for c, (template, why) in FIXES.items()
    )
    return (
        f"WITH {', '.join(ctes)}, f AS (SELECT *, row_number() OVER () AS rid FROM ({union})), "
        "w AS (SELECT f.rid, string_agg(CASE WHEN l.n = f.line_number THEN '>>> ' ELSE '    ' END || l.line, chr(10) "
        "ORDER BY l.n) AS context FROM f JOIN lines l ON l.file_id = f.file_id AND l.n BETWEEN f.line_number - 2 "
        "AND f.line_number + 2 GROUP BY f.rid) "
        f"SELECT file_id, path, check_id, line_number, message, context, CASE {cases} END AS fix FROM f JOIN w USING (rid)"
    )


GRADED = ["QUAL001", "BP001", "BP003", "BP017", "SEC012", "QUAL006"]


def file_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, grade and band of every file on its own, from the findings of a few checks."""
    from .registry import PROBES

    files = code_files(spark, sf_dir)
    lost = run_probes(files, [PROBES[c] for c in GRADED]).groupBy("file_id").agg(
        F.sum(scoring.penalty(F.col("severity"))).alias("lost")
    )
    rated = files.select("file_id", "path").join(lost, "file_id", "left").withColumn(
        "score", scoring.score(F.coalesce("lost", F.lit(0)), F.lit(1))
    )
    return rated.select("file_id", "path", "score", scoring.grade(F.col("score")).alias("grade"),
                        scoring.band(F.col("score")).alias("band"))


def _grades_sql() -> str:
    ctes, union = union_ctes(GRADED)
    return f"""WITH {', '.join(ctes)}, f AS ({union}),
lost AS (SELECT file_id, {PENALTY_SUM} AS lost FROM f GROUP BY file_id),
rated AS (SELECT c.file_id, c.path, CAST(greatest(0, least(100, 100 - coalesce(lost, 0))) AS DOUBLE) AS score
          FROM code_files c LEFT JOIN lost USING (file_id))
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END
  AS grade, CASE WHEN score >= 90 THEN 'green' WHEN score >= 70 THEN 'yellow' WHEN score >= 50 THEN 'orange' ELSE 'red' END AS band
FROM rated"""


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as nested JSON documents."""
    from .registry import PROBES

    found = run_probes(code_files(spark, sf_dir), [PROBES["SEC012"], PROBES["BP003"]])
    return as_json(nested_findings(found))


def _report_sql() -> str:
    ctes, union = union_ctes(["SEC012", "BP003"])
    return (
        f"WITH {', '.join(ctes)} SELECT CAST(to_json(struct_pack(check_id := check_id, check_name := check_name, "
        "category := category, severity := severity, message := message, location := struct_pack(file_path := path, "
        "line_number := line_number, column_number := 0, snippet := snippet), suggestion := suggestion, "
        f"rule_id := rule_id, metadata := MAP {{}}::MAP(VARCHAR, VARCHAR))) AS VARCHAR) AS value FROM ({union})"
    )


def documents_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines of the plain documents per severity."""
    from .registry import PROBES

    found = run_probes(document_files(spark, sf_dir), [PROBES["QUAL001"]])
    return found.groupBy("severity").agg(F.count("*").alias("issues"), F.max("line_number").alias("last_line"))


def pages_markup_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script and markup checks over the raw pages."""
    from .registry import PROBES

    ids = ("BP016", "BP017", "QUAL001", "QUAL005", "SEC019", "PERF003")
    found = run_probes(page_files(spark, sf_dir), [PROBES[c] for c in ids])
    return found.groupBy("check_id", "severity").agg(
        F.count("*").alias("issues"), F.sum("line_number").alias("line_sum")
    )


def _pages_sql() -> str:
    corpus = (
        "code_files AS (SELECT CAST(page_id AS VARCHAR) AS file_id, 'pages/p' || page_id || '.js' AS path, "
        "'.js' AS ext, html AS content FROM pages)"
    )
    selects = []
    for check_id in ("BP016", "BP017", "QUAL001", "QUAL005", "SEC019", "PERF003"):
        ctes, select = CHECK_PARTS[check_id]
        selects.append(f"SELECT * FROM (WITH {', '.join(ctes)} {select})" if ctes else select)
    return (
        f"WITH {corpus}, {LINES} SELECT check_id, severity, count(*) AS issues, CAST(sum(line_number) AS BIGINT) AS line_sum "
        f"FROM ({' UNION ALL '.join(selects)}) GROUP BY check_id, severity"
    )


def _language_sql() -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in file_source.LANGUAGE_OF.items())
    return (
        f"WITH {CODE_FILES} SELECT CASE lower(string_split(path, '.')[-1]) {cases} ELSE 'unknown' END AS language, "
        "count(*) AS files FROM code_files GROUP BY 1"
    )


def _by(files: DataFrame, *columns) -> DataFrame:
    return files.groupBy(*columns).agg(F.count("*").alias("files"))


LINE_SQL = f"""WITH {CODE_FILES}, {LINES} SELECT file_id, path, ext, CAST(n AS INT) AS line_number, line, t AS stripped,
CAST(length(line) - length(regexp_replace(line, '^[{SPACE}]+', '')) AS INT) AS indent FROM lines"""
SUPPORTED = suffix_test(file_source.SCAN_SUFFIXES)

# Rules in the dialect that users write, and the same patterns spelled plainly.
DIALECT = {
    "D1": (r"(?i)TODO", "[Tt][Oo][Dd][Oo]"), "D2": (r"\x65val", "eval"), "D3": ("(?x) var \\s+ total # a name", r"var\s+total"),
    "D4": (r"[[]a", r"\[a"), "D5": (r"er{,2}or", "er{0,2}or"), "D6": (r"(?P<a_b>db)(?#note)\.query", r"db\.query"),
    "D7": (r"\Aimport", "^import"), "D8": (r"[.]\Z", r"\.$"), "D9": (r"(?P<c_d>o)(?P<cd>m)(?!a)", "om([^a]|$)"),
}


def rules_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, i, "", "code_quality", "low", user, "", "", [], True, {}) for i, (user, _) in DIALECT.items()]
    found = apply_rules(code_files(spark, sf_dir), spark.createDataFrame(rows, RULE))
    return found.select("file_id", "path", "check_id", "line_number", F.length(F.col("metadata")["match"]).alias("matched"))


def _dialect_sql() -> str:
    ctes, selects = [], []
    for rule_id, (_, pattern) in DIALECT.items():
        size = "2" if rule_id == "D9" else f"length(regexp_extract(part, {re2(f'^(?:{pattern})')}))"
        ctes.append(match_cte(rule_id, pattern, (".py", ".js", ".java", ".xml", ".ts", ".md", ".yml", ".properties"),
                              extra=f", {size} AS size"))
        selects.append(f"SELECT file_id, path, {q(rule_id)} AS check_id, CAST(n AS INTEGER) AS line_number, "
                       f"CAST(size AS INTEGER) AS matched FROM {rule_id}")
    return f"WITH {CODE_FILES}, {', '.join(ctes)} " + " UNION ALL ".join(selects)


def extension_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a registered analyzer as they come back per file."""
    def marks(files: DataFrame) -> DataFrame:
        fixed = {"check_id": "EXT1", "check_name": "mark", "category": "professional", "severity": "low",
                 "message": "open mark", "snippet": "", "suggestion": "", "rule_id": ""}
        return files.where(F.col("content").contains("TODO")).select(
            "file_id", "path", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(0).alias("line_number"),
            F.expr("CAST(map() AS MAP<STRING, STRING>)").alias("metadata"),
            F.expr("CAST(array() AS ARRAY<STRING>)").alias("tags"), F.lit(3).alias("severity_rank"),
        )

    audit_plan.register_findings("marks", marks, suffixes=(".js", ".md"))
    try:
        rows = audit_plan.Audit(code_files(spark, sf_dir), analyzers="marks").findings_by_file()
    finally:
        audit_plan.EXTRA_FINDINGS.pop("marks")
    return rows.select("path", F.explode("findings").alias("f")).select("path", "f.check_id", "f.severity", "f.message")


REGISTERED = {
    "source_lines": (lambda s, d: file_source.explode_lines(code_files(s, d)), LINE_SQL),
    "source_supported": (
        lambda s, d: _by(file_source.supported(code_files(s, d)), "ext"),
        f"WITH {CODE_FILES} SELECT ext, count(*) AS files FROM code_files WHERE {SUPPORTED} GROUP BY ext"),
    "source_outside_directories": (
        lambda s, d: file_source.outside_directories(code_files(s, d), "src", ("m3", "m5")).select("file_id", "path"),
        f"WITH {CODE_FILES} SELECT file_id, path FROM code_files WHERE NOT starts_with(path, 'src/m3/') "
        "AND NOT starts_with(path, 'src/m5/')"),
    "source_paths": (
        source_paths,
        f"WITH {CODE_FILES} SELECT file_id, path, ext FROM code_files WHERE file_id IN "
        "(SELECT CAST(doc_id AS VARCHAR) FROM labels)"),
    "source_union": (
        source_union,
        f"WITH {CODE_FILES} SELECT file_id, path, ext FROM code_files WHERE ext IN ('.py', '.js') "
        "OR NOT regexp_matches(path, '^src/m[456]/')"),
    "source_decode": (
        source_decode,
        "SELECT doc_id, md5(text || chr(65533)) AS digest, CAST(length(text) + 1 AS INT) AS n_chars FROM documents"),
    "language_of_path": (
        lambda s, d: _by(code_files(s, d).select(file_source.language(F.col("path")).alias("language")), "language"),
        _language_sql()),
    "analyzer_gating": (
        analyzer_gating,
        f"WITH {CODE_FILES} " + " UNION ALL ".join(
            f"SELECT {q(name)} AS analyzer, count(*) AS files FROM code_files WHERE {suffix_test(suffixes)}"
            for name, suffixes in SUFFIXES.items())),
    "naming_styles": (
        naming_styles,
        f"WITH {CODE_FILES}, n AS (SELECT DISTINCT unnest(regexp_extract_all(content, "
        f"{re2(r'(?:def|class|interface)' + chr(92) + 's+(' + chr(92) + 'w+)')}, 1)) AS name FROM code_files) SELECT name, "
        + ", ".join(f"regexp_matches(name, {q(p)}) AS {c.lower()}" for c, p in NAMING.items()) + " FROM n"),
    "rules_custom": (rules_custom, _rule_sql()),
    "rules_lookup": (rules_lookup, _rules_lookup_sql()),
    "rules_parsed": (rules_parsed, PARSED_SQL),
    "rules_statuses": (rules_statuses, STATUSES_SQL),
    "skills_hook": (skills_hook, HOOK_SQL),
    "file_grades": (file_grades, _grades_sql()),
    "rules_dialect": (rules_dialect, _dialect_sql()),
    "extension_findings": (
        extension_findings,
        f"WITH {CODE_FILES} SELECT path, 'EXT1' AS check_id, 'low' AS severity, 'open mark' AS message FROM code_files "
        "WHERE contains(content, 'TODO') AND ext IN ('.js', '.md')"),
    "rules_by_extension": (rules_by_extension, _rules_by_extension_sql()),
    "context_window": (context_window, _context_sql()),
    "report_json": (report_json, _report_sql()),
    "documents_line_length": (
        documents_line_length,
        f"WITH code_files AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, 'docs/d' || doc_id || '.py' AS path, '.py' AS ext, "
        f"text AS content FROM documents), {LINES} SELECT severity, count(*) AS issues, max(line_number) AS last_line "
        f"FROM ({CHECK_PARTS['QUAL001'][1]}) GROUP BY severity"),
    "pages_markup_checks": (pages_markup_checks, _pages_sql()),
}
