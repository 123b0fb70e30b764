"""User rules: they become part of the pass over the files, with no join.

The parse tree of a pattern proves literals of which every match holds one. Up to ``RULES_PER_PASS`` rules are expressions
of the plan, each behind a search for its literals. Beyond that one automaton over the literals of all rules reads every
file once and names the rules to try; their patterns are looked up in a constant table, so neither the plan nor the time
of a file grows with rules that cannot match it. Rules without such literals stay expressions of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.literals import needed_literals, occurring
from ..functions.text import bind, matches_of, with_lines
from ..functions.user_patterns import user_regex
from ..packs.catalog import Check
from ..packs.probes import Pattern
from ..sources import rules as rule_source
from ..sources.rules import active_rules, engine_problems, pattern_problem
from ..schemas import FINDING
from .probe import (
    FINDING_COLUMNS, Probe, all_hits, catalog_array, each_match, flatten_findings, hit, no_hits, pattern_gate,
)

# Texts of rule findings.
BAD_RULE_NAME = "规则配置错误: {name}"
BAD_RULE_MESSAGE = "规则 '{rule_id}' 的正则表达式无效: {error}"
BAD_RULE_SUGGESTION = "检查规则的正则表达式语法"
FIX_EXAMPLE = "\n修复示例:\n```\n{template}\n```"
PRINT_HINT = (
    "\n推荐使用:\n```python\nimport logging\nlogger = logging.getLogger(__name__)\n"
    "logger.info('message')  # 替代 print\n```"
)
TODO_HINT = (
    "\n处理建议:\n1. 完成待办任务\n2. 如果暂时不需要，删除该标记\n3. 添加任务跟踪系统的链接"
)
DEFAULT_SUGGESTION = "请根据项目规范修复此问题"
SEPARATOR = "\x01"


def _check(rule: Row, problem: str | None) -> Check:
    """Catalog entry of a rule; the category of a rule finding is fixed."""
    if problem is not None:
        return Check(rule.rule_id, "professional", "medium", "",
                     BAD_RULE_NAME.replace("{name}", rule.name),
                     BAD_RULE_MESSAGE.replace("{rule_id}", rule.rule_id).replace("{error}", problem),
                     BAD_RULE_SUGGESTION)
    parts = [rule.suggestion] if rule.suggestion else []
    if rule.fix_template:
        parts.append(FIX_EXAMPLE.replace("{template}", rule.fix_template))
    return Check(rule.rule_id, "professional", rule.severity, rule.rule_id, rule.name,
                 rule.description + " (行 {line})", "\n".join(parts))


def _probe(ordinal: int, rule: Row, problem: str | None) -> Probe:
    suffixes = tuple(rule.file_extensions or ())
    if problem is not None:
        return Probe(rule.rule_id, "custom", lambda: F.lit(True),
                     lambda: F.array(hit(ordinal)), suffixes)
    literals = needed_literals(rule.pattern)
    pattern = Pattern(user_regex(rule.pattern), folded=literals if all(map(str.isascii, literals)) else ())
    return Probe(rule.rule_id, "custom", pattern_gate([pattern]),
                 lambda: each_match(ordinal, pattern, (0,), what="m.g0"), suffixes, True)


def judged_rules(spark: SparkSession, rules: DataFrame) -> list[tuple[Row, str | None]]:
    """Active rules with what is wrong with their patterns."""
    active = [rule for page in active_rules(rules) for rule in page]
    problems = {p: pattern_problem(p) for p in {rule.pattern for rule in active}}
    refused = engine_problems(spark, [p for p, problem in problems.items() if problem is None])
    return [(rule, problems[rule.pattern] or refused.get(rule.pattern)) for rule in active]


def _constants(values: list[str]) -> Column:
    """A constant array of texts, however long, that is one short expression to the planner."""
    return F.split(F.lit(SEPARATOR.join(values)), SEPARATOR, -1)


def _looked_up(rules: list[Row]) -> Column:
    """array<finding> of rules that all need a literal: only those whose literal occurs are tried."""
    tried = occurring(F.col("content"), [needed_literals(rule.pattern) for rule in rules])
    regexes = _constants([str(user_regex(rule.pattern)) for rule in rules])
    suffixes = _constants(["/".join(rule.file_extensions or ()) for rule in rules])
    checks = [_check(rule, None)._asdict() for rule in rules]
    entries = {name: _constants([check[name].replace(SEPARATOR, " ") for check in checks]) for name in checks[0]}

    def hits(number: Column) -> Column:
        wanted = F.get(suffixes, number)
        return bind(F.get(regexes, number), lambda regex: F.when(
            ((wanted == "") | F.array_contains(F.split(wanted, "/"), F.col("ext"))) & F.regexp_like("content", regex),
            F.transform(matches_of(regex), lambda m: hit(
                number, m["n"], F.coalesce(F.try_element_at("lines", m["n"]), F.lit("")), m["g0"]
            )),
        ).otherwise(no_hits()))

    found = F.flatten(F.transform(tried, hits))
    return F.transform(found, lambda h: _rule_finding(
        h, F.struct(*[F.get(texts, h["check"]).alias(name) for name, texts in entries.items()])
    ))


def _rule_finding(h: Column, entry: Column) -> Column:
    """Rule texts may contain anything, so only the line number is filled in; the match
    goes to the metadata and decides which hint follows the suggestion."""
    real = entry["rule_id"] != ""
    custom = real & entry["check_id"].startswith("CUSTOM")
    match = h["what"]
    hint = F.when(custom & F.lower(match).contains("print"), F.lit(PRINT_HINT)).when(
        custom & (match.contains("TODO") | match.contains("FIXME")), F.lit(TODO_HINT)
    )
    text = F.concat_ws("\n", F.nullif(entry["suggestion"], F.lit("")), hint)
    values = {
        "check_id": entry["check_id"], "check_name": entry["name"], "category": entry["category"],
        "severity": entry["severity"],
        "message": F.replace(entry["message"], F.lit("{line}"), h["line_number"].cast("string")),
        "line_number": h["line_number"], "snippet": h["snippet"],
        "suggestion": F.when(text == "", F.lit(DEFAULT_SUGGESTION)).otherwise(text),
        "rule_id": entry["rule_id"],
        "metadata": F.when(
            real, F.create_map(F.lit("rule"), entry["rule_id"], F.lit("match"), match)
        ).otherwise(F.expr("CAST(map() AS MAP<STRING, STRING>)")),
        "tags": F.expr("CAST(array() AS ARRAY<STRING>)"),
    }
    return F.struct(*[values[name].alias(name) for name in FINDING_COLUMNS]).cast(FINDING)


def rule_findings(spark: SparkSession, rules: DataFrame | None) -> Column:
    """array<finding> of all active rules over the columns of one file row; rules with a
    bad pattern say so once per file."""
    nothing = F.expr(f"CAST(array() AS ARRAY<{FINDING}>)")
    if rules is None:
        return nothing
    judged = judged_rules(spark, rules)
    many = len(judged) > rule_source.RULES_PER_PASS
    looked_up = [rule for rule, problem in judged if many and problem is None and needed_literals(rule.pattern)]
    chosen = {id(rule) for rule in looked_up}
    others = [(rule, problem) for rule, problem in judged if id(rule) not in chosen]
    parts = [nothing]
    for start in range(0, len(others), rule_source.RULES_PER_PASS):
        page = others[start : start + rule_source.RULES_PER_PASS]
        parts.append(_page(
            [_probe(i, rule, problem) for i, (rule, problem) in enumerate(page)],
            [_check(rule, problem) for rule, problem in page],
        ))
    if looked_up:
        parts.append(_looked_up(looked_up))
    return F.concat(*parts) if len(parts) > 1 else nothing


def _page(probes: list[Probe], checks: list[Check]) -> Column:
    return bind(
        catalog_array(checks),
        lambda entries: F.transform(
            all_hits(probes), lambda h: _rule_finding(h, F.get(entries, h["check"]))
        ),
    )


def apply_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of all active rules, one row each."""
    found = rule_findings(files.sparkSession, rules)
    return flatten_findings(with_lines(files).select("file_id", "path", found.alias("findings")))
