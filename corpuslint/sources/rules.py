"""Rule tables: user rules from JSON files or from any table with the same columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions.user_patterns import Unsupported, user_regex
from ..schemas import CATEGORIES, RULE, SEVERITIES
from .files import decode
from .raw import raw_files

RULES_PER_PASS = 200
_TEXT_FIELDS = (
    "rule_id", "id", "name", "description", "category", "severity", "pattern", "suggestion",
    "fix_template", "file_extensions", "enabled", "metadata",
)


def _rule_texts(document: Column) -> Column:
    """A list, an object with ``rules`` or one rule: always an array of JSON texts."""
    listed = F.from_json(document, "ARRAY<STRING>")
    inner = F.get_json_object(document, "$.rules")
    return (
        F.when(F.ltrim(document).startswith("["), listed)
        .when(inner.isNotNull(), F.from_json(inner, "ARRAY<STRING>"))
        .otherwise(F.array(document))
    )


def parse_rules(documents: DataFrame, text: str = "value") -> DataFrame:
    """Rules of JSON documents, one row each, with every default filled in."""
    schema = ", ".join(f"{name} STRING" for name in _TEXT_FIELDS)
    rows = documents.select(F.explode_outer(_rule_texts(F.col(text))).alias("item"))
    r = rows.select(F.from_json("item", schema).alias("r")).select("r.*")

    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default)

    rule_id = F.coalesce(F.nullif("rule_id", F.lit("")), F.nullif("id", F.lit("")))
    severity = F.lower(filled("severity", F.lit("medium")))
    category = filled("category", F.lit("code_quality"))
    suffixes = (
        F.when(F.col("file_extensions").isNull(), F.array().cast("ARRAY<STRING>"))
        .when(F.col("file_extensions").startswith("["), F.from_json("file_extensions", "ARRAY<STRING>"))
        .otherwise(F.array("file_extensions"))
    )
    return r.where(rule_id.isNotNull()).select(
        rule_id.alias("rule_id"),
        filled("name", rule_id).alias("name"),
        filled("description", F.lit("")).alias("description"),
        F.when(category.isin(*CATEGORIES), category).otherwise("code_quality").alias("category"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"),
        filled("pattern", F.lit("")).alias("pattern"),
        filled("suggestion", F.lit("")).alias("suggestion"),
        filled("fix_template", F.lit("")).alias("fix_template"),
        suffixes.alias("file_extensions"),
        (F.lower(filled("enabled", F.lit("true"))) != "false").alias("enabled"),
        F.coalesce(F.from_json("metadata", "MAP<STRING, STRING>"),
                   F.create_map().cast("MAP<STRING, STRING>")).alias("metadata"),
    )


def _documents(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """``path, value, error`` of JSON files: explicit ones of any name, or those below directories."""
    raw = raw_files(spark, paths, recursive, (".json",), any_explicit=True)
    return raw.select("path", decode(F.col("content")).alias("value"), "error")


def _is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def _readable(documents: DataFrame) -> DataFrame:
    return parse_rules(documents.where(F.col("error").isNull() & _is_json(F.col("value"))))


def load_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """Rules of explicit JSON files; unreadable documents show up in ``rule_errors``."""
    return _readable(_documents(spark, list(paths)))


def load_rule_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Rules of all JSON files below a directory, or only of its top level."""
    return _readable(_documents(spark, [path], recursive))


def rule_statuses(documents: DataFrame) -> DataFrame:
    """``path, status, rules, rejected`` of rule documents (path, value, error), one row each.

    Status: ``missing`` or ``unreadable`` (nothing was read), ``not_json``, ``bad_rule`` (a rule without an id, which is
    left out while the others load) or ``ok``."""
    value, error = F.col("value"), F.col("error")
    items = F.coalesce(_rule_texts(value), F.array(F.lit(None).cast("string")))
    ids = F.transform(items, lambda item: F.coalesce(
        F.nullif(F.get_json_object(item, "$.rule_id"), F.lit("")), F.nullif(F.get_json_object(item, "$.id"), F.lit(""))
    ))
    read = error.isNull() & _is_json(value)
    rules = F.when(read, F.size(F.filter(ids, lambda i: i.isNotNull()))).otherwise(0)
    rejected = F.when(read, F.size(F.filter(ids, lambda i: i.isNull()))).otherwise(0)
    status = (
        F.when(error.startswith("no such file"), "missing").when(error.isNotNull(), "unreadable")
        .when(~read, "not_json").when(F.col("rejected") > 0, "bad_rule").otherwise("ok")
    )
    return documents.withColumns({"rules": rules, "rejected": rejected}).select("path", status.alias("status"), "rules", "rejected")


def rule_errors(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """``path, error`` for files that are missing, cannot be read or hold no JSON; of directories, their JSON files. Rules
    without an id are counted by ``rule_statuses``."""
    documents = _documents(spark, list(paths), recursive)
    found = documents.select("path", F.col("error").alias("why")).join(rule_statuses(documents), "path")
    text = (
        F.when(F.col("status") == "missing", F.concat(F.lit("规则文件不存在: "), "path"))
        .when(F.col("status") == "unreadable", F.concat(F.lit("加载规则文件出错: "), "why"))
        .otherwise(F.lit("加载规则文件出错: JSON"))
    )
    return found.where("status IN ('missing', 'unreadable', 'not_json')").select("path", text.alias("error"))


def by_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.col("category") == category)


def by_extension(rules: DataFrame, suffix: str | Column) -> DataFrame:
    """Rules for one suffix; a rule without suffixes is for every file."""
    wanted = F.lit(suffix) if isinstance(suffix, str) else suffix
    return rules.where(
        (F.size("file_extensions") == 0) | F.array_contains("file_extensions", wanted)
    )


def normalised(rules: DataFrame) -> DataFrame:
    """Any table with the rule columns, in the order and types of the schema."""
    columns = [part.strip().split(" ", 1) for part in re.split(r",\s*(?=\w+ [A-Z])", RULE)]
    return rules.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def active_rules(rules: DataFrame) -> Iterator[list[Row]]:
    """Enabled rules with a pattern, page by page. Rules are configuration that becomes
    part of the plan; a page bounds the size of one pass and no rule is left out."""
    page: list[Row] = []
    chosen = rules.where(F.col("enabled") & (F.col("pattern") != "")).orderBy("rule_id", "pattern")
    for row in chosen.toLocalIterator():
        page.append(row)
        if len(page) == RULES_PER_PASS:
            yield page
            page = []
    if page:
        yield page


def pattern_problem(pattern: str) -> str | None:
    """Why a user pattern does not compile, or None."""
    try:
        user_regex(pattern)
    except (re.error, Unsupported) as error:
        return str(error)
    return None


def engine_problems(spark: SparkSession, patterns: list[str]) -> dict[str, str]:
    """Patterns that the engine itself refuses, found by halving the list."""
    if not patterns:
        return {}
    try:
        rows = spark.createDataFrame([(str(user_regex(p)),) for p in patterns], "regex string")
        rows.select(F.regexp_like(F.lit(""), "regex")).collect()
        return {}
    except Exception as error:  # the refusal arrives as one of several error classes
        if len(patterns) == 1:
            return {patterns[0]: str(error).splitlines()[0]}
        half = len(patterns) // 2
        return {**engine_problems(spark, patterns[:half]), **engine_problems(spark, patterns[half:])}
