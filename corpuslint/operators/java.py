"""Java and Maven skills, structure and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import extract, java_regex, sql_any, sql_matches, sql_text
from ..functions.text import bind, contains_any
from ..packs import java as pack
from ..packs.catalog import JAVA
from ..packs.probes import Pattern
from .probe import Probe, content, hit, pattern_gate, whole_file
from .skills import explode_skills, no_skills, skill_sql, tenths

CHECKS = {check.check_id: check for check in JAVA}


def is_pom(path: Column) -> Column:
    return path.endswith(".xml") & path.contains("pom.xml")


def sql_extract(pattern: str, group: int) -> str:
    return f"regexp_extract_all(content, {sql_text(java_regex(pattern))}, {group})"


def feature(pattern: str) -> str:
    """SQL: plain features are byte searches, the rest are regexes."""
    return sql_matches("content", pattern)


def skill_category(name: str) -> str:
    """Category of a skill; decided when the plan is built, as the names are fixed."""
    return next((c for key, c in pack.CATEGORIES.items() if key in name), pack.OTHER_CATEGORY)


def pack_scores(skills: dict = pack.SKILLS) -> str:
    """SQL: array<struct<name, category, level, score, evidence>>, every skill of a pack
    with its score in tenths. Imports are extracted once and tested against plain probes."""

    def one(name: str, level: str, patterns: list) -> str:
        hits = ", ".join(
            f"IF({feature(p)}, named_struct('p', {sql_text(p)}, 'w', {tenths(w)}), NULL)"
            for p, w in patterns
        )
        probes = sql_any("i", [pack.import_probe(p) for p, _ in patterns])
        return (
            f"transform(array(array_compact(array({hits}))), found -> named_struct("
            f"'name', {sql_text(name)}, 'category', {sql_text(skill_category(name))}, "
            f"'level', {sql_text(level)}, "
            f"'score', aggregate(found, 0, (acc, h) -> acc + h.w) "
            f"+ {tenths(pack.IMPORT_BONUS)} * size(filter(imports, i -> {probes})), "
            f"'evidence', slice(transform(found, h -> h.p), 1, 3)))[0]"
        )

    rows = ", ".join(one(name, level, patterns) for name, (level, patterns) in skills.items())
    return f"transform(array({sql_extract(pack.IMPORT, 1)}), imports -> array({rows}))[0]"


def source_skills() -> str:
    """SQL: pack skills of a Java source whose score reaches the threshold."""
    one = skill_sql("s.name", "s.category", "s.level", "least(s.score / 20.0D, 1.0D)", "s.evidence")
    limit = tenths(pack.SKILL_THRESHOLD)
    return f"transform(filter({pack_scores()}, s -> s.score >= {limit}), s -> {one})"


def annotation_skills() -> str:
    """SQL: one skill per use of a known annotation."""
    known = pack.ANNOTATION_SKILLS
    names = ", ".join(sql_text(name) for name in known)
    skill = "CASE a " + " ".join(
        f"WHEN {sql_text(name)} THEN {sql_text(skill)}" for name, skill in known.items()
    ) + " END"
    one = skill_sql(skill, "'框架组件'", "'intermediate'", "0.7", "array(concat('@', a, '注解'))")
    uses = f"filter({sql_extract(pack.STRUCTURE['annotations'], 1)}, a -> a IN ({names}))"
    return f"transform({uses}, a -> {one})"


def dependency_array() -> str:
    """SQL: array<struct<group_id, artifact_id>> of a pom text."""
    return (
        f"zip_with({sql_extract(pack.DEPENDENCY, 1)}, {sql_extract(pack.DEPENDENCY, 2)}, "
        "(g, a) -> named_struct('group_id', g, 'artifact_id', a))"
    )


def dependency_skills() -> str:
    cases = ", ".join(
        f"IF(contains(concat(d.group_id, ':', d.artifact_id), {sql_text(key)}), " + skill_sql(
            sql_text(name), "'Maven依赖'", "'intermediate'", "0.8",
            "array(concat('Maven依赖: ', d.artifact_id))") + ", NULL)"
        for key, name in pack.DEPENDENCY_SKILLS.items()
    )
    return f"flatten(transform({dependency_array()}, d -> array_compact(array({cases}))))"


def _fixed_skill(name, category, level, confidence, evidence) -> str:
    return skill_sql(sql_text(name), sql_text(category), sql_text(level), str(confidence),
                     f"array({sql_text(evidence)})")


def word_skills(table, column: str = "content") -> str:
    cases = ", ".join(
        f"IF({sql_any(column, words)}, {_fixed_skill(*rest)}, NULL)" for words, *rest in table
    )
    return f"array_compact(array({cases}))"


def plugin_skills() -> str:
    table = [((word,), *rest) for word, *rest in pack.POM_PLUGINS]
    return f"flatten(transform({sql_extract(pack.PLUGIN, 1)}, p -> {word_skills(table, 'p')}))"


def java_skill_array() -> Column:
    """Skills of one file, by what kind of file it is."""
    return F.expr(
        "CASE WHEN endswith(path, '.xml') AND contains(path, 'pom.xml') "
        f"THEN concat({dependency_skills()}, {plugin_skills()}, {word_skills(pack.POM_WORDS)}) "
        f"WHEN endswith(path, '.java') THEN concat({source_skills()}, {annotation_skills()}) "
        f"WHEN endswith(path, '.properties') THEN {word_skills(pack.PROPERTY_WORDS)} "
        "WHEN endswith(path, '.yml') OR endswith(path, '.yaml') "
        f"THEN {word_skills(pack.YAML_WORDS)} ELSE {no_skills()} END"
    )


def java_files(files: DataFrame) -> DataFrame:
    return files.where(
        F.col("ext").isin(".java", ".properties", ".yml", ".yaml") | is_pom(F.col("path"))
    )


def java_skill_rows(files: DataFrame) -> DataFrame:
    return explode_skills(
        java_files(files).select("file_id", "path", java_skill_array().alias("skills"))
    )


def maven_dependencies(files: DataFrame) -> DataFrame:
    """``file_id, path, ordinal, group_id, artifact_id``."""
    return files.where(is_pom(F.col("path"))).select(
        "file_id", "path", F.posexplode(F.expr(dependency_array())).alias("ordinal", "d")
    ).select("file_id", "path", "ordinal", "d.*")


def java_structure(files: DataFrame) -> DataFrame:
    """Package, imports, types, methods and annotations of every Java source."""
    return files.where(F.col("path").endswith(".java")).select(
        "file_id", "path",
        F.regexp_extract(content(), java_regex(pack.PACKAGE), 1).alias("package"),
        extract(content(), pack.IMPORT, 1).alias("imports"),
        *[extract(content(), regex, 1).alias(name) for name, regex in pack.STRUCTURE.items()],
    )


def java_scores(files: DataFrame, skills: dict = pack.SKILLS) -> DataFrame:
    """Every skill of a pack with a positive score, per Java source."""
    return (
        files.where(F.col("path").endswith(".java"))
        .select("file_id", "path", F.explode_outer(F.expr(pack_scores(skills))).alias("s"))
        .select("file_id", "path", "s.*")
        .where(F.col("score") > 0)
    )


def practice_scores(files: DataFrame) -> DataFrame:
    """The optional practice pack over Java sources."""
    return java_scores(files, pack.PRACTICES).drop("category")


def probes() -> list[Probe]:
    java = (".java",)

    def pom_rows() -> Column:
        names = F.expr(
            f"transform({dependency_array()}, d -> concat(d.group_id, ':', d.artifact_id))"
        )
        return bind(names, lambda deps: F.array(hit(CHECKS["JAVA001"], count=F.size(deps), tags=deps)))

    def package_rows() -> Column:
        name = F.regexp_extract(content(), java_regex(pack.PACKAGE), 1)
        classes = extract(content(), pack.STRUCTURE["classes"], 1)
        return F.array(hit(CHECKS["JAVA010"], what=name, tags=classes))

    def gate(regex, needles):
        return pattern_gate([Pattern(regex, needles=needles)])

    return [
        Probe("JAVA001", "java", lambda: is_pom(F.col("path")), pom_rows, (".xml",)),
        Probe("JAVA010", "java", gate(pack.PACKAGE, ("package",)), package_rows, java),
        whole_file(CHECKS["JAVA020"], "java", gate(pack.SYNCHRONIZED, ("synchronized",)), java),
        whole_file(CHECKS["JAVA021"], "java", lambda: content().contains(".stream()"), java),
        whole_file(CHECKS["JAVA022"], "java", lambda: content().contains("Optional<"), java),
        whole_file(CHECKS["JAVA023"], "java", gate(pack.CATCH_EXCEPTION, ("catch",)), java),
        whole_file(CHECKS["JAVA024"], "java",
                   lambda: contains_any(content(), pack.LOMBOK.split("|")), java),
    ]
