"""Skill recognition: which languages, frameworks, architectures and tools a file shows.

The packs become constant tests in one projection, so detection is a narrow pass: every
file turns into one row of name arrays, and skill rows and findings are read off it.
Packs are written as SQL text because they only test fixed words against two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import sql_any, sql_contains, sql_matches, sql_text
from ..packs import skills as pack
from ..packs.catalog import SKILL_FINDINGS
from ..packs.probes import SUFFIXES
from ..schemas import SKILL
from .probe import flatten_hits, hit, no_hits

TRAITS = ("languages", "frameworks", "architectures", "devops", "cloud")


def tenths(weight: float) -> int:
    return round(weight * 10)


def weighted(column: str, patterns: list[tuple[str, float]]) -> str:
    """SQL: sum of the weights of the matching patterns, in tenths."""
    return " + ".join(
        f"IF({sql_matches(column, regex)}, {tenths(weight)}, 0)" for regex, weight in patterns
    )


def named_hits(tests: dict[str, str]) -> str:
    """SQL: names whose test holds, in pack order."""
    cases = ", ".join(f"IF({test}, {sql_text(name)}, NULL)" for name, test in tests.items())
    return f"array_compact(array({cases}))"


def either(*tests: tuple[str, list[str]]) -> str:
    """SQL: one of the columns contains one of its words."""
    return "(" + " OR ".join(sql_any(column, words) for column, words in tests if words) + ")"


def language_names() -> str:
    """Languages by suffix first, then those recognised by their patterns."""
    limit = tenths(pack.LANGUAGE_THRESHOLD)
    by_suffix = {
        name: "ext IN (" + ", ".join(sql_text(s) for s in info["suffixes"]) + ")"
        for name, info in pack.LANGUAGES.items()
    }
    by_pattern = {
        name: f"({weighted('content', info['patterns'])}) >= {limit}"
        for name, info in pack.LANGUAGES.items()
    }
    return f"array_distinct(concat({named_hits(by_suffix)}, {named_hits(by_pattern)}))"


def framework_names() -> str:
    return named_hits({
        name: either(("content", words), ("path", parts))
        for name, (words, parts) in pack.FRAMEWORKS.items()
    })


def architecture_names() -> str:
    def count(words: list[str]) -> str:
        return " + ".join(f"IF({sql_contains('content', w)}, 1, 0)" for w in words)

    return named_hits({name: f"({count(words)}) >= 2" for name, words in pack.ARCHITECTURES.items()})


def devops_names() -> str:
    return named_hits({
        name: either(("path", parts), ("content", words))
        for name, (parts, words) in pack.DEVOPS.items()
    })


def cloud_names() -> str:
    """The text is put in lower case once for all groups."""
    hits = named_hits({
        name: sql_any("t", [w.lower() for w in words]) for name, words in pack.CLOUD.items()
    })
    return f"transform(array(lower(content)), t -> {hits})[0]"


def language_level(name: str) -> str:
    """SQL: level of the first level word of that language found in the text."""
    branches = []
    for language, info in pack.LANGUAGES.items():
        words = " ".join(
            f"WHEN {sql_contains('content', word)} THEN {sql_text(level)}"
            for word, level in info["levels"]
        )
        branches.append(f"WHEN {sql_text(language)} THEN CASE {words} ELSE 'beginner' END")
    return f"CASE {name} {' '.join(branches)} ELSE 'beginner' END"


def readable() -> Column:
    return F.col("ext").isin(*SUFFIXES["skills"])


def trait_columns(only_readable: bool = False) -> list[Column]:
    """The five name arrays; with ``only_readable`` other files get empty ones."""
    texts = {
        "languages": language_names(), "frameworks": framework_names(),
        "architectures": architecture_names(), "devops": devops_names(), "cloud": cloud_names(),
    }
    nothing = F.expr("CAST(array() AS ARRAY<STRING>)")
    return [
        (F.when(readable(), F.expr(text)).otherwise(nothing) if only_readable else F.expr(text))
        .alias(name)
        for name, text in texts.items()
    ]


def file_traits(files: DataFrame) -> DataFrame:
    """One row per readable file with the five name arrays; ``content`` stays for levels."""
    return files.where(readable()).select("file_id", "path", "content", *trait_columns())


def skill_sql(name: str, category: str, level: str, confidence: str, evidence: str,
              description: str = "''") -> str:
    """SQL: one skill struct from SQL parts."""
    return (
        f"CAST(named_struct('name', {name}, 'category', {category}, 'level', {level}, "
        f"'confidence', CAST({confidence} AS DOUBLE), 'evidence', {evidence}, "
        f"'description', {description}, 'version_hint', '') AS {SKILL})"
    )


def no_skills() -> str:
    return f"CAST(array() AS ARRAY<{SKILL}>)"


def _rendered(template: str) -> str:
    text = f"replace({sql_text(template)}, '{{name}}', name)" if "{name}" in template else sql_text(template)
    return f"replace({text}, '{{path}}', path)" if "{path}" in template else text


def kind_skills(kind: str) -> str:
    """SQL: skill structs of one trait array."""
    category, level, confidence, description, evidence = pack.KINDS[kind]
    actual = language_level("name") if level is None else sql_text(level)
    one = skill_sql("name", sql_text(category), actual, str(confidence),
                    f"array({_rendered(evidence)})", _rendered(description))
    return f"transform({kind}, name -> {one})"


def explode_skills(found: DataFrame) -> DataFrame:
    """One row per skill; ``seq`` is its place within the file. See ``flatten_hits`` for
    the outer form."""
    return (
        found.select("file_id", "path", F.posexplode_outer("skills").alias("seq", "s"))
        .where(F.col("s").isNotNull())
        .select("file_id", "path", "seq", "s.*")
    )


def trait_skills(kinds: tuple[str, ...] = TRAITS) -> Column:
    return F.expr(f"concat({', '.join(kind_skills(kind) for kind in kinds)})")


def skill_rows(files: DataFrame, kinds: tuple[str, ...] = TRAITS) -> DataFrame:
    """All five kinds of skills, languages first."""
    return explode_skills(
        file_traits(files).select("file_id", "path", trait_skills(kinds).alias("skills"))
    )


def trait_hits() -> Column:
    """SKILL001–004 of one trait row."""
    parts = []
    for check, kind in zip(SKILL_FINDINGS, TRAITS):
        one = hit(check, what=F.array_join(F.col(kind), ", "), tags=F.col(kind))
        parts.append(F.when(F.size(kind) > 0, F.array(one)).otherwise(no_hits()))
    return F.concat(*parts)


def skill_findings(files: DataFrame) -> DataFrame:
    """Info findings that name the traits of each file."""
    return flatten_hits(file_traits(files).select("file_id", "path", trait_hits().alias("hits")))
