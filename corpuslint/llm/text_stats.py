"""Statistics of whole texts as native columns, one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, let, words

COUNTS = [
    "n_chars_text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_upper", "n_digits", "n_bangs", "n_stops", "n_same_neighbour", "n_long_words", "n_letters",
]


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(parts: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by their 64-bit hash; the sort that finds their places runs only where one repeats."""

    def places(ordered: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.when(k > 0, ordered[k - 1]["h"] == x["h"]).otherwise(False)
            return before | F.when(k < F.size(ordered) - 1, ordered[k + 1]["h"] == x["h"]).otherwise(False)

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda x, k: F.when(k < F.size(at) - 1, F.least(F.lit(width), at[k + 1] - x)).otherwise(width)
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)])
        )

    def count(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(marked, lambda s: let(places(s), covered))
        )

    return let(parts, lambda w: F.when(F.size(w) < width, 0).otherwise(let(windows(w), count)))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the counts of ``COUNTS`` for the column ``text`` (null: empty)."""
    split = docs.select(
        *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), words(F.col("text").cast("string")).alias("_words")
    )
    text, parts = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    same = F.size(F.filter(parts, lambda w, i: F.when(i > 0, parts[i - 1] == w).otherwise(False)))
    counts = {
        "n_chars_text": F.length(text),
        "n_words": F.size(parts),
        "word_chars": _without(text, r"[\x20\x09-\x0D]+"),
        "n_symbols": F.length(text) - _without(text, "[#*$%&|<>]+"),
        "n_repeat_words": repeated_words(parts),
        "n_distinct_words": F.size(F.array_distinct(parts)),
        "n_upper": _without(text, r"\P{Lu}+"),
        "n_letters": _without(text, r"\P{L}+"),
        "n_digits": _without(text, "[^0-9]+"),
        "n_bangs": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "n_stops": F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))),
        "n_same_neighbour": same,
        "n_long_words": F.size(F.filter(parts, lambda w: F.length(w) > 20)),
    }
    found = split.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()], line_counts.alias("_lines"))
    return found.select(
        *keep, *counts, F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.dup").cast("long").alias("n_dup_lines")
    )


def share(part: str, whole: str) -> str:
    """part / whole as SQL, 0 where there is nothing."""
    return f"(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0D END)"
