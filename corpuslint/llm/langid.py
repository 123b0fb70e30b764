"""Language identification by interpolated Kneser-Ney models of characters, one per language.

Texts are lower-cased; runs of characters that are no letters become one blank. Counts of all 4-grams of all texts to
learn from are gathered per language (pre-added in every task). The highest order uses counts, lower orders the number
of different characters seen in front; each order has the discount n1 / (n1 + 2 n2) and passes what it takes to the
next lower one, down to equal shares. The model is one table per order: sorted 64-bit hashes of n-grams, and beside them
a column of log-probabilities per language, filled in for all languages as soon as one has seen the n-gram, and of the
share that a context passes on. A text's n-grams are sorted and counted once, then looked up from the highest order
down. The language with the lowest cross-entropy per character wins.

The score is the probability of being right at the text's margin between the best two cross-entropies, calibrated
on the texts learned from; ``rejected`` is set where the cross-entropy is above that of all but a thousandth of its
language's texts. No n-gram is left out. Up to ``most_grams`` n-grams the tables are broadcast. Beyond it they are
saved, only the most frequent 4-grams are broadcast, and the other 4-grams of a text are counted in its row and
equi-joined with the saved tables, each different one once: the same sums, whatever the size of the model.

Null texts and texts without letters are ``und`` with score 0; so is everything if there is nothing to learn from. Null
languages and null ids are not learned from. Repeated rows and null ``doc_id`` are kept; other columns are not read; an
empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import slices
from .common import checkpointed, fresh_folder, on_workers
from .rule_ensemble import remainder

ORDER = 4
UNSEEN = math.log(1e-9)
SLICE_BYTES = 500_000  # of text that a worker counts at a time; its arrays take many times that
NOT_LETTERS = r"[^\p{L}]+"


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each as two blanks, its lower-cased letters with single blanks, and a blank; and where
    each text begins. A text without letters is empty."""
    texts = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), NOT_LETTERS, " "))
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("  ", texts, " ", ""))
    sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def packed(points: np.ndarray, order: int) -> np.ndarray:
    """n-grams as 64-bit hashes; those of up to three characters are exact."""
    code = points[: len(points) - order + 1].astype(np.uint64)
    for k in range(1, order):
        following = points[k : len(points) - order + 1 + k].astype(np.uint64)
        code = (code << np.uint64(21)) ^ following ^ ((code >> np.uint64(43)) * np.uint64(0x9E3779B97F4A7C15))
    return code


def hash_of(gram: str) -> int:
    return int(packed(np.frombuffer(gram.encode("utf-32-le"), np.uint32), len(gram))[0]) if gram else 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): 4-grams of all ``docs`` (text, lang) with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in total.items():
                grams = codes.astype("<u4").tobytes().decode("utf-32-le")
                yield pa.record_batch(
                    [pa.array([lang] * len(n)), pa.array([grams[i : i + ORDER] for i in range(0, len(grams), ORDER)]), pa.array(n)],
                    names=["lang", "gram", "n"],
                )
            total.clear()

        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                langs = part.column(0)
                for lang in pc.unique(langs).to_pylist():
                    points, bounds = letters(part.filter(pc.equal(langs, lang)).column(1))
                    if len(points) < ORDER:
                        continue
                    codes = packed(points, ORDER)
                    inside = np.ones(len(codes), bool)
                    for k in range(1, ORDER):
                        ends = bounds[1:-1] - k
                        inside[ends[(ends >= 0) & (ends < len(codes))]] = False
                    at = np.flatnonzero(inside)
                    _, first, n = np.unique(codes[at], return_index=True, return_counts=True)
                    rows = points[at[first][:, None] + np.arange(ORDER)]
                    if lang in total:
                        rows, n = np.concatenate([total[lang][0], rows]), np.concatenate([total[lang][1], n])
                        whole = np.ascontiguousarray(rows).view([("", np.uint32)] * ORDER).ravel()
                        _, first, back = np.unique(whole, return_index=True, return_inverse=True)
                        rows, n = rows[first], np.bincount(back, n).astype(np.int64)
                    total[lang] = rows, n
                if sum(len(n) for _, n in total.values()) > 1_000_000:
                    yield from flush()
        yield from flush()

    on_workers(docs.sparkSession)
    found = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _lower(counts: DataFrame) -> DataFrame:
    """Counts of the next lower order: how many different characters were seen in front of each n-gram."""
    return counts.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))


def kneser_ney(counts: DataFrame, langs: list[str], most_grams: int) -> list[dict]:
    """Per order, highest first, the lookup table: hashes (sorted), logs (n-gram by language), and for the contexts of
    that order passes_hashes (sorted) and passes (log of the share that goes to the lower order).

    With more than ``most_grams`` n-grams, a table is the folders ``saved`` (gram, v) and ``saved_passes`` (context, v),
    and only the highest order has hashes and logs too, of its most frequent n-grams."""
    spark = counts.sparkSession
    levels = [checkpointed(counts)]
    for _ in range(ORDER - 1):
        levels.append(checkpointed(_lower(levels[-1])))
    every = F.array(*[F.lit(x) for x in langs])
    # Lower orders and contexts are parts of 4-grams, so none of their tables has more rows.
    n_grams = levels[0].select("gram").distinct().count()
    lower: DataFrame | None = None
    tables = []
    for level, order in zip(reversed(levels), range(1, ORDER + 1)):
        # One row per language comes to the driver.
        ones = {r["lang"]: (r["n1"], r["n2"]) for r in level.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discounts = [(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5 for n1, n2 in (ones.get(x, (0, 0)) for x in langs)]
        discount = F.element_at(F.create_map(*[F.lit(x) for pair in zip(langs, discounts, strict=True) for x in pair]), F.col("lang"))
        context, suffix = F.expr(f"left(gram, {order - 1})").alias("context"), F.expr("substring(gram, 2)").alias("suffix")
        contexts = level.groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        seen = level.groupBy("gram").agg(F.sum("n").alias("all"))
        grams = seen.select("gram", F.explode(every).alias("lang"), context, suffix)
        if lower is None:
            kinds = {r["lang"]: r["k"] for r in level.groupBy("lang").agg(F.count("*").alias("k")).collect()}
            size = math.log(max(kinds.values(), default=1) + 1)
            below = grams.withColumn("lower", F.lit(math.exp(-size)))
        else:
            below = grams.join(lower.withColumnRenamed("gram", "suffix"), ["lang", "suffix"], "left").withColumnRenamed("p", "lower")
        joined = below.join(level, ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left")
        own = F.greatest(F.coalesce("n", F.lit(0)) - discount, F.lit(0.0)) / F.col("total")
        passed = discount * F.col("kinds") / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own + passed * F.col("lower"))
        lower = checkpointed(joined.select("lang", "gram", p.alias("p")))
        passes = contexts.withColumn("log", F.log(passed))

        def wide(frame: DataFrame, name: str, value: Column, empty: float) -> DataFrame:
            """v: the values by language."""
            values = [F.coalesce(F.max(F.when(F.col("lang") == x, value)), F.lit(empty)).cast("float") for x in langs]
            return frame.groupBy(name).agg(F.array(*values).alias("v"))

        def grid(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
            """Sorted hashes and a column per language; as many rows as ``most_grams`` at most."""
            rows = frame.collect()
            hashes = np.array([hash_of(r[0]) for r in rows], np.uint64)
            values = np.array([r["v"] for r in rows], np.float32).reshape(len(rows), len(langs))
            by = np.argsort(hashes, kind="stable")
            return hashes[by], values[by]

        logs, shares = wide(lower, "gram", F.log("p"), UNSEEN), wide(passes, "context", F.col("log"), 0.0)
        table: dict = {"order": order}
        if n_grams <= most_grams:
            table["hashes"], table["logs"] = grid(logs)
            table["pass_hashes"], table["passes"] = grid(shares)
        else:
            for name, frame in (("saved", logs), ("saved_passes", shares)):
                table[name] = fresh_folder(spark, f"kneser-ney-{order}")
                frame.write.parquet(table[name])
            if order == ORDER:
                least = seen.select(F.percentile_approx("all", 1 - most_grams / n_grams, 10_000)).head()[0]
                often = seen.filter(F.col("all") > least).select("gram")
                table["hashes"], table["logs"] = grid(spark.read.parquet(table["saved"]).join(often, "gram", "left_semi"))
        tables.append(table)
    return tables[::-1]


def _at(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(sorted_hashes, wanted)
    place[place == len(sorted_hashes)] = 0
    return place, (sorted_hashes[place] == wanted) if len(sorted_hashes) else np.zeros(len(wanted), bool)


def log_probabilities(points: np.ndarray, tables: list[dict]) -> np.ndarray:
    """Log-probability of the last character of every row of ``points`` (4-grams) by language."""
    n_langs = tables[0]["logs"].shape[1]
    out = np.zeros((len(points), n_langs), np.float32)
    left = np.arange(len(points))
    for table in tables:
        order = table["order"]
        codes = packed(points[left, ORDER - order :].ravel(), 1).reshape(len(left), order)
        code = codes[:, 0]
        for k in range(1, order):
            code = (code << np.uint64(21)) ^ codes[:, k] ^ ((code >> np.uint64(43)) * np.uint64(0x9E3779B97F4A7C15))
        place, known = _at(table["hashes"], code)
        out[left[known]] += table["logs"][place[known]]
        left, code = left[~known], codes[~known]
        if not len(left):
            return out
        if order > 1:
            context = code[:, 0]
            for k in range(1, order - 1):
                context = (context << np.uint64(21)) ^ code[:, k] ^ ((context >> np.uint64(43)) * np.uint64(0x9E3779B97F4A7C15))
            place, known = _at(table["pass_hashes"], context)
            out[left[known]] += table["passes"][place[known]]
        else:
            out[left] += UNSEEN
    return out


def _saved_log_probabilities(grams: DataFrame, tables: list[dict], langs: list[str]) -> DataFrame:
    """``grams`` (gram: different 4-grams) with logs, as ``log_probabilities`` gives them, from the saved tables."""
    logs = f"array_repeat({UNSEEN!r}D, {len(langs)})"
    for table in reversed(tables):
        order = table["order"]
        for name, key, value, sql in (
            ("saved", "gram", f"v{order}", f"right(gram, {order})"),
            ("saved_passes", "context", f"s{order}", f"left(right(gram, {order}), {order - 1})"),
        ):
            if name == "saved" or order > 1:
                saved = grams.sparkSession.read.parquet(table[name]).select(F.col(key).alias("part"), F.col("v").alias(value))
                grams = grams.withColumn("part", F.expr(sql)).join(saved, "part", "left").drop("part")
        if order > 1:
            logs = f"zip_with(coalesce(s{order}, array_repeat(0F, {len(langs)})), {logs}, (a, b) -> a + b)"
        logs = f"CASE WHEN v{order} IS NULL THEN {logs} ELSE CAST(v{order} AS array<double>) END"
    return grams.select("gram", F.expr(logs).alias("logs"))


def _with_rest(found: DataFrame, tables: list[dict], langs: list[str]) -> DataFrame:
    """Adds to every entropy what the row's ``grams``, seen ``times`` times, contribute by the saved tables."""
    rows = checkpointed(found).withColumn("_row", F.monotonically_increasing_id())
    rest = rows.select("_row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("_row", F.col("g.grams").alias("gram"), "g.times")
    logs = _saved_log_probabilities(rest.select("gram").distinct(), tables, langs)
    sums = rest.join(logs, "gram").groupBy("_row").agg(
        F.array(*[F.sum(F.col("times") * F.get("logs", F.lit(i))) for i in range(len(langs))]).alias("_sums")
    )
    total = F.when(F.col("_sums").isNull(), F.col("entropy")).otherwise(
        F.zip_with("entropy", "_sums", lambda e, x: e - x / F.col("n_letters"))
    )
    return rows.join(sums, "_row", "left").withColumn("entropy", total).drop("_row", "_sums", "grams", "times")


def cross_entropies(docs: DataFrame, tables: list[dict], langs: list[str], *keep: str) -> DataFrame:
    """Columns ``keep``, n_letters and the cross-entropy per character of every language (list)."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(tables)
    whole = "saved" not in tables[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), SLICE_BYTES):
                points, bounds = letters(part.column(len(keep)))
                codes = packed(points, ORDER) if len(points) >= ORDER else np.zeros(0, np.uint64)
                spans, firsts, counts = [], [], []
                for a, b in zip(bounds.tolist(), (bounds[1:] - ORDER + 1).tolist()):
                    if b > a:
                        by = np.argsort(codes[a:b])
                        ordered = codes[a:b][by]
                        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                        firsts.append(by[starts] + a)
                        counts.append(np.diff(np.append(starts, b - a)))
                        spans.append(len(starts))
                    else:
                        spans.append(0)
                sizes = np.maximum(bounds[1:] - bounds[:-1] - ORDER + 1, 0)
                sums = np.zeros((len(sizes), len(langs)))
                grams, times, open_spans = [], np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
                if firsts:
                    ends = np.cumsum(spans)
                    rows = points[np.concatenate(firsts)[:, None] + np.arange(ORDER)]
                    if whole:
                        logs = log_probabilities(rows, shared.value)
                    else:
                        table = shared.value[0]
                        place, known = _at(table["hashes"], codes[np.concatenate(firsts)])
                        logs = np.zeros((len(rows), len(langs)), np.float32)
                        logs[known] = table["logs"][place[known]]
                        unknown = rows[~known].astype("<u4").tobytes().decode("utf-32-le")
                        grams, times = [unknown[i : i + ORDER] for i in range(0, len(unknown), ORDER)], np.concatenate(counts)[~known]
                        open_spans = np.diff(np.concatenate([[0], np.cumsum(~known)])[np.concatenate([[0], ends])])
                    logs = logs * np.concatenate(counts)[:, None]
                    full = np.flatnonzero(np.array(spans) > 0)
                    sums[full] = np.add.reduceat(logs.astype(np.float64), (ends - spans)[full], axis=0)
                entropy = -sums / np.maximum(sizes, 1)[:, None]
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, entropy.size + 1, len(langs)), pa.int32()), pa.array(entropy.ravel())
                )
                made = [*part.columns[: len(keep)], pa.array(sizes), flat]
                if not whole:
                    bounds = pa.array(np.concatenate([[0], np.cumsum(open_spans)]), pa.int32())
                    made += [pa.ListArray.from_arrays(bounds, pa.array(v, t)) for v, t in ((grams, pa.string()), (times, pa.int64()))]
                yield pa.record_batch(made, names=[*keep, "n_letters", "entropy", *(() if whole else ("grams", "times"))])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]], "n_letters long", "entropy array<double>"])
    if whole:
        return chosen.mapInArrow(score, schema)
    return _with_rest(chosen.mapInArrow(score, f"{schema}, grams array<string>, times array<long>"), tables, langs)


def _calibration(bins: dict[int, tuple[int, int]], width: float) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a + b * margin))) from (right, wrong) per bin of the margin, by Newton steps."""
    x = np.array([(k + 0.5) * width for k in sorted(bins)])
    right, wrong = (np.array([bins[k][i] for k in sorted(bins)], float) + (0.5 if i == 0 else 0.01) for i in (0, 1))
    a, b = 0.0, 5.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        gradient = np.array([(right - (right + wrong) * p).sum(), ((right - (right + wrong) * p) * x).sum()])
        v = (right + wrong) * p * (1 - p)
        hessian = np.array([[v.sum() + 1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + float(np.clip(step[0], -2, 2)), max(0.1, b + float(np.clip(step[1], -5, 5)))
    return a, b


def identify(docs: DataFrame, most_grams: int = 500_000) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected, cross_entropy.

    Learns from rows with a language whose id's remainder modulo 5 is not 0."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string")).filter((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull())
    counts = checkpointed(gram_counts(known))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    if not langs:
        return docs.select(
            "doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"),
            F.lit(None).cast("double").alias("cross_entropy"),
        )
    tables = kneser_ney(counts, langs, most_grams)
    names = F.array(*[F.lit(x) for x in langs])
    ranked = F.array_sort(F.transform("entropy", lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    found = cross_entropies(docs.withColumn("lang", F.col("lang").cast("string")), tables, langs, "doc_id", "lang")
    scored = checkpointed(
        found.withColumn("r", ranked).select(
            "doc_id", "lang", "n_letters", F.get(names, F.col("r")[0]["i"]).alias("best"), F.col("r")[0]["e"].alias("cross_entropy"),
            (F.coalesce(F.try_element_at("r", F.lit(2))["e"], F.col("r")[0]["e"] + 1) - F.col("r")[0]["e"]).alias("margin"), held,
        )
    )
    width = 0.02
    training = scored.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_letters") > 0))
    bins = training.groupBy(F.least(F.floor(F.col("margin") / width), F.lit(200)).cast("int").alias("k")).agg(
        F.count_if(F.col("best") == F.col("lang")).alias("right"), F.count_if(F.col("best") != F.col("lang")).alias("wrong")
    ).collect()
    a, b = _calibration({r["k"]: (r["right"], r["wrong"]) for r in bins}, width)
    limits = training.groupBy("lang").agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("limit")).collect()
    limit = F.create_map(*[F.lit(x) for r in limits for x in (r["lang"], r["limit"])]) if limits else F.create_map(F.lit(""), F.lit(0.0))
    empty = F.col("n_letters") == 0
    return scored.select(
        "doc_id", "held_out", F.when(empty, "und").otherwise(F.col("best")).alias("lang_pred"),
        F.when(empty, 0.0).otherwise(1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("margin"))))).alias("score"),
        (empty | (F.col("cross_entropy") > F.try_element_at(limit, F.col("best")))).alias("rejected"),
        F.when(~empty, F.col("cross_entropy")).alias("cross_entropy"),
    )
