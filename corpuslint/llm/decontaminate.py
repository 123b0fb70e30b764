"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, rare shingles, exact check.

Texts are words of letters and digits, lower-cased. A benchmark item is similar to a window of as many words if the
summed minima of their shingle counts (``WIDTH`` words each; an item with fewer words is one shingle) reach
``similarity`` of the summed maxima. Windows may reach over both ends of a text and then have the words that are there,
so an item cut by the text's end is compared as well. Such a window shares a shingle with the item, so only windows that lie around one
are looked at: a Bloom filter of fixed size over all benchmark shingles finds these places inside the row, and each
place gives the windows that put it where an item has it. A window's SimHash (64 bits over its words) is searched among
the items of its size: four blocks of 16 bits, items entered under every block value up to two bits away, so that all
fingerprints within ``RADIUS`` = 11 bits meet in some block. Candidates are confirmed on the exact counts.

Similar windows can be further apart than that, so an item of ``WIDTH`` words or more has a second way in, which misses
none: a similar window lacks at most 1 - ``similarity`` of the item's shingles, so it holds one of any set with one
more, and the item is entered under its rarest so many. All windows around such a place are counted and confirmed. A
shorter item is one shingle; only its equal is similar, at a distance of 0 bits.

The Bloom filter is the only thing sent to all tasks; when a benchmark outgrows it, it lets more places through and the
joins that follow sort them out. Null and empty texts and items match nothing; equal items count once and all their ids
are reported; null item ids are left out. Every row of ``docs`` gets one row, repeated or with null ``doc_id``; other
columns are not read; an empty table gives no rows, an empty benchmark matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed

WIDTH = 5
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
NEAR = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))]
BLOOM_BITS = 21
PROBES = (0, 21, 42)


def normal_words(text: str) -> Column:
    return F.expr(
        rf"filter(split(lower(coalesce(cast({text} AS string), '')), r'[^\p{{L}}\p{{N}}]+'), w -> w <> '')"
    )


def _window(words: str, at: str, width: int) -> str:
    return f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(width))})"


def shingles(words: str, width: int = WIDTH) -> str:
    """Hashes of all shingles of a word list; one for a shorter list, none for an empty one."""
    short = "".join(
        f" WHEN size({words}) = {n} THEN array({_window(words, '0', n)})" for n in range(1, width)
    )
    return (
        f"CASE WHEN size({words}) = 0 THEN CAST(array() AS array<bigint>){short} "
        f"ELSE transform(sequence(0, size({words}) - {width}), i -> {_window(words, 'i', width)}) END"
    )


def simhash(words: str) -> Column:
    """Bit b is set if it is set in the hashes of more than half of the words."""
    ones = "size(filter(h, x -> (shiftright(x, b) & 1L) = 1L))"
    return F.expr(
        f"transform(array(transform({words}, w -> xxhash64(w))), h -> aggregate(sequence(0, 63), 0L, "
        f"(acc, b) -> acc | CASE WHEN 2 * {ones} > size(h) THEN shiftleft(1L, b) ELSE 0L END))[0]"
    )


def similarity_of(a: str, b: str) -> str:
    """SQL of the summed minima over summed maxima of the counts in two lists of shingle hashes."""
    shared = (
        f"CASE WHEN size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b}) "
        f"THEN size(array_intersect({a}, {b})) ELSE aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + "
        f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))) END"
    )
    return (
        f"transform(array({shared}), s -> CASE WHEN size({a}) + size({b}) = 0 THEN 0D "
        f"ELSE s / (size({a}) + size({b}) - s) END)[0]"
    )


def _bloom(hashes: DataFrame) -> str:
    """SQL of a constant array: at most 2**BLOOM_BITS bits in longs, whatever the benchmark's size."""
    mask = (1 << BLOOM_BITS) - 1
    places = F.expr(f"explode(array({', '.join(f'shiftrightunsigned(h, {s}) & {mask}L' for s in PROBES)}))")
    rows = (
        hashes.select(places.alias("at"))
        .groupBy(F.expr("CAST(shiftright(at, 6) AS int)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63L AS int)))").alias("bits")).collect()
    )
    longs = [0] * (1 << (BLOOM_BITS - 6))
    for row in rows:
        longs[row["word"]] = row["bits"]
    return "CAST(split('" + ",".join(map(str, longs)) + "', ',') AS array<bigint>)"


def _may_hold(h: str, bloom: str) -> str:
    mask = (1 << BLOOM_BITS) - 1
    tests = [
        f"(shiftright({bloom}[CAST(shiftright(at, 6) AS int)], CAST(at & 63L AS int)) & 1L) = 1L".replace(
            "at", f"(shiftrightunsigned({h}, {s}) & {mask}L)"
        )
        for s in PROBES
    ]
    return " AND ".join(tests)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Distinct items: item (number), words, m, shingles, fingerprint, item_ids."""
    items = benchmark.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("long"), normal_words("text").alias("words")
    ).filter("size(words) > 0")
    grouped = items.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return grouped.select(
        F.col("item_ids")[0].alias("item"), "words", F.size("words").alias("m"), F.expr(shingles("words")).alias("item_shingles"),
        simhash("words").alias("item_print"), "item_ids",
    )


def places(docs: DataFrame, bloom: str, sizes: list[int], reach: int) -> DataFrame:
    """Every row of ``docs`` as doc_id, text_hash and its segments: runs of places with a benchmark shingle, at most
    ``reach`` words apart, with ``reach`` words before and after."""
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), normal_words("text").alias("w")
    )
    found = [
        f"CASE WHEN size(w) >= {k} THEN filter(sequence(0, size(w) - {k}), i -> "
        f"exists(array({_window('w', 'i', k)}), h -> {_may_hold('h', 'bits')})) ELSE CAST(array() AS array<int>) END"
        for k in sizes
    ]
    at = f"array_sort(array_distinct(concat({', '.join(found)})))"
    marked = split.withColumn("p", F.expr(f"transform(array({bloom}), bits -> {at})[0]"))
    starts = f"filter(p, (x, i) -> CASE WHEN i > 0 THEN x - p[i - 1] > {reach} ELSE true END)"
    ends = f"filter(p, (x, i) -> CASE WHEN i < size(p) - 1 THEN p[i + 1] - x > {reach} ELSE true END)"
    segment = (
        f"zip_with({starts}, {ends}, (a, b) -> struct(greatest(0, a - {reach}) AS low, filter(p, x -> x BETWEEN a AND b) AS at, "
        f"slice(w, greatest(0, a - {reach}) + 1, b - greatest(0, a - {reach}) + 2 * {reach}) AS words))"
    )
    return marked.select("doc_id", "text_hash", F.expr(segment).alias("segments"))


def around_rare_shingles(segments: DataFrame, anchors: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Every window similar to an item of ``WIDTH`` words or more: row, start, m (words in it), item, similarity."""
    entered = items.filter(F.col("m") >= WIDTH).select("item", "m", F.size("item_shingles").alias("count"), F.explode("item_shingles").alias("h"))
    often = entered.groupBy("h").agg(F.count_distinct("item").alias("often"))
    rare = (
        entered.join(often, "h")
        .withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("often", "h")))
        .filter(F.col("nth") <= F.floor((1 - similarity) * F.col("count") + 1e-6) + 1)
        .select("h", "item", "m").distinct()
    )
    near = anchors.join(rare, "h").groupBy("segment", "item", "m").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    # Windows that hold one of the places, from ``base`` on; H: the hashes of the shingles there.
    base = "greatest(first - m, 0)"
    pieces = (
        near.join(segments.select("segment", "row", "low", F.size("words").alias("n"), "words"), "segment")
        .withColumn("base", F.expr(base)).withColumn("words", F.expr("slice(words, base + 1, last + m - base)"))
        .withColumn("H", F.expr(shingles("words"))).drop("words")
        .join(items.select("item", "item_shingles"), "item")
        .withColumn("known", F.expr("transform(H, h -> array_contains(item_shingles, h))"))
    )
    spans = (
        f"filter(transform(sequence(first - m + {WIDTH}, last), at -> struct(greatest(at, 0) AS start, "
        f"least(at + m, n) - greatest(at, 0) AS m)), w -> w.m >= {WIDTH})"
    )

    def inside(of: str) -> str:
        return f"slice({of}, w.start - base + 1, w.m - {WIDTH - 1})"

    least = f"{similarity} * (w.m - {WIDTH - 1} + size(item_shingles)) / (1 + {similarity}) - 1e-6"
    hopeful = f"filter(array_distinct({spans}), w -> size(filter({inside('known')}, k -> k)) >= {least})"
    windows = pieces.select("row", "item", "low", "base", "item_shingles", "H", F.expr(f"explode({hopeful})").alias("w"))
    return windows.withColumn("doc_shingles", F.expr(inside("H"))).select(
        "row", (F.col("low") + F.col("w.start")).alias("start"), "w.m", "item",
        F.expr(similarity_of("doc_shingles", "item_shingles")).alias("similarity"),
    ).filter(F.col("similarity") >= similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, contaminated, item_ids, spans (first word, words, item,
    similarity) and text_hash."""
    items = checkpointed(benchmark_items(benchmark))
    heads = items.groupBy("m").count().collect()  # one row per item length
    lengths = [r["m"] for r in heads]
    index = items.select("m", F.posexplode("item_shingles").alias("q", "h")).distinct()
    sizes = sorted({min(m, WIDTH) for m in lengths}) or [WIDTH]
    bloom = _bloom(index)
    rows = checkpointed(places(docs, bloom, sizes, max(lengths, default=1))).withColumn(
        "row", F.monotonically_increasing_id()
    )
    segments = checkpointed(
        rows.select("row", F.explode("segments").alias("s")).select("row", "s.low", "s.at", "s.words")
    ).withColumn("segment", F.monotonically_increasing_id())

    anchors = segments.select("segment", "low", F.size("words").alias("n"), F.explode("at").alias("p"), "words").select(
        "segment", "n", F.expr("p - low").alias("p"),
        F.explode(F.array(*[
            F.expr(f"CASE WHEN p - low + {k} <= n THEN {_window('words', '(p - low)', k)} END") for k in sizes
        ])).alias("h"),
    )
    # A segment ends less than ``reach`` words from its places only where the text ends.
    # A shingle that is in no item can lead nowhere.
    anchors = checkpointed(anchors.join(index.select("h").distinct(), "h", "left_semi"))
    windows = anchors.join(index, "h").select(
        "segment", "m", F.expr("greatest(p - q, 0)").alias("start"), F.expr("least(p - q + m, n)").alias("end")
    ).distinct()
    prints = windows.join(segments, "segment").select(
        "row", "m", (F.col("low") + F.col("start")).alias("start"), F.expr("slice(words, start + 1, end - start)").alias("words")
    ).withColumn("print", simhash("words"))

    def block(name: str, b: int) -> str:
        return f"CAST(shiftrightunsigned({name}, {b * BLOCK_BITS}) & 65535L AS int)"

    near = F.array(*[F.lit(x) for x in NEAR])
    entries = items.select(
        "item", "m", "item_print", "item_shingles",
        F.posexplode(F.array(*[F.expr(block("item_print", b)) for b in range(BLOCKS)])).alias("block", "value"),
    ).select("item", "m", "item_print", "block", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    probes = prints.select("*", F.posexplode(F.array(*[F.expr(block("print", b)) for b in range(BLOCKS)])).alias("block", "value"))
    # A pair counts in the first block in which it meets.
    differ = "bit_count({} ^ {})"
    first = " AND ".join(
        f"(block <= {b} OR {differ.format(block('print', b), block('item_print', b))} > 2)" for b in range(BLOCKS)
    )
    hits = probes.join(entries, ["m", "block", "value"]).filter(
        f"bit_count(print ^ item_print) <= {RADIUS} AND {first}"
    ).select("row", "start", "words", "item")
    exact = hits.withColumn("doc_shingles", F.expr(shingles("words"))).join(
        items.select("item", "item_shingles"), "item"
    ).withColumn("similarity", F.expr(similarity_of("doc_shingles", "item_shingles"))).filter(F.col("similarity") >= similarity)
    found = exact.select("row", "start", F.size("words").alias("m"), "item", "similarity").union(
        around_rare_shingles(segments, anchors, items, similarity)
    ).join(items.select("item", "item_ids"), "item")
    matches = found.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.array_sort(F.collect_set(F.struct("start", "m", "item", "similarity"))).alias("spans"),
    )
    return rows.select("row", "doc_id", "text_hash").join(matches, "row", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "spans", "text_hash",
    )
