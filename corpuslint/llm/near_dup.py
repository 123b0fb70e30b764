"""Near-duplicate documents by tensored MinHash banding, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``width`` words (A-Z lowered; with fewer words the whole sequence is
one shingle). Documents with equal sets are one class; only classes are compared. Two collections of ``bands`` short
bands (``rows`` minhashes each) are computed, and every pair (i, j) of a band from the first and one from the second
is the key of a table: bands**2 tables from 2 * bands * rows minhashes. A pair of similarity s shares a key with
probability (1 - (1 - s**rows)**bands)**2, which is 0.9996 at 0.85 and more above.

Inside a bucket the member that shares the most buckets with others is the hub. Round one confirms all members
against their hubs and joins what is linked into components; a group of copies falls together here, in as many
comparisons as it has members. The members around one hub that are still in several components are a group to refine.
A shingle that only one of these documents has can be in no intersection, which bounds every similarity from above;
most members that are not linked to the hub drop out by that bound.

Groups of at most ``leaf`` members are compared pair by pair. In a larger group every member is described by its
difference from the hub (any set would do; the groups made from this one keep it, as their own hubs differ from most
members in more): the hub's shingles it lacks and those it has beside. For two members x and y

    |x & y| = |hub| - |lacks(x) | lacks(y)| + |beside(x) & beside(y)|,

so a linked pair must have ``need`` = cost(x) + cost(y) - slack(hub) differences in common, where cost = (1 - r) lacks +
r beside, slack = (1 - 2 r) |hub|, r = similarity / (1 + similarity). If need is not positive, both are linked to the
hub and in one component already. All others share one of their size - need + 1 rarest differences, and the members
that share one form a smaller group with a hub of its own. Differences inside one component only, or of one member, lead
to nothing. Every step compares each member with one hub, so a group of many different near copies is resolved in
about as many comparisons as it has members, no pair that shares a bucket is lost, and no group is expanded into pairs.

Texts without words and null texts have an empty set and stay alone. Rows decide for themselves: a doc_id that repeats
with another text is another document, of rows repeated in full one stays, and rows with null ``doc_id`` are compared
as well (after all others; the component_id of a component without any id is null). Other columns are not read. An
empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import slices
from .common import checked_broadcast, fresh_folder, on_workers, saved

PLANES = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of every text."""
    import xxhash

    texts = pc.ascii_lower(texts.fill_null(""))
    parts = pc.split_pattern(pc.replace_substring_regex(texts, r"[\x09-\x0D]", " "), " ")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    which = coded.indices.to_numpy()
    real = np.fromiter(map(bool, words), bool, len(words))[which]
    bounds = parts.offsets.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    flat, factors = hashes[which[real]], _odd(7, width)
    windows = len(flat) - width + 1
    rolled = _mixed(sum(flat[k : windows + k] * factors[k] for k in range(width))) if windows > 0 else flat
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield _mixed(np.array([(flat[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield flat[:0]


def _band_columns(bands: int) -> list[str]:
    return [f"a{i}" for i in range(bands)] + [f"b{i}" for i in range(bands)]


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, a digest of the set, the bands of both collections and four bits of every
    minhash."""
    on_workers(docs.sparkSession)
    names = [*ROW, "n_shingles", "d1", "d2", *_band_columns(bands), *[f"p{i}" for i in range(PLANES)]]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * bands * rows
        factors, shifts, mixers = _odd(11, n)[:, None], _odd(13, n)[:, None], _odd(17, rows)
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, len(ROW)):
                found = []
                for s in shingle_sets(part.column(len(ROW)), width):
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    least = np.full(n, ~np.uint64(0))
                    for i in range(0, len(s), 4096):
                        least = np.minimum(least, (s[None, i : i + 4096] * factors + shifts).min(axis=1))
                    least >>= np.uint64(32)
                    band = _mixed((least.reshape(-1, rows) * mixers).sum(axis=1)).view(np.int64)
                    planes = [
                        int(bits[((least >> np.uint64(p)) & np.uint64(1)).astype(bool)].sum()) for p in range(PLANES)
                    ]
                    found.append((len(s), *digest.tolist(), *band.tolist(), *planes))
                columns = zip(*found, strict=True)
                yield pa.record_batch(
                    [*part.columns[: len(ROW)], *[pa.array(c, pa.int64()) for c in columns]], names=names
                )

    schema = ", ".join(f"{c} long" for c in names)
    return numbered(docs).mapInArrow(sketch, schema)


ROW = ["row", "doc_id", "text_hash"]


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number that says nothing), doc_id, text_hash and text; a column ``row`` of the caller's is not read."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (id, other): the smallest id that can be reached.

    Labels move along edges and then jump to the label of their label, until none changes."""
    both = saved(edges.union(edges.select("other", "id")).distinct())
    labels = saved(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")))
    while True:
        near = labels.select(F.col("id").alias("other"), F.col("component").alias("seen"))
        seen = both.join(near, "other").groupBy("id").agg(F.min("seen").alias("seen"))
        moved = labels.join(seen, "id").select("id", "component", F.least("component", "seen").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        new = saved(
            moved.join(far, "next").select("id", "component", F.least("next", "jump").alias("next"))
        )
        labels = new.select("id", F.col("next").alias("component"))
        if new.filter("next < component").isEmpty():
            return labels


def _plausible(similarity: float, hashes: int) -> Column:
    """No pair of the similarity has smaller sizes or more differing minhashes, seen through four bits of each."""
    p = (1 - similarity) * (1 - 2.0**-PLANES)
    limit = math.ceil(hashes * p + 6 * math.sqrt(hashes * p * (1 - p)))
    differ = reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"u.p{i}").bitwiseXOR(F.col(f"v.p{i}")) for i in range(PLANES)])
    sizes = F.least("u.n", "v.n") >= similarity * F.greatest("u.n", "v.n")
    return sizes & (F.bit_count(differ) <= limit)


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, set) of the classes ``nodes`` (id, doc_id, text_hash of one of their rows), saved."""
    spark = docs.sparkSession
    on_workers(spark)
    nodes = checked_broadcast(nodes.distinct())
    texts = numbered(docs).alias("t")
    same = (F.col("t.text_hash") == F.col("w.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    wanted = texts.join(nodes.alias("w"), same).select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [s.view(np.int64) for s in shingle_sets(part.column(1), width)]
                bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(bounds, flat)], names=["id", "set"])

    folder = fresh_folder(spark, "sets")
    wanted.mapInArrow(sets, "id long, set array<long>").dropDuplicates(["id"]).write.parquet(folder)
    return spark.read.parquet(folder)


def _compared(pairs: DataFrame, found: DataFrame, similarity_percent: int) -> DataFrame:
    """``pairs`` (id, other, ...) with both full sets, what they share, and whether that is enough."""
    # The pairs get the hubs' sets first, so the sets that travel are spread by id.
    other = found.select(F.col("id").alias("other"), F.col("set").alias("other_set"))
    both = pairs.join(other, "other").join(found, "id").withColumn("shared", F.size(F.array_intersect("set", "other_set")))
    union = F.size("set") + F.size("other_set") - F.col("shared")
    return both.withColumn("linked", 100 * F.col("shared") >= similarity_percent * union)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (id, other); nodes without a label are their own component."""
    ends = links.select("id", "other").join(labels, "id", "left").select(
        F.coalesce("component", "id").alias("a"), F.col("other").alias("id"), F.col("id").alias("first")
    ).join(labels, "id", "left").select("first", "a", F.col("id").alias("second"), F.coalesce("component", "id").alias("b"))
    ends = saved(ends.filter("a <> b"))
    if ends.isEmpty():
        return labels
    moved = components(ends.select(F.col("a").alias("id"), F.col("b").alias("other"))).select(
        F.col("id").alias("component"), F.col("component").alias("next")
    )
    fresh = ends.select(F.col("first").alias("id")).union(ends.select("second")).distinct()
    every = labels.unionByName(fresh.join(labels, "id", "left_anti").withColumn("component", F.col("id")))
    return saved(every.join(moved, "component", "left").select("id", F.coalesce("next", "component").alias("component")))


def _in_several(labelled: DataFrame) -> DataFrame:
    """Members (g, id, component) of groups in several components, with the size of the group."""
    groups = labelled.groupBy("g").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    return labelled.join(groups.select("g", "size"), "g")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (g, id) of groups in several components, with component and size of the group."""
    return _in_several(members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))


def smaller_groups(described: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Groups (g, parent, id, component) in which every linked pair of different components of a group ``parent`` meets
    again, and what describes the members there (parent, id, hub_size, cost, features): of their differences those
    that can be in common with a member of another component, in this group and in all groups made from it.

    ``described``: g, id, component, hub_size, cost, features. Members are sorted into classes of similar cost, as
    what a pair needs depends on both costs; one that needs more than it has at all, or finds only its own component, is
    left out first."""
    r = similarity / (1 + similarity)
    classed = saved(described.select("g", "id", "component", "hub_size", "features", "cost").withColumn(
        "class", F.floor(F.log(F.greatest("cost", F.lit(0.1))) / math.log(1.25)).cast("int")
    ).withColumn("most", F.size("features")))

    def met(members: DataFrame) -> DataFrame:
        """Members with every class of their group that they may have a partner in, and what the pair needs."""
        theirs = members.groupBy("g", F.col("class").alias("their_class")).agg(
            F.min("cost").alias("their_least"), F.max("most").alias("their_most"),
            F.min("component").alias("their_low"), F.max("component").alias("their_high"),
        )
        # At most a few dozen classes a group; a margin keeps rounding from asking for one too many.
        need = F.greatest(
            F.lit(1), F.ceil(F.col("cost") + F.col("their_least") - F.col("hub_size") * (1 - 2 * r) - 1e-6).cast("int")
        )
        return members.join(theirs, "g").withColumn("need", need).filter(
            "most >= need AND their_most >= need AND (their_low <> component OR their_high <> component)"
        )

    able = met(classed.drop("features")).select("g", "id").distinct()
    features = classed.join(able, ["g", "id"], "left_semi").select("g", "id", "component", F.explode("features").alias("e"))
    # Differences that the same members have lead to one group, under the hash of those members.
    useful = features.groupBy("g", "e").agg(
        F.count("*").alias("often"), F.bit_xor(F.xxhash64("id")).alias("held_by"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter("low < high").select("g", "e", "often", "held_by")
    ranked = features.join(useful, ["g", "e"]).groupBy("g", "id").agg(
        F.array_sort(F.collect_list(F.struct("often", "held_by", "e"))).alias("features")
    )
    own = saved(classed.drop("features", "most").join(ranked, ["g", "id"]).withColumn("most", F.size("features")))
    prefix = F.expr("array_distinct(transform(slice(features, 1, most - need + 1), f -> f.held_by))")
    key = F.xxhash64("g", F.least("class", "their_class"), F.greatest("class", "their_class"), "held_by")
    found = met(own).withColumn("held_by", F.explode(prefix)).select(
        key.alias("g"), F.col("g").alias("parent"), "id", "component"
    ).distinct()
    return _one_of_equal(saved(found)), own.select(
        F.col("g").alias("parent"), "id", "hub_size", "cost", F.transform("features", lambda f: f["e"]).alias("features")
    )


def _one_of_equal(groups: DataFrame) -> DataFrame:
    """``groups`` (g, id, component, ...) without those in one component and without those that have the
    same members in the same components as another."""
    members = groups.groupBy("g").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("id", "component")).alias("d1"),
        F.bit_xor(F.xxhash64("component", "id")).alias("d2"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter("low < high")
    return groups.join(members.groupBy("size", "d1", "d2").agg(F.min("g").alias("g")).select("g"), "g", "left_semi")


def near_duplicates(docs: DataFrame, similarity_percent: int = 85, width: int = 5, bands: int = 9,
                    rows: int = 3, leaf: int = 16) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_shingles, component_id, kept, stays, text_hash.

    ``kept`` compares the ids; ``stays`` is true for exactly one row of every component."""
    spark: SparkSession = docs.sparkSession
    similarity, hashes = similarity_percent / 100, 2 * bands * rows
    folder, class_folder = fresh_folder(spark, "sketches"), fresh_folder(spark, "classes")
    sketches(docs, width, bands, rows).write.parquet(folder)
    sketch = spark.read.parquet(folder)
    same = ["n_shingles", "d1", "d2"]
    of_set = [*_band_columns(bands), *[f"p{i}" for i in range(PLANES)]]
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_hash")
    # Ids of classes rise with the first row of each, so the smallest id of a component names the row that stays.
    sketch.filter("n_shingles > 0").groupBy(*same).agg(
        F.min(rank).alias("first"), *[F.any_value(c).alias(c) for c in of_set]
    ).orderBy("first").select(
        F.monotonically_increasing_id().alias("id"), *same, *of_set, "first.doc_id", "first.row", "first.text_hash"
    ).write.parquet(class_folder)
    classes = spark.read.parquet(class_folder)
    texts = classes.select("id", "doc_id", "text_hash")
    info = classes.select("id", F.col("n_shingles").alias("n"), *[f"p{i}" for i in range(PLANES)])

    first, second = (F.array(*[f"{x}{i}" for i in range(bands)]) for x in "ab")
    keys = F.flatten(
        F.transform(first, lambda a, i: F.transform(second, lambda b, j: F.xxhash64(a, b, i * bands + j)))
    )
    members = classes.select("id", F.explode(keys).alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = saved(members.join(shared, "key").select("key", "id", "size"))
    weights = saved(buckets.groupBy("id").agg(F.sum("size").alias("weight")))
    hubs = buckets.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("top"))
    starred = buckets.join(hubs.select("key", (-F.col("top.col2")).alias("other")), "key")
    around = saved(starred.filter("id <> other").select("id", "other").distinct())
    test = _plausible(similarity, hashes)
    stars = saved(
        around.join(info.alias("u"), "id").join(info.withColumnRenamed("id", "other").alias("v"), "other")
        .filter(test).select("id", "other")
    )
    sets = _sets(docs, texts.join(stars.select("id").union(stars.select("other")).distinct(), "id", "left_semi"), width)
    links = saved(_compared(stars, sets, similarity_percent).filter("linked").select("id", "other"))
    labels = components(links)

    opened = saved(_open(_around_roots(around, weights), labels).drop("size"))
    if not opened.isEmpty():
        sets = _sets(docs, texts.join(opened.select("id").distinct(), "id", "left_semi"), width)
        # A shingle that no other of these documents has is in no intersection.
        alone = sets.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(
            F.count("*").alias("often"), F.min("id").alias("id")
        ).filter("often = 1").groupBy("id").agg(F.count("*").alias("alone"))
        common = info.join(opened.select("id").distinct(), "id", "left_semi").join(alone, "id", "left").withColumn(
            "common", F.col("n") - F.coalesce("alone", F.lit(0))
        ).drop("alone")
        hopeful = saved(common.filter(100 * F.col("common") >= similarity_percent * F.col("n")))
        labels = _refined(
            opened.join(hopeful.select("id"), "id", "left_semi").select("g", "id"), labels, sets, hopeful, test,
            similarity_percent, leaf,
        )

    winners = classes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"), F.col("row").alias("winner"))
    resolved = classes.join(labels, "id", "left").select(*same, F.coalesce("component", "id").alias("component")).join(
        winners, "component"
    ).drop("component")
    answered = sketch.select("row", "doc_id", "text_hash", *same).join(resolved, same, "left")
    alone, stays = F.col("winner").isNull(), F.coalesce(F.col("row") == F.col("winner"), F.lit(True))
    return answered.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        stays.alias("stays"), "text_hash",
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), "stays"))


def _around_roots(around: DataFrame, weights: DataFrame) -> DataFrame:
    """Groups (g, id) of the members around hubs (id, other): a hub that lies around heavier ones hands its members on to the
    heaviest, twice over, so that the many hubs of one large group share one."""
    hubs = around.select(F.col("other").alias("id")).distinct()
    heavy = weights.select(F.col("id").alias("other"), F.col("weight").alias("above"))
    up = saved(
        around.join(hubs, "id", "left_semi").join(weights, "id").join(heavy, "other")
        .filter("above > weight OR (above = weight AND other < id)").groupBy("id")
        .agg(F.max(F.struct("above", -F.col("other"))).alias("top")).select(F.col("id").alias("g"), (-F.col("top.col2")).alias("up"))
    )
    twice = up.join(up.select(F.col("g").alias("up"), F.col("up").alias("root")), "up", "left").select(
        "g", F.coalesce("root", "up").alias("root")
    )
    stars = around.select(F.col("other").alias("g"), "id").unionByName(hubs.select(F.col("id").alias("g"), "id"))
    return stars.join(twice, "g", "left").select(F.coalesce("root", "g").alias("g"), "id").distinct()


def _refined(groups: DataFrame, labels: DataFrame, sets: DataFrame, hopeful: DataFrame, test: Column,
             similarity_percent: int, leaf: int) -> DataFrame:
    """``labels`` after all links between members of one group (g, id) are found.

    While groups are split, a member linked to its hub takes the hub's label in that group only; the links of all levels
    together change the labels of all once at the end."""
    similarity, description, small, links = similarity_percent / 100, None, [], []
    r = similarity / (1 + similarity)
    groups = groups.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    while True:
        opened = saved(_in_several(groups))
        small.append(opened.filter(F.col("size") <= leaf).select("g", "id"))
        large = opened.filter(F.col("size") > leaf)
        if large.isEmpty():
            break
        # The hub is the first member of the component that has the most.
        parts = large.groupBy("g", "component").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        hubs = parts.groupBy("g").agg(F.max(F.struct("n", -F.col("id"), "component")).alias("top")).select(
            "g", (-F.col("top.col2")).alias("other"), F.col("top.component").alias("hub_component")
        )
        spokes = large.join(hubs, "g").drop("size")
        compared = _compared(spokes.filter("id <> other").select("id", "other").distinct(), sets, similarity_percent)
        if description is None:
            lacks, beside = F.size("other_set") - F.col("shared"), F.size("set") - F.col("shared")
            pairs = saved(compared.select(
                "id", "other", "linked", F.size("other_set").alias("hub_size"), (lacks * (1 - r) + beside * r).alias("cost"),
                F.concat(F.array_except("other_set", "set"), F.array_except("set", "other_set")).alias("features"),
            ))
            spokes = spokes.join(pairs, ["id", "other"])
        else:
            pairs = saved(compared.select("id", "other", "linked"))
            spokes = spokes.join(pairs, ["id", "other"]).join(description, ["parent", "id"])
        links.append(pairs.filter("linked").select("id", "other"))
        described = spokes.withColumn(
            "component", F.when(F.col("linked"), F.col("hub_component")).otherwise(F.col("component"))
        )
        groups, description = smaller_groups(described, similarity)

    if links:
        labels = _relabelled(labels, reduce(DataFrame.unionByName, links))
    held = saved(_open(reduce(DataFrame.unionByName, small), labels)).join(hopeful, "id")
    u, v = held.alias("u"), held.alias("v")
    most = F.least("u.common", "v.common")
    possible = 100 * most >= similarity_percent * (F.col("u.n") + F.col("v.n") - most)
    apart = (F.col("u.g") == F.col("v.g")) & (F.col("u.id") < F.col("v.id")) & (F.col("u.component") != F.col("v.component"))
    pairs = saved(u.join(v, apart & possible & test).select(F.col("u.id").alias("id"), F.col("v.id").alias("other")).distinct())
    more = saved(_compared(pairs, sets, similarity_percent).filter("linked").select("id", "other"))
    return _relabelled(labels, more)
