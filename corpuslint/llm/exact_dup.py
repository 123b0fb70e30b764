"""Exact duplicates against a history that is kept as minimal perfect hashes.

The distinct digests (SHA-256) of the history are dealt into shards, and every shard becomes one row of an index: a
minimal perfect hash (levels of bits: a digest's bit is set in the first level where no other falls on its place; the
rank of the bit is its slot) and slots with the full digest, the winner's locator (doc_id and row) and the number of
copies. Digests that arrive are reduced to one row each before they travel, then looked up in their shard's hash and
compared with the slot's digest byte by byte, so that a digest that is no member never counts as one. Members are
repeats of the history and compete with its winner; the others are new and form groups of their own. The winner of a
group is its row with the largest doc_id, among equal ids that of the smallest row number; a null doc_id never wins
against another one.

Nothing of a group but its best row and its size travels, so its size does not matter; a shard holds about
``SHARD_DIGESTS`` digests of either side. Groups with more than a thousandth of all rows are at most a thousand, and
only they are broadcast when the answers go back to the rows.

Null texts count as empty; texts are equal if their bytes are. Every row gets a row, also with null ``doc_id`` (its
keep_id is null only if the whole group has no id) and if it repeats another in all columns (one of them is kept). Other
columns are read by the callers' condition only; an empty table or an empty history is fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh_folder, on_workers

SHARD_DIGESTS = 1 << 17
GAMMA = 2.0  # bits per digest in a level
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
INDEX = "shard long, levels binary, bits binary, digests binary, docs binary, null_docs binary, rows binary, copies binary"
ANSWER = "digest binary, keep_id long, keep_row long, group_size long, known boolean"


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places of digests (rows of four 64-bit words) in a level of ``size`` bits."""
    factors = np.arange(8 * level + 1, 8 * level + 9, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    x = (digests * factors).sum(axis=1)
    for shift, factor in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct digests; some slot or -1 for others."""

    def __init__(self, levels: np.ndarray, words: np.ndarray):
        self.levels, self.words = levels, words
        self.before = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        levels: list[int] = []
        flags: list[np.ndarray] = []
        left = digests
        while len(left):
            size = 64 * max(1, round(GAMMA * len(left) / 64))
            place = _places(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            flags.append(alone)
            left = left[~alone[place]]
        bits = np.concatenate([np.zeros(0, bool), *flags])
        return cls(np.array(levels, np.int64), np.packbits(bits, bitorder="little").view("<u8"))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        found, left, start = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
        for level, size in enumerate(self.levels.tolist()):
            at = _places(digests[left], level, size) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[left[here]] = self.before[word[here]] + np.bitwise_count(below)
            left, start = left[~here], start + size
        return found


def _words(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def digested(docs: DataFrame, history: Column) -> DataFrame:
    """row, doc_id, digest and whether the row belongs to the history, saved in the shared folder."""
    folder = fresh_folder(docs.sparkSession, "digests")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"),
    ).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def best_rows(rows: DataFrame) -> DataFrame:
    """Distinct digests: digest, doc_id and row of the winner, copies."""
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("back")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies")).select(
        "digest", "best.doc_id", (-F.col("best.back")).alias("row"), "copies"
    )


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def write_index(distinct: DataFrame, folder: str, shards: int) -> None:
    """One row per shard of the history's distinct digests (columns of ``best_rows``)."""
    on_workers(distinct.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = _words(table["digest"])
        made = PerfectHash.of(words)
        order = np.argsort(made.slots(words))
        docs = table["doc_id"]
        columns = {
            "levels": made.levels, "bits": made.words, "digests": words[order],
            "docs": docs.fill_null(0).to_numpy()[order], "null_docs": np.packbits(docs.is_null().to_numpy()[order]),
            "rows": table["row"].to_numpy()[order], "copies": table["copies"].to_numpy()[order],
        }
        return pa.table(
            [pa.array([table["shard"][0].as_py()], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in columns.values()]],
            names=["shard", *columns],
        )

    _sharded(distinct, shards).groupBy("shard").applyInArrow(build, INDEX).write.parquet(folder)


def look_up(spark: SparkSession, folder: str, arrived: DataFrame, shards: int) -> DataFrame:
    """The winner of every digest of the index and of ``arrived`` (columns of ``best_rows``): columns of ``ANSWER``."""
    on_workers(spark)

    def answer(new: pa.Table, index: pa.Table) -> pa.Table:
        new = new.combine_chunks()
        digests, copies = new["digest"].to_pylist(), new["copies"].to_numpy()
        docs, rows = new["doc_id"].to_pylist(), new["row"].to_pylist()
        out = []
        slots = np.full(len(digests), -1, np.int64)
        held: list[bytes] = []
        if index.num_rows:
            (entry,) = index.to_pylist()
            raw, n = entry["digests"], len(entry["digests"]) // 32
            held = [raw[32 * i : 32 * i + 32] for i in range(n)]
            missing = np.unpackbits(np.frombuffer(entry["null_docs"], np.uint8), count=n)
            old_docs = [None if gone else doc for doc, gone in zip(np.frombuffer(entry["docs"], "<i8").tolist(), missing)]
            old_rows = np.frombuffer(entry["rows"], "<i8").tolist()
            old_copies = np.frombuffer(entry["copies"], "<i8").tolist()
            made = PerfectHash(np.frombuffer(entry["levels"], "<i8"), np.frombuffer(entry["bits"], "<u8"))
            if digests:
                slots = made.slots(_words(new["digest"]))
        hit = set()
        for digest, doc, row, n, slot in zip(digests, docs, rows, copies.tolist(), slots.tolist(), strict=True):
            known = slot >= 0 and held[slot] == digest
            if known:
                hit.add(slot)
                n += old_copies[slot]
                rivals = [(doc, row), (old_docs[slot], old_rows[slot])]
                doc, row = max(rivals, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
            out.append((digest, doc, row, n, known))
        out += [(held[i], old_docs[i], old_rows[i], old_copies[i], True) for i in range(len(held)) if i not in hit]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.table(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in ANSWER.split(", ")]
        )

    index = spark.read.schema(INDEX).parquet(folder)
    return _sharded(arrived, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, ANSWER)


def exact_duplicates(docs: DataFrame, history: Column, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, known (its text is in the
    history). ``history`` tells which rows were there before."""
    spark = docs.sparkSession
    rows = digested(docs, history)
    old, new = best_rows(rows.filter("old")), best_rows(rows.filter("NOT old"))
    total = rows.count()
    shards = max(1, -(-total // shard_digests))
    folder, answers = fresh_folder(spark, "perfect-hash"), fresh_folder(spark, "winners")
    write_index(old, folder, shards)
    look_up(spark, folder, new, shards).write.parquet(answers)
    winners = spark.read.schema(ANSWER).parquet(answers)
    # At most a thousand groups can each have more than a thousandth of the rows.
    is_large = F.col("group_size") > max(1.0, total / 1000)
    large = F.broadcast(winners.filter(is_large))
    answered = rows.join(large, "digest").unionByName(
        rows.join(large.select("digest"), "digest", "left_anti").join(winners.filter(~is_large), "digest")
    )
    return answered.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )
