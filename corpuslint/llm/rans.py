"""Token files coded by a static range asymmetric numeral system.

Documents are ordered by doc_id and cut into segments of whole documents, at least ``segment_tokens`` ids each (the
last of a part may be shorter). A segment has one static frequency table, counted over all its ids and shared by its
blocks of ``block_tokens`` ids. A block can be decoded alone: token i belongs to lane ``i % lanes``, all lanes move in
step, and the words they emit are interleaved in one stream. The states of the lanes and the place in the stream are
kept every ``checkpoint_steps`` steps, so a decoder may also start inside a block. Every block has a checksum of its
stream and one of its ids.

A file set is a folder of Parquet files (so Spark commits, moves and retries them on any shared store), one row per
segment: part, segment, first_token (in its part), lanes, checkpoint_steps, doc_ids (int64), null_docs (bits),
doc_tokens (uint32), frequencies (zlib: uint32 tokens, then uint32 frequencies with the sum 2**BITS), and blocks with
n_tokens, checkpoints (int64 states of the lanes, then the int64 place, for steps 0, checkpoint_steps, ...), words
(uint32), stream_crc32, ids_crc32. Numbers are little-endian.

Null texts count as empty: their only id is the end id. Null doc_id comes first and is kept; repeated rows are written
as often as they occur; other columns are not read; an empty table gives an empty file set."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import encoder, slices
from .common import on_workers

BITS = 18
LOW = 1 << 20
BLOCK = "n_tokens:int,checkpoints:binary,words:binary,stream_crc32:bigint,ids_crc32:bigint"
SEGMENTS = (
    "part int, segment int, first_token long, n_tokens long, lanes int, checkpoint_steps int, doc_ids binary, "
    f"null_docs binary, doc_tokens binary, frequencies binary, blocks array<struct<{BLOCK}>>"
)
ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("lanes", pa.int32()), ("checkpoint_steps", pa.int32()), ("doc_ids", pa.binary()), ("null_docs", pa.binary()),
    ("doc_tokens", pa.binary()), ("frequencies", pa.binary()),
    ("blocks", pa.list_(pa.struct([
        ("n_tokens", pa.int32()), ("checkpoints", pa.binary()), ("words", pa.binary()),
        ("stream_crc32", pa.int64()), ("ids_crc32", pa.int64()),
    ]))),
])
DOCUMENTS = "part int, segment int, doc_id long, in_part long, n_tokens long, ids_crc32 long"


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in ascending order and their frequencies: at least 1 each, 2**BITS together.

    Every token first gets 1; what is left is shared out by count, the remainder to the largest fractions."""
    counts = np.bincount(ids)
    tokens = np.flatnonzero(counts)
    weight = counts[tokens].astype(np.float64)
    free = (1 << BITS) - len(tokens)
    share = weight / weight.sum() * free
    frequency = np.floor(share).astype(np.int64)
    frequency[np.argsort(frequency - share, kind="stable")[: free - int(frequency.sum())]] += 1
    return tokens, frequency + 1


class Coder:
    """Interleaved coding with one shared table. States stay below 2**52, so they divide exactly as doubles."""

    def __init__(self, tokens: np.ndarray, frequency: np.ndarray):
        self.tokens = tokens.astype(np.uint32)
        self.frequency = frequency.astype(np.int64)
        self.below = np.cumsum(self.frequency) - self.frequency
        self.number = np.zeros(int(tokens.max()) + 1, np.int32)
        self.number[tokens] = np.arange(len(tokens))
        self.slots = np.repeat(np.arange(len(tokens), dtype=np.int32), self.frequency)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[bytes, bytes]:
        """Checkpoints and stream of one block."""
        steps = -(-len(ids) // lanes)
        numbers = np.zeros(steps * lanes, np.int32)
        numbers[: len(ids)] = self.number[ids]
        numbers = numbers.reshape(steps, lanes)
        state = np.full(lanes, LOW, np.int64)
        words, sent = np.empty((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
        kept = {}
        used = len(ids) - (steps - 1) * lanes
        for step in range(steps - 1, -1, -1):
            width = used if step == steps - 1 else lanes
            row = numbers[step, :width]
            x, f = state[:width], self.frequency[row]
            full = x >= f << (32 + 20 - BITS)
            words[step, :width], sent[step, :width] = x & 0xFFFFFFFF, full
            x = np.where(full, x >> 32, x)
            whole = (x / f).astype(np.int64)
            state[:width] = (whole << BITS) + (x - whole * f) + self.below[row]
            if step % every == 0:
                kept[step] = state.copy()
        before = np.concatenate([[0], np.cumsum(sent.sum(axis=1))])
        marks = b"".join(np.append(kept[step], before[step]).astype("<i8").tobytes() for step in sorted(kept))
        return marks, words[sent].astype("<u4").tobytes()

    def decode(self, marks: bytes, stream: bytes, n_tokens: int, lanes: int, every: int, mark: int = 0) -> np.ndarray:
        """Ids of a block from checkpoint ``mark`` on."""
        words = np.frombuffer(stream, "<u4").astype(np.int64)
        saved = np.frombuffer(marks, "<i8").reshape(-1, lanes + 1)[mark]
        state, place = saved[:lanes].copy(), int(saved[lanes])
        first, steps = mark * every, -(-n_tokens // lanes)
        out = np.empty((steps - first, lanes), np.int32)
        used = n_tokens - (steps - 1) * lanes
        for step in range(first, steps):
            width = used if step == steps - 1 else lanes
            x = state[:width]
            slot = x & ((1 << BITS) - 1)
            row = self.slots[slot]
            out[step - first, :width] = row
            x = self.frequency[row] * (x >> BITS) + slot - self.below[row]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << 32) | words[place : place + len(low)]
            place += len(low)
            state[:width] = x
        return self.tokens[out.reshape(-1)[: n_tokens - first * lanes]]


def coded_segment(raw: bytes, lanes: int, block_tokens: int, every: int) -> tuple[bytes, list[dict]]:
    """Frequency table and blocks of one segment's ids."""
    ids = np.frombuffer(raw, "<u4")
    tokens, frequency = table_of(ids)
    coder, blocks = Coder(tokens, frequency), []
    for a in range(0, len(ids), block_tokens):
        part = ids[a : a + block_tokens]
        marks, stream = coder.encode(part, lanes, every)
        blocks.append({
            "n_tokens": len(part), "checkpoints": marks, "words": stream, "stream_crc32": zlib.crc32(stream),
            "ids_crc32": zlib.crc32(raw[4 * a : 4 * (a + len(part))]),
        })
    return zlib.compress(tokens.astype("<u4").tobytes() + frequency.astype("<u4").tobytes()), blocks


def decoded_segment(row: dict) -> bytes:
    """All ids of a segment; a wrong checksum raises."""
    table = np.frombuffer(zlib.decompress(row["frequencies"]), "<u4").astype(np.int64).reshape(2, -1)
    coder, out = Coder(*table), []
    for number, block in enumerate(row["blocks"]):
        where = f"part {row['part']}, segment {row['segment']}, block {number}"
        if zlib.crc32(block["words"]) != block["stream_crc32"]:
            raise ValueError(f"damaged stream in {where}")
        ids = coder.decode(block["checkpoints"], block["words"], block["n_tokens"], row["lanes"], row["checkpoint_steps"])
        out.append(ids.astype("<u4").tobytes())
        if zlib.crc32(out[-1]) != block["ids_crc32"]:
            raise ValueError(f"damaged ids in {where}")
    return b"".join(out)


def write(docs: DataFrame, folder: str, vocabulary: str, parts: int, segment_tokens: int = 1 << 21,
          block_tokens: int = 1 << 19, lanes: int = 4096, checkpoint_steps: int = 64) -> None:
    """Write ``docs`` (doc_id, text) in ascending doc_id order as a file set of ``parts`` parts."""
    on_workers(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, first, size = TaskContext.get().partitionId(), 0, 0, 0
        tokenizer = encoder(vocabulary)
        held_docs: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, first, size
            frequencies, blocks = coded_segment(b"".join(held), lanes, block_tokens, checkpoint_steps)
            row = {
                "part": part, "segment": segment, "first_token": first, "n_tokens": size, "lanes": lanes,
                "checkpoint_steps": checkpoint_steps,
                "doc_ids": np.array([d or 0 for d in held_docs], "<i8").tobytes(),
                "null_docs": np.packbits([d is None for d in held_docs]).tobytes(),
                "doc_tokens": np.array([len(t) // 4 for t in held], "<u4").tobytes(),
                "frequencies": frequencies, "blocks": blocks,
            }
            segment, first, size = segment + 1, first + size, 0
            held_docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            for rows in slices(batch, 1):
                ids, bounds = tokenizer.encode(rows.column(1))
                raw, bounds = ids.tobytes(), bounds.tolist()
                for doc, a, b in zip(rows.column(0).to_pylist(), bounds, bounds[1:]):
                    held_docs.append(doc)
                    held.append(raw[4 * a : 4 * b])
                    size += b - a
                    if size >= segment_tokens:
                        yield close()
        if held_docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The words are as dense as they get, so Parquet does not compress them again.
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set from its decoded blocks: doc_id, start, n_tokens, ids_crc32, part, segment.

    The parts' starts come from the heads of the segments. A wrong checksum fails the read."""
    on_workers(spark)
    segments = spark.read.schema(SEGMENTS).parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = memoryview(decoded_segment(row))
                docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<u4").astype(int)
                missing = np.unpackbits(np.frombuffer(row["null_docs"], np.uint8), count=len(docs)).astype(bool)
                starts = np.cumsum(sizes) - sizes
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())]
                place = [pa.array(np.full(len(docs), row[c], np.int32)) for c in ("part", "segment")]
                yield pa.record_batch(
                    [*place, pa.array(docs, mask=missing), pa.array(row["first_token"] + starts), pa.array(sizes),
                     pa.array(crcs, pa.int64())],
                    names=["part", "segment", "doc_id", "in_part", "n_tokens", "ids_crc32"],
                )

    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = sizes.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    return segments.mapInArrow(decode, DOCUMENTS).join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "segment"
    )
