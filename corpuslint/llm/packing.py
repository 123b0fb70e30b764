"""Best-fit packing by sum of squares.

Documents become token pieces of at most ``capacity`` ids. The pieces are dealt evenly into groups of
``group_rows``; each group is packed by one task, largest pieces first. A piece goes where the sum of the
squared numbers of open bins per residual gap becomes smallest; a bin is opened only for a piece that fits in none,
as the plain rule opens one for almost every small piece once all gaps are in use. A group leaves about one bin partly
filled, so the loss is about one in a thousand.

Null or empty texts are one piece that holds the end id. Repeated rows are packed as often as they occur, null
``doc_id`` is kept, other columns are not read, an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder, slices
from .common import checkpointed, on_workers

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only where longer than ``capacity``."""
    on_workers(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = tokenizer.encode(part.column(1))
                raw, rows = memoryview(ids.tobytes()), []
                for doc, first, last in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    for piece, start in enumerate(range(first, last, capacity)):
                        end = min(start + capacity, last)
                        rows.append((doc, piece, start - first, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                     *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, taken in the given order.

    Of the open bins with gap g, N(g), a piece of length s leaves one fewer with g and one more with g - s (none,
    if it fills the bin): half the change of the sum is N(g - s) - N(g) + 1, or 1/2 - N(g) if filled. Ties go to the
    smallest gap, then to the newest bin."""
    count = np.zeros(capacity + 1)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        change = count[: capacity - s] - count[s:capacity] + 1
        if len(change):
            change[0] = 0.5 - count[s]
        change[count[s:capacity] == 0] = np.inf
        best = int(change.argmin()) if len(change) else 0
        if len(change) and np.isfinite(change[best]):
            gap = best + s
            count[gap] -= 1
            number = waiting[gap].pop()
        else:
            gap, number, opened = capacity, opened, opened + 1
        bins[i], offsets[i], left = number, capacity - gap, gap - s
        if left:
            count[left] += 1
            waiting[left].append(number)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 8192) -> DataFrame:
    """Give every piece (columns of ``PIECES``) its ``sequence_id`` and ``offset``."""
    on_workers(pieces.sparkSession)
    pieces = checkpointed(pieces)
    groups = max(1, -(-pieces.count() // group_rows))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        sequences = rows["bin_group"].to_numpy() * (1 << 32) + bins
        return rows.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(sequences)).append_column(
            "offset", pa.array(offsets)
        )

    # Row numbers of saved partitions do not change when a task is run again.
    dealt = pieces.withColumn("bin_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInArrow(place, PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, group_rows: int = 8192) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text)."""
    return pack(token_pieces(docs, vocabulary, capacity), capacity, group_rows)
