"""Fill-in-middle by block rotation in place.

A text of n code points is cut twice, at places taken from a digest of the seed and the document's id, into prefix,
middle and suffix. The form is ``plain`` (the text as it is), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or
``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). The bytes are scanned for the cuts, the sentinels are inserted
in one bytearray, and the segments change places by rotation: each of two neighbouring blocks is reversed, then both
together. To restore, the sentinels are found, the rotation is inverted and the sentinels are taken out. A text that
holds a sentinel, or none at all, stays plain, so the first of each sentinel in an output is always the inserted one.

Reversals swap pieces of ``CHUNK`` bytes, so beside the text's own buffer a rotation needs no memory that grows with
it. The work is one narrow pass: no shuffle, whatever the sizes of documents or sources.

Null texts count as empty and are plain. A null ``doc_id`` is digested as the empty string. Repeated rows give equal
rows; other columns are not read, so their names cannot clash; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import slices
from .common import on_workers

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 1 << 16
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse ``view[start:end]`` in place, a chunk from both ends at a time."""
    while end - start > 1:
        size = min(CHUNK, (end - start) // 2)
        head = view[start : start + size][::-1].copy()
        view[start : start + size] = view[end - size : end][::-1]
        view[end - size : end] = head
        start, end = start + size, end - size


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Let the blocks ``[start:middle]`` and ``[middle:end]`` change places."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def code_points(raw: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes that do not continue one."""
    if raw.isascii():
        return len(raw)
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def byte_places(raw: bytes, points: list[int]) -> list[int]:
    """Where the given code points begin in the bytes."""
    if raw.isascii():
        return points
    begins = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
    return begins[points].tolist()


def cut(raw: bytes, form: str, first: int, second: int) -> bytes:
    """The output for cuts before the code points ``first`` <= ``second``."""
    if form == "plain":
        return raw
    a, b = byte_places(raw, [first, second])
    buffer = bytearray(raw)
    buffer[b:b], buffer[a:a], buffer[:0] = SUFFIX, MIDDLE, PREFIX
    # <P> prefix <M> middle <S> suffix: the suffix goes before the middle, or before both.
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text from output and form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    block, moved = (buffer.index(SUFFIX), buffer.index(MIDDLE)) if form == "psm" else (0, buffer.index(PREFIX))
    rotate(buffer, block, moved, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # from the last to the first
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _draw(digest: Column, number: int) -> Column:
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n, form, prefix_chars, middle_chars (null if plain), output."""
    on_workers(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        *[_draw(digest, k).alias(f"h{k}") for k in (1, 2, 3, 4)],
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, *draws = (c.to_pylist() for c in part.columns)
                found = []
                for doc, raw, h1, h2, h3, h4 in zip(ids, texts, *draws, strict=True):
                    n = code_points(raw)
                    plain = not raw or h3 % 100 >= 100 - plain_percent or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE))
                    form = "plain" if plain else "spm" if h4 % 100 < spm_percent else "psm"
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    sizes = (None, None) if plain else (first, second - first)
                    found.append((doc, n, form, *sizes, cut(raw, form, first, second)))
                yield _batch(found, CUT)

    return drawn.mapInArrow(rows, CUT).withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with ``restored``, the text rebuilt from output and form."""
    on_workers(made.sparkSession)
    schema = CUT + ", restored binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5):
                outputs, forms = part.column("output").to_pylist(), part.column("form").to_pylist()
                texts = [restore(output, form) for output, form in zip(outputs, forms, strict=True)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "restored"])

    raw = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("binary"))
    return raw.mapInArrow(rows, schema).withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.record_batch(columns, names=[name for name, _ in fields])
