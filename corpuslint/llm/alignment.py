"""Alignment of two tokenizers' tokens by merge-path partitioning.

A text is encoded twice: a blank and the text by a byte-level vocabulary (A), the text by a piece model (B, which adds
the blank itself). Tokens are byte ranges. Places where tokens of both end cut them into groups; an A and a B token whose
ranges overlap are linked, and a pair of ids counts as often as it is linked in the whole corpus.

The token ends of a block of documents are two sorted lists (every document's begin where the one before ends). Merging
them takes one step per end, and the merge path crosses the diagonal of step d at the one place where the first d ends
lie before all others. Binary searches on every ``PIECE_STEPS``-th diagonal find these places, which cuts the merge into
independent pieces of equal work, however long the documents are. A piece emits its overlaps (one per distinct end) and
the places where both ends meet; where such a pair of equal ends is cut by a diagonal, the later piece takes it for an
overlap and the stitching turns it into a group end.

A block is one row: its distinct pairs of ids with their numbers of links, and its documents with their groups and
their links as (place in the block's pairs, times). Only the blocks' distinct pairs are shuffled to be summed up, and
the sums travel back the same way, so a very frequent pair is one row per block. A block holds at most ``BLOCK_BYTES`` of
text or one document.

Texts that are null, empty, or not equal to the joined bytes of either side have no tokens: all counts are 0 and the
groups are ''. Special tokens' strings are plain text. Every row gets a row, repeated or with null ``doc_id``; other
columns are not read; an empty table gives no rows."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import slices
from .common import on_workers

PIECE_STEPS = 1 << 16
BLOCK_BYTES = 6_000_000
#: A run of white space of this length goes to the slower library, whose pattern engine does not recurse.
LONG_BLANK = re.compile(r"\s{5000}")
DOCUMENT = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,places:array<int>,times:array<int>"
BLOCKS = f"block long, pairs array<long>, links array<long>, documents array<struct<{DOCUMENT}>>"
_CODERS: dict[tuple[str, str, str], Coders] = {}


class Coders:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, byte_vocabulary: str, byte_ranks: str, piece_model: str, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(byte_vocabulary)
        self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Ids as they stand in the groups: inside a side, and as its last.
        self.first_b = 2 * len(self.bytes_a)
        self.names = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.names += [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B; none if their bytes are not those of a blank and the text."""
        if not text:
            return [], []
        whole = " " + text
        if LONG_BLANK.search(text):
            a = self.slow.encode(whole, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(whole)
        b, raw = self.pieces.encode(text), whole.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else ([], [])


def coders(byte_vocabulary: str, byte_ranks: str, piece_model: str, pattern: str) -> Coders:
    """This worker's tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (byte_vocabulary, byte_ranks, piece_model)
    if key not in _CODERS:
        _CODERS[key] = Coders(*key, pattern)
    return _CODERS[key]


def diagonal_cuts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path (of equal ends, A's first) crosses every ``steps``-th diagonal: ends taken from A and B."""
    diagonal = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(diagonal), bool)
        first[open_] = a[middle[open_]] <= b[diagonal[open_] - middle[open_] - 1]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, diagonal - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, ...]:
    """Overlaps (A, B token) and group ends (A, B token) of one piece, from its own ends alone.

    A token of A overlaps the B token in which it ends; a token of B the A token in which it ends, unless that one ends
    there as well: then the overlap is known and both end a group."""
    mine, other = a[i0:i1], b[j0:j1]
    in_b = j0 + np.searchsorted(other, mine, "left")
    in_a = np.searchsorted(mine, other, "left")
    equal = np.zeros(len(other), bool)
    inside = in_a < len(mine)
    equal[inside] = mine[in_a[inside]] == other[inside]
    number = np.arange(j0, j1)
    return (
        np.concatenate([np.arange(i0, i1), i0 + in_a[~equal]]), np.concatenate([in_b, number[~equal]]),
        i0 + in_a[equal], number[equal],
    )


def merge(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, ...]:
    """All overlaps and group ends of two sorted lists of ends: pieces merged on their own, then stitched."""
    cuts = list(zip(*(c.tolist() for c in diagonal_cuts(a, b, steps)), strict=True))
    made = []
    for (i0, j0), (i1, j1) in zip(cuts, cuts[1:]):
        link_a, link_b, end_a, end_b = merge_piece(a, b, i0, i1, j0, j1)
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:
            # The diagonal fell between two equal ends: B's overlap at j0 is none, but the end of a group.
            at = int(np.flatnonzero((link_b == j0) & (np.arange(len(link_b)) >= i1 - i0))[0])
            link_a, link_b = np.delete(link_a, at), np.delete(link_b, at)
            end_a, end_b = np.append(i0 - 1, end_a), np.append(j0, end_b)
        made.append((link_a, link_b, end_a, end_b))
    return tuple(np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*made, strict=True)) or (
        np.zeros(0, np.int64),
    ) * 4


def group_texts(coder: Coders, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> list[str]:
    """All tokens as they stand in the groups, in their order."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[end_a], last_b[end_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a)) + np.append(0, end_b + 1)[group_a]
    place_b = np.arange(len(b)) + (end_a + 1)[group_b]
    which = np.empty(len(a) + len(b), np.int64)
    which[place_a], which[place_b] = 2 * a + last_a, 2 * b + last_b + coder.first_b
    return list(map(coder.names.__getitem__, which.tolist()))


def aligned_block(coder: Coders, ids: list[int | None], texts: list[str | None], steps: int) -> dict:
    """A block's row: distinct pairs, their links, and the documents."""
    found = [coder.ids(text) for text in texts]
    n_a, n_b = (np.fromiter((len(pair[k]) for pair in found), np.int64, len(found)) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(pair[k] for pair in found), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    ends_a, ends_b = np.cumsum(coder.sizes_a[a]), np.cumsum(coder.sizes_b[b])
    link_a, link_b, end_a, end_b = merge(ends_a, ends_b, steps)
    document = np.repeat(np.arange(len(found)), n_a)
    names = group_texts(coder, a, b, end_a, end_b)
    bounds = np.append(0, np.cumsum(n_a + n_b)).tolist()
    links = np.bincount(document[link_a], minlength=len(found))
    groups = np.bincount(document[end_a], minlength=len(found))
    coded = pa.array(a[link_a] << 32 | b[link_b]).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    pairs = coded.dictionary.to_numpy()
    # Links of a document that hold the same pair are one entry.
    entries = pc.value_counts(pa.array(document[link_a] * max(1, len(pairs)) + which))
    keys, times = entries.field(0).to_numpy(), entries.field(1).to_numpy()
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    cuts = np.searchsorted(keys, np.arange(len(found) + 1) * max(1, len(pairs)))
    places = keys % max(1, len(pairs))
    documents = [
        {
            "doc_id": doc, "n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": int(groups[k]), "n_links": int(links[k]),
            "groups": "".join(names[bounds[k] : bounds[k + 1]])[:-1],
            "places": places[cuts[k] : cuts[k + 1]], "times": times[cuts[k] : cuts[k + 1]],
        }
        for k, doc in enumerate(ids)
    ]
    return {"pairs": pairs, "links": np.bincount(which, minlength=len(pairs)), "documents": documents}


ARROW = pa.schema([
    ("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())),
    ("documents", pa.list_(pa.struct([
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ]))),
])


def aligned_blocks(docs: DataFrame, byte_vocabulary: str, byte_ranks: str, piece_model: str, pattern: str,
                   block_bytes: int = BLOCK_BYTES, steps: int = PIECE_STEPS) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text); ``documents.groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B in order."""
    on_workers(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        coder = coders(byte_vocabulary, byte_ranks, piece_model, pattern)
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                row = aligned_block(coder, part.column(0).to_pylist(), part.column(1).to_pylist(), steps)
                yield pa.RecordBatch.from_pylist([row | {"block": number}], ARROW)
                number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(align, BLOCKS)


COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), count over the corpus and whether it is the highest of its B id."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.links").alias("count")
    ).withColumn("b", F.expr("CAST(pair & 4294967295L AS int)"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(blocks: DataFrame, keep: str = "", keep_type: str = "string") -> DataFrame:
    """Documents of saved ``blocks`` with n_best and count_sum; ``keep`` names one more field of theirs to return."""
    spark: SparkSession = blocks.sparkSession
    on_workers(spark)
    wanted = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    sums = wanted.join(pair_counts(blocks), "pair").select("block", "place", "count", "best")
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = COUNTED + (f", {keep} {keep_type}" if keep else "")

    def count(sums: pa.Table, blocks: pa.Table) -> pa.Table:
        order = np.argsort(sums["place"].to_numpy())
        counts, best = sums["count"].to_numpy()[order], sums["best"].to_numpy()[order].astype(np.int64)
        documents = blocks.combine_chunks()["documents"].combine_chunks().flatten()
        places, times = documents.field("places"), documents.field("times")
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        bounds = np.append(0, np.cumsum(pc.list_value_length(places).to_numpy()))

        def summed(values: np.ndarray) -> pa.Array:
            total = np.append(0, np.cumsum(values))
            return pa.array(total[bounds[1:]] - total[bounds[:-1]])

        columns = [documents.field(f) for f in fields] + [summed(n * best[at]), summed(n * counts[at])]
        return pa.table(columns + ([documents.field(keep)] if keep else []), names=[f.split()[0] for f in schema.split(", ")])

    kept = blocks.select(F.col("block").alias("of"), "documents")
    return sums.groupBy("block").cogroup(kept.groupBy("of")).applyInArrow(count, schema)
