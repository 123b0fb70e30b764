"""Token encoding, packing and token files."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpuslint.llm import packing, rans
from corpuslint.llm.bpe import WordEncoder

from .conftest import ROWS


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbéΣ '#|<>İﬁ́\x85\x1c　\n\t1.", max_size=40),
                          st.sampled_from(["<|endoftext|> <|STARTOFTEXT|>", "a<|startoftext|>b", "don't it'LL"])), max_size=6))
def test_ids_are_those_of_the_tokenizer(vocabulary, tokenizer, texts):
    encoder = WordEncoder(vocabulary, 20)
    for _ in range(2):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [plain(tokenizer, t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_sum_of_squares_takes_the_smallest_sum(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, int), 50)
    level = {}
    for s, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
        gaps = {k: 50 - v for k, v in level.items() if v < 50}

        def cost(k):
            after = [g for x, g in gaps.items() if x != k] + [gaps[k] - s]
            return sum(after.count(g) ** 2 for g in set(after) if g)

        fitting = [k for k, g in gaps.items() if g >= s]
        assert (b in fitting) == bool(fitting)
        if fitting:
            assert cost(b) == min(map(cost, fitting))
        assert at == level.get(b, 0)
        level[b] = at + s
        assert level[b] <= 50


def check_packed(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    return len(places)


def test_packing_edges(edge_docs, vocabulary, tokenizer):
    rows = packing.pack_documents(edge_docs, vocabulary, 64, 100).collect()
    check_packed(rows, 64)
    want = sorted(
        (str(i), k, 64 * k, len(ids[64 * k : 64 * k + 64]), crc(ids[64 * k : 64 * k + 64]))
        for i, t in ROWS for ids in [plain(tokenizer, t)] for k in range(-(-len(ids) // 64))
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(edge_docs.limit(0), vocabulary).collect() == []


def test_packing_is_tight(sf_docs, vocabulary):
    rows = packing.pack_documents(sf_docs, vocabulary).collect()
    assert check_packed(rows, 4096) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=700), st.sampled_from([1, 4, 32]), st.sampled_from([1, 3, 64]))
def test_coder_round_trip_from_every_checkpoint(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    tokens, frequency = rans.table_of(ids)
    assert frequency.min() > 0 and frequency.sum() == 1 << rans.BITS
    coder = rans.Coder(tokens, frequency)
    marks, stream = coder.encode(ids, lanes, every)
    for mark in range(len(marks) // (8 * (lanes + 1))):
        got = coder.decode(marks, stream, len(ids), lanes, every, mark)
        assert got.tolist() == ids[mark * every * lanes :].tolist()


def test_coder_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.4, 200_000) % 40_000).astype(np.uint32)
    _, stream = rans.Coder(*rans.table_of(ids)).encode(ids, 64, 10**6)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert len(stream) < 1.02 * -(share * np.log2(share)).sum() * len(ids) / 8


def test_damage_is_seen():
    frequencies, blocks = rans.coded_segment(np.arange(3000, dtype="<u4").tobytes(), 16, 1000, 8)
    row = {"frequencies": frequencies, "blocks": blocks, "lanes": 16, "checkpoint_steps": 8, "part": 0, "segment": 0}
    assert rans.decoded_segment(row) == np.arange(3000, dtype="<u4").tobytes() and len(blocks) == 3
    for block, change, what in ((1, {"words": blocks[1]["words"][:-1] + b"\xff"}, "stream"), (2, {"ids_crc32": 1}, "ids")):
        bad = row | {"blocks": [b | change if k == block else b for k, b in enumerate(blocks)]}
        with pytest.raises(ValueError, match=f"damaged {what} in part 0, segment 0, block {block}"):
            rans.decoded_segment(bad)


@pytest.mark.parametrize("segment_tokens", [50, 1 << 20])
def test_file_set(spark, edge_docs, vocabulary, tokenizer, tmp_path, segment_tokens):
    rans.write(edge_docs, f"{tmp_path}/f", vocabulary, 3, segment_tokens, 40, 8, 2)
    rows = rans.read(spark, f"{tmp_path}/f").collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist()
    want = sorted((str(i), len(ids), crc(ids)) for i, t in ROWS for ids in [plain(tokenizer, t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want


def test_empty_file_set(spark, edge_docs, vocabulary, tmp_path):
    rans.write(edge_docs.limit(0), f"{tmp_path}/f", vocabulary, 2)
    assert rans.read(spark, f"{tmp_path}/f").collect() == []


def test_packing_keeps_large_ids_beside_a_null(make_docs, vocabulary):
    ids = [1152921504606846977, 1152921504606846979, None, 2**53 + 1, 5]
    rows = packing.pack_documents(make_docs([(i, f"word {i}") for i in ids]).coalesce(1), vocabulary, 64).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids))
