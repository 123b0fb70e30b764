"""Fill-in-middle, exact duplicates and alignment against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpuslint.llm import alignment, exact_dup, fill_in_middle as fim
from corpuslint.llm.queries import QUERIES
from pyspark.sql import functions as F

from .conftest import ROWS, SF

ODD = [
    (20, "<P> is a sentinel"), (21, "a<S"), (22, "<<M"), (23, "x<M>y"), (24, "日本<S\U0001f600>é" * 9), (25, "S>P>M>" * 30),
    (26, "▁ lower bar"), (27, "<|endoftext|> is text <s></s><unk><0x0A>"), (28, "  two  blanks \n\n\t tab"), (29, "\x00\x01"),
    (30, "é   ﬁ ½"), (31, " " * 12_000 + "a" + "\n" * 6_000), (32, "b" * 30_000),
]


def plain_fim(doc, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM>é日\U0001f600", max_size=30), st.sampled_from(["psm", "spm"]), st.integers(0, 30), st.integers(0, 30))
def test_rotation_and_back(text, form, x, y):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    first, second = sorted((x % (len(text) + 1), y % (len(text) + 1)))
    p, m, s = text[:first], text[first:second], text[second:]
    out = fim.cut(text.encode(), form, first, second)
    assert out.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fim.restore(out, form).decode() == text


@pytest.mark.parametrize("size", [0, 1, 2, fim.CHUNK - 1, 2 * fim.CHUNK, 2 * fim.CHUNK + 1, 5 * fim.CHUNK + 7])
def test_reverse_over_chunks(size):
    data = np.random.default_rng(size).integers(0, 256, size + 4, np.uint8)
    view = data.copy()
    fim.reverse(view, 2, 2 + size)
    assert (view[2 : 2 + size] == data[2 : 2 + size][::-1]).all() and (view[:2] == data[:2]).all() and (view[-2:] == data[-2:]).all()


def test_fill_in_middle(make_docs):
    rows = ROWS + ODD
    made = fim.restored(fim.fill_in_middle(make_docs(rows)))
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == sorted(((*plain_fim(*row), row[1] or "") for row in rows), key=repr)
    assert made.limit(0).count() == 0 and fim.restored(fim.fill_in_middle(make_docs(rows).limit(0))).count() == 0


def test_fill_in_middle_query(spark, sf_docs):
    got = {r["doc_id"]: r for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()}
    forms = Counter()
    for doc in sf_docs.collect():
        *wanted, output = plain_fim(doc["doc_id"], doc["text"])
        row = got[doc["doc_id"]]
        assert list(row)[:5] == wanted
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()
        forms[row["form"]] += 1
    assert len(forms) == 3 and len(got) == sf_docs.count()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 99))
def test_perfect_hash(n, seed):
    draw = np.random.default_rng(seed)
    digests = np.unique(draw.integers(0, 2**63, (n, 4)).astype(np.uint64), axis=0)
    made = exact_dup.PerfectHash.of(digests)
    assert sorted(made.slots(digests).tolist()) == list(range(len(digests)))
    others = made.slots(draw.integers(0, 2**63, (50, 4)).astype(np.uint64))
    assert ((others >= -1) & (others < max(1, len(digests)))).all()
    bits = int(made.levels.sum())
    assert bits <= 64 * len(made.levels) + 5 * len(digests)


def plain_groups(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return {t: (max((d for d in docs if d is not None), default=None), len(docs)) for t, docs in groups.items()}


@pytest.mark.parametrize("history", ["doc_id <= 5", "doc_id > 100", "true", "doc_id % 2 = 0"])
def test_exact_duplicates(make_docs, history):
    rows = ROWS + ODD + [(40 + i, "many copies") for i in range(60)] + [(None, "no id"), (None, "no id"), (90, "Ab"), (91, "ab")]
    docs = make_docs(rows).repartition(3)
    found = exact_dup.exact_duplicates(docs, F.expr(history), shard_digests=5).collect()
    groups = plain_groups(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r["doc_id"], digest[r["text_sha256"]]) for r in found) == Counter((d, t or "") for d, t in rows)
    kept = Counter()
    for r in found:
        assert (r["keep_id"], r["group_size"]) == groups[digest[r["text_sha256"]]]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    old = {r[0] for r in docs.filter(history).select(F.coalesce("text", F.lit(""))).collect()}
    assert all(r["known"] == (digest[r["text_sha256"]] in old) for r in found)
    assert exact_dup.exact_duplicates(docs.limit(0), F.expr(history)).count() == 0


def test_a_nonmember_in_a_slot_is_no_member(spark):
    """Every arrival is answered by some slot of a small hash; only equal bytes count."""
    rows = [(i, f"old {i}") for i in range(40)] + [(100 + i, f"new {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dup.exact_duplicates(docs, F.col("doc_id") < 100, shard_digests=1000).collect()
    assert len(found) == 440 and all(r["group_size"] == 1 and r["kept"] and r["known"] == (r["doc_id"] < 100) for r in found)


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as p

    return [*(p.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")), p.PATTERN]


def byte_table():
    """The byte of every character in which the byte-level vocabulary is written."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


def plain_alignment(files, texts):
    """The definition, token by token, with the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_file(files[0])
    byte_level.encode_special_tokens = True
    pieces, table = sentencepiece.SentencePieceProcessor(model_file=files[2]), byte_table()

    def ranges(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    made = []
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(table[c] for c in byte_level.id_to_token(i))) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
                 for i, p in ((i, pieces.id_to_piece(i)) for i in pieces.encode(text))]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        a, b = ranges(a), ranges(b)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        rest = [iter(a), iter(b)]
        for high in both:
            sides = []
            for side in rest:
                ids = []
                for i, _, e in side:
                    ids.append(str(i))
                    if e == high:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        links, j0 = [], 0
        for i, s, e in a:
            j = j0
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
            while j0 < len(b) and b[j0][2] <= e:
                j0 += 1
        made.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(link for *_, links, _ in made for link in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (a, b, g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for a, b, g, links, groups in made
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60), st.integers(1, 9))
def test_merge_in_pieces(a, b, steps):
    total = sum(a)
    a, b = np.cumsum(a).astype(np.int64), np.cumsum(b).astype(np.int64)
    b = np.append(b[b < total], total).astype(np.int64) if total else b[:0]
    link_a, link_b, end_a, end_b = alignment.merge(a, b, steps)
    starts_a, starts_b = np.append(0, a)[:-1], np.append(0, b)[:-1]
    wanted = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]}
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == sorted(wanted)
    assert list(zip(end_a.tolist(), end_b.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    low_a, low_b = alignment.diagonal_cuts(a, b, steps)
    assert (np.diff(low_a + low_b) <= steps).all()


@pytest.mark.parametrize("block_bytes, steps", [(200, 3), (6_000_000, 1 << 16)])
def test_alignment(spark, make_docs, files, block_bytes, steps):
    rows = [r for r in ROWS + ODD if r[0] != 5] + [(50, "never ending story " * 300), (51, "Grüße, 世界! don't stop 12345")]
    folder = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/aligned-{random.random()}"
    alignment.aligned_blocks(make_docs(rows).coalesce(2), *files, block_bytes=block_bytes, steps=steps).write.parquet(folder)
    found = alignment.with_counts(spark.read.parquet(folder), keep="groups").collect()
    wanted = [(doc, *rest) for (doc, _), rest in zip(rows, plain_alignment(files, [t for _, t in rows]))]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert any(r["n_a"] == 0 and r["doc_id"] == 26 for r in found) and sum(r["n_links"] > 0 for r in found) > 10
    empty = folder + "-empty"
    alignment.aligned_blocks(make_docs(rows).limit(0), *files).write.parquet(empty)
    assert alignment.with_counts(spark.read.parquet(empty)).count() == 0


def test_alignment_query(spark, sf_docs, files):
    docs = sf_docs.select("doc_id", "text").collect()
    wanted = {}
    for doc, (*counts, groups) in zip(docs, plain_alignment(files, [d["text"] for d in docs])):
        wanted[doc["doc_id"]] = (*counts, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, SF).collect()}
    assert found == wanted
