"""Secrets, decontamination, resharding, near-duplicates, URL filters and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import canonical
from corpuslint.llm import decontaminate, near_dup, queries, resharding, secrets, url_filter

from .conftest import LONG, ROWS, SF

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets_and_look_alikes(make_docs, model):
    hits = [
        f'set token = "{HEX}" now', f"PASSWORD={HEX[:20].upper()}Zq", "api_key: 9fK2mQ8xLr4TzW7pBn3VcD6h", f"Authorization: Bearer {HEX}Ab9",
    ]
    misses = [
        f"commit {HEX} by me", "id = 24be6443-9e3e-49cf-a6b2-d7c90f3602a3", "see: /usr/lib/python3/config/user_list.txt",
        'password = "your_password_here"', "note: thinkers", "https://www.example.com/view/page12/index.html",
    ]
    rows = secrets.findings(make_docs(list(enumerate([*hits, *misses]))), model).collect()
    assert {r.doc_id for r in rows if r.secret} == set(range(len(hits)))
    texts = [*hits, *misses]
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.value for r in rows)


def test_forms_of_secrets(make_docs, model):
    forms = [
        ("mysql --password {} -h db", "S3cr3tPass1"), ("password => '{}',", "S3cr3tPass!"), ('"password":   "{}"', "S3cr3tPass1"),
        ('"password":\n    "{}"', "S3cr3tPass1"), ("Authorization: Basic {}", "dXNlcjpwYXNz"), ("Bearer {}", "qWmZkTxRbVnLpJhGfDsQzXcY"),
        ("pwd=ab,{}", "cd:efgh12"), ("secret token = {} end", "q8Zk2Lm9"), ("a password=x9Kq27Lp;server=main", None),
    ]
    texts = [f.format(v) for f, v in forms]
    want = {i: v for i, (_, v) in enumerate(forms)} | {6: "ab,cd:efgh12", 8: "x9Kq27Lp"}
    plain = ["the password needed here", "a token of thanks", "secret holder came", "author Johnson wrote", "their authority over towns"]
    rows = secrets.findings(make_docs(list(enumerate([*texts, *plain]))), model).collect()
    assert {r.doc_id: r.value for r in rows if r.doc_id < len(texts)} == want
    assert {r.doc_id for r in rows if r.secret} == set(want), [(r.value, r.probability) for r in rows]
    assert all([*texts, *plain][r.doc_id][r.start : r.start + r.length] == r.value for r in rows)


def test_places_of_many_candidates(make_docs, model):
    text = "é\U0001f600 ".join(f'x token = "{zlib.crc32(bytes([k])):08x}{HEX[:20]}" y\n' for k in range(150))
    rows = sorted(secrets.findings(make_docs([(1, text)]), model).collect(), key=lambda r: r.start)
    found = [m.start(1) for m in re.finditer(r'token = "(\w+)"', text)]
    assert [r.start for r in rows] == found and all(text[r.start : r.start + r.length] == r.value for r in rows)
    clean = secrets.redacted(make_docs([(1, text)]), model).first()
    assert clean.text == re.sub(r'"\w+"', f'"{secrets.REMOVED}"', text) and clean.key == "x"


def test_secret_edges(edge_docs, model, spark):
    assert secrets.findings(edge_docs, model).collect() == []
    rows = secrets.redacted(edge_docs, model)
    assert rows.columns == edge_docs.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, edge_docs.collect()))
    assert secrets.redacted(edge_docs.limit(0), model).collect() == []
    assert secrets.train(spark.createDataFrame([(None, 1)], "text string, label int")) == [(0.5,)]


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def windows(words, width=5):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)] * bool(words)


def brute_contaminated(texts, items):
    kept = {i: Counter(windows(plain_words(t))) for i, t in items}
    sizes = {i: len(plain_words(t)) for i, t in items}
    out = []
    for text in texts:
        words, hit = plain_words(text), set()
        for i, n in sizes.items():
            for a in range(len(words) - n + 1) if n else ():
                own = Counter(windows(words[a : a + n]))
                if (own & kept[i]).total() >= 0.8 * (own | kept[i]).total():
                    hit.add(i)
        out.append(sorted(hit))
    return out


def test_decontamination_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 30, 60])))) for k in range(20)]
    items += [(50, items[5][1].upper() + "!"), (51, "a b c a b c a b c a b c a b c a b c"), (52, None), (53, ""), (None, "lost words")]
    texts = []
    for k in range(150):
        words = rng.choices(vocab, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            piece = plain_words(rng.choice(items)[1])
            if piece and rng.random() < 0.6:
                piece[rng.randrange(len(piece))] = rng.choice(vocab)
            at = rng.randint(0, len(words))
            words[at:at] = piece
        texts.append(" ".join(words) if k % 3 else ", ".join(words).title())
    texts += ["a b c " * 7, "a b c " * 5]
    rows = decontaminate.contaminated(
        make_docs(list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got = {r.doc_id: r["item_ids"] for r in rows}
    want = dict(enumerate(brute_contaminated(texts, [i for i in items if i[0] is not None])))
    assert got == want and sum(map(bool, want.values())) > 40
    assert all(r.contaminated == bool(r["item_ids"]) for r in rows)


def brute_clipped(texts, items, similarity=0.8):
    """As ``brute_contaminated``, with windows that reach over the text's ends."""
    kept = {i: (len(plain_words(t)), Counter(windows(plain_words(t)))) for i, t in items}
    out = []
    for text in texts:
        words, hit = plain_words(text), set()
        for i, (n, item) in kept.items():
            for a in range(1 - n, len(words)):
                own = Counter(windows(words[max(a, 0) : a + n]))
                if (own & item).total() >= similarity * (own | item).total():
                    hit.add(i)
                    break
        out.append(sorted(hit))
    return out


def test_items_cut_by_the_ends_of_a_text(spark, make_docs):
    rng = random.Random(8)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(rng.choice([9, 15, 30, 59])))) for k in range(12)]
    texts = []
    for _, item in items:
        words = plain_words(item)
        other = [f"o{j}" for j in range(20)]
        for cut in (1, 2, len(words) // 10, len(words) // 6, len(words) // 4):
            texts += [words[cut:], words[:-cut], words[cut:] + other, other + words[:-cut], words[cut:-1], other + words[cut:] + other]
        texts.append(words[: len(words) // 2] + words[len(words) // 2 + 1 :])
    texts = [" ".join(t) for t in texts]
    rows = decontaminate.contaminated(make_docs(list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = dict(enumerate(brute_clipped(texts, items)))
    assert {r.doc_id: r["item_ids"] for r in rows} == want and 0 < sum(map(bool, want.values())) < len(want)
    assert want != dict(enumerate(brute_contaminated(texts, items)))


def test_similar_items_at_any_distance_of_bits(spark, make_docs):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([9, 15, 45, 59, 100])))) for k in range(8)]
    items += [(90, "a b c d e " * 8), (91, "a b c d e f " * 7)]
    texts = []
    for _, item in items:
        words = plain_words(item)
        for share in (0.04, 0.08, 0.1, 0.12):
            n = max(1, int(share * len(words)))
            at = rng.randrange(len(words) - n)
            new = rng.choices(vocab, k=n)
            half = len(words) // 2
            for copy in (words[:-n] + new, new + words[n:], words[:at] + new + words[at + n :], words[half:] + words[:half]):
                texts.append(rng.choices(vocab, k=rng.randint(0, 70)) + copy + rng.choices(vocab, k=rng.randint(0, 70)))
    texts = [" ".join(t) for t in texts]
    rows = decontaminate.contaminated(make_docs(list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = dict(enumerate(brute_clipped(texts, items)))
    assert {r.doc_id: r["item_ids"] for r in rows} == want and 30 < sum(map(bool, want.values())) < len(want)
    for r in rows:
        for at in r.spans or ():
            own, item = (Counter(windows(w)) for w in (plain_words(texts[r.doc_id])[at.start : at.start + at.m], plain_words(dict(items)[at.item])))
            assert (own & item).total() / (own | item).total() == pytest.approx(at.similarity) and at.similarity >= 0.8


def test_near_fingerprints_meet_in_a_block():
    rng = random.Random(1)
    near = set(decontaminate.NEAR)
    for _ in range(2000):
        bits = rng.sample(range(64), decontaminate.RADIUS)
        change = sum(1 << b for b in bits)
        assert any(((change >> (16 * b)) & 0xFFFF) in near for b in range(decontaminate.BLOCKS))


def test_decontamination_edges(spark, edge_docs):
    items = spark.createDataFrame([(1, "one two three FOUR five six seven eight"), (2, "words")], "item_id long, text string")
    rows = decontaminate.contaminated(edge_docs, items).collect()
    assert sorted((str(r.doc_id), r["item_ids"]) for r in rows if r.contaminated) == [("6", [1]), ("7", [1]), ("None", [2])]
    assert len(rows) == len(ROWS)
    assert not any(r.contaminated for r in decontaminate.contaminated(edge_docs, items.limit(0)).collect())
    assert decontaminate.contaminated(edge_docs.limit(0), items).collect() == []


def test_transfers_are_cheapest():
    rng = random.Random(2)
    for _ in range(40):
        supply = [rng.randint(0, 6) for _ in range(3)]
        room = [rng.randint(2, 6) for _ in range(3)]
        cost = {(i, j): rng.choice([0, 1, 2, 5]) for i in range(3) for j in range(3)}
        if sum(room) < sum(supply):
            with pytest.raises(ValueError):
                resharding.transfers(supply, room, cost)
            continue
        got = resharding.transfers(supply, room, cost)
        assert [sum(n for (i, _), n in got.items() if i == k) for k in range(3)] == supply
        assert all(sum(n for (_, j), n in got.items() if j == k) <= room[k] for k in range(3))
        price = sum(n * cost[a] for a, n in got.items())
        rows = [[s for s in product(range(supply[i] + 1), repeat=3) if sum(s) == supply[i]] for i in range(3)]
        best = min(
            sum(r[i][j] * cost[i, j] for i in range(3) for j in range(3))
            for r in product(*rows) if all(sum(r[i][j] for i in range(3)) <= room[j] for j in range(3))
        )
        assert price == best


def test_resharding(spark, sf_docs, tmp_path):
    docs = sf_docs.withColumn("was", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 5).cast("int"))
    made = resharding.plan(docs, "was", 6)
    resharding.rewrite(docs, "was", made, f"{tmp_path}/s")
    rows = resharding.reread(spark, docs, "was", made, f"{tmp_path}/s").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in rows} == texts and len(rows) == len(texts)
    sizes, slots, old = Counter(), defaultdict(list), Counter()
    for r in rows:
        n = len(r.text.encode()) + 1
        sizes[r.shard] += n
        old[r.old_shard] += n
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(sizes.values()) / 6
    assert all(abs(n - target) < 0.02 * target for n in sizes.values())
    moved = sum(len(r.text.encode()) + 1 for r in rows if r.shard != r.old_shard)
    assert moved == made.bytes_moved <= 1.05 * sum(max(0, n - target) for n in old.values())


def test_unaffected_shards_stay(spark, make_docs, tmp_path):
    docs = make_docs([(k, "abc") for k in range(40)]).withColumn("was", (F.col("doc_id") % 4).cast("int"))
    same = resharding.plan(docs, "was", 4)
    assert same.affected == [] and same.bytes_moved == 0
    rows = resharding.reread(spark, docs, "was", same, f"{tmp_path}/none").collect()
    assert len(rows) == 40 and all(r.shard == r.old_shard for r in rows)
    more = resharding.plan(docs, "was", 5, capacity=[40, 40, 30, 40, 20])
    assert more.affected == [2, 4]
    resharding.rewrite(docs, "was", more, f"{tmp_path}/s")
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/s").select("shard").distinct().collect()} == {2, 4}
    rows = resharding.reread(spark, docs, "was", more, f"{tmp_path}/s").collect()
    assert len(rows) == 40 and {r.old_shard for r in rows if r.shard == 4} == {2}


def test_resharding_edges(spark, edge_docs, tmp_path):
    docs = edge_docs.withColumn("was", F.lit(None).cast("int"))
    made = resharding.plan(docs, "was", 3)
    resharding.rewrite(docs, "was", made, f"{tmp_path}/s")
    rows = resharding.reread(spark, docs, "was", made, f"{tmp_path}/s").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t in ROWS)
    empty = resharding.plan(docs.limit(0), "was", 3)
    assert empty.affected == [] and resharding.reread(spark, docs.limit(0), "was", empty, f"{tmp_path}/e").collect() == []


def brute_components(rows, percent):
    sets, ids = {}, defaultdict(list)
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(windows(words))
        ids[sets[i]].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = [(min(v), k) for k, v in ids.items() if k]
    for v in ids.values():
        if sets[v[0]]:
            for i in v:
                root[find(i)] = root[find(min(v))]
    for a, (i, s) in enumerate(kinds):
        for j, t in kinds[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return {i: (len(sets[i]), min(g)) for g in groups.values() for i in g}


def group_rows(rng):
    """A hub with near copies, a chain in which each is near the next, exact copies and strangers sharing a passage."""
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(100)] = f"n{k}"
        rows.append(" ".join(words))
    chain = [f"c{k}" for k in range(120)]
    for k in range(12):
        chain[k * 5] = f"x{k}"
        rows.append(" ".join(chain).upper())
    rows += [" ".join(f"p{k}" for k in range(40)) + f" s{j} t{j} u{j} v{j} w{j} y{j}" for j in range(40)]
    rng.shuffle(rows)
    return list(enumerate([*rows, *rows[:20]]))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(make_docs, percent):
    rows = group_rows(random.Random(percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make_docs(rows), percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_on_documents(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    found = near_dup.near_duplicates(sf_docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicate_edges(edge_docs):
    rows = near_dup.near_duplicates(edge_docs).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows)
    assert got == sorted([
        ("1", 0, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("None", 4, "None", True), ("4", 1, "4", True),
        ("4", 1, "4", True), ("5", 3, "5", True), ("6", 4, "6", True), ("7", 4, "6", False), ("8", 2, "8", True), ("9", 1, "9", True),
    ])
    assert near_dup.near_duplicates(edge_docs.limit(0)).collect() == [] and LONG


def test_url_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    frame, result = queries.op10_url_filter(spark, SF), con.sql(queries.ORACLE["op10_url_filter"])
    assert canonical(frame.columns, map(tuple, frame.collect())) == canonical(result.columns, result.fetchall())


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.b.com", "b.com", "com", "x.a.b.com", "ab.com", "", "b.com.", ".com"]
    rules = [(rng.choice(hosts), rng.choice(["/", "/p", "/p/q", "", "/p/"]), rng.choice(["allow", "block"])) for _ in range(12)]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "x://", "") for h in hosts for p in ("", "/", "/p", "/pq", "/p/q/r") for q in ("", "?a=/p", "#/p")]
    urls += [None, "", "HTTP://A.B.Com/P", "http://b.com://x/p", "http://b.com/p\n/q", "http://b.com/p", "http://b.com/p"]
    pages = spark.createDataFrame([(k if k % 7 else None, u, 1, "r") for k, u in enumerate(urls)], "page_id long, url string, n int, rule string")
    known = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, action string")
    actions = {}
    for h, p, a in rules:
        actions[h, p] = max(a, actions.get((h, p), a))

    def judged(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [
            (len(h) + len(p), len(h), a, h, p) for (h, p), a in actions.items()
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        return (host, path, best[3] + best[4] if best else None, best[2] if best else "allow")

    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, known).collect())
    assert got == Counter((k if k % 7 else None, *judged(u)) for k, u in enumerate(urls))
    assert {r.verdict for r in url_filter.judge(pages, known.limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), known).collect() == []


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, seen, SF)
        found.write.parquet(f"{tmp_path}/{name}")
        before, seen = seen, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert seen.columns == docs.columns and 0 < seen.count() <= before.count()
    assert {r.doc_id for r in seen.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    rows = {r.doc_id: r for r in before.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(brute_contaminated([r.text for r in rows.values()], items))
    parts = brute_components([(i, r.text) for i, r in rows.items()], 90)
    assert len({c for _, c in parts.values()}) == len(parts)
    assert not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in rows.values())
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_pipeline_edges(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", "key")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        assert stage(spark, docs, SF).filter("doc_id IS NULL").count() == 1, name
