"""Text statistics, weak rules, the rule ensemble and language identification."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslint.llm import langid, rule_ensemble, text_stats, trees, weak_rules

from .conftest import ROWS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "a b c a b c d", "x x x x", "one\ntwo\none\n\n \n two", "#a $b |c|", "a\x0bb\x0cc\rd\te  f", " lead trail ", "a b",
    "p q r s p q r t p q r", "\U0001f600\U0001f600 É é", "Hi! Hi! Hi!", "a b a b a b a b",
]


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "n_lines": len(lines),
        "n_distinct_words": len(set(words)), "n_chars_text": len(text), "n_bangs": text.count("!"),
        "n_same_neighbour": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_statistics(make_docs, sf_docs):
    texts = dict(enumerate([*TEXTS, *[t for _, t in ROWS]]))
    texts |= {1000 + r.doc_id: r.text for r in sf_docs.collect()}
    rows = text_stats.with_statistics(make_docs(list(texts.items())), "doc_id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


def test_weak_rules(edge_docs, make_docs):
    rows = weak_rules.rate_documents(edge_docs).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in ROWS)
    assert all(r.base_failed and not r.kept for r in rows)
    assert weak_rules.rate_documents(edge_docs.limit(0)).collect() == []
    name = str.maketrans("0123456789", "abcdefghij")
    docs = [(i, " ".join(f"we{k}{i} saw{k} her{k}.".translate(name).replace("..", ".") for k in range(30))) for i in range(40)]
    docs += [(100 + i, "".join(f"w{i}x{k}### q{k}$$$ e{k}*** " for k in range(40))) for i in range(4)]
    docs += [(200 + i, "".join(f"WORD{i}Q{k}!! SHOUT{k}!! " for k in range(40))) for i in range(4)]
    kept = {r.doc_id: (r.kept, r.base_failed) for r in weak_rules.rate_documents(make_docs(docs)).collect()}
    assert all(not failed and keep == (i < 100) for i, (keep, failed) in kept.items())


def plain_em(patterns, rounds):
    """The same model, one pattern and rule at a time."""
    kinds = [vote for vote, _ in weak_rules.RULES.values()]
    prior = weak_rules.PRIOR
    rates = [[weak_rules.START[vote][c] for vote in kinds] for c in (0, 1)]
    for _ in range(rounds):
        size, fired = [0.0, 0.0], [[0.0] * len(kinds), [0.0] * len(kinds)]
        for pattern, n in patterns.items():
            p = [prior, 1 - prior]
            for c in (0, 1):
                for k, vote in enumerate(pattern):
                    p[c] *= rates[c][k] if vote else 1 - rates[c][k]
            for c in (0, 1):
                share = n * p[c] / sum(p)
                size[c] += share
                for k, vote in enumerate(pattern):
                    fired[c][k] += share * bool(vote)
        add = weak_rules.PSEUDO
        rates = [[(fired[c][k] + add * weak_rules.START[vote][c]) / (size[c] + add) for k, vote in enumerate(kinds)] for c in (0, 1)]
        prior = (size[0] + add * weak_rules.PRIOR) / (sum(size) + add)
    return prior, rates


def simulated(n, prior, good, bad, seed):
    """Patterns of votes of documents of two kinds, with planted rates."""
    rng = np.random.default_rng(seed)
    kinds = np.array([vote for vote, _ in weak_rules.RULES.values()])
    is_good = rng.random(n) < prior
    fired = rng.random((n, len(kinds))) < np.where(is_good[:, None], good, bad)
    return Counter(map(tuple, (fired * kinds).tolist()))


def planted():
    rng = np.random.default_rng(5)
    kinds = np.array([vote for vote, _ in weak_rules.RULES.values()])
    good = np.where(kinds == 1, rng.uniform(0.6, 0.95, len(kinds)), rng.uniform(0.01, 0.1, len(kinds)))
    bad = np.where(kinds == 1, rng.uniform(0.1, 0.4, len(kinds)), rng.uniform(0.2, 0.6, len(kinds)))
    good[0], bad[0] = 0.2, 0.22  # a rule that knows nothing
    return good, bad


def test_fit_against_plain_em():
    patterns = simulated(400, 0.7, *planted(), 1)
    model = weak_rules.fit(patterns, 15)
    prior, rates = plain_em(patterns, 15)
    assert model.prior == pytest.approx(prior) and model.good == pytest.approx(rates[0]) and model.bad == pytest.approx(rates[1])
    assert weak_rules.fit({}).prior == weak_rules.PRIOR


def test_planted_accuracies_are_found():
    good, bad = planted()
    model = weak_rules.fit(simulated(20_000, 0.7, good, bad, 2))
    wanted = weak_rules.Model(0.7, good.tolist(), bad.tolist())
    assert model.prior == pytest.approx(0.7, abs=0.05)
    assert model.accuracy() == pytest.approx(wanted.accuracy(), abs=0.05)


def test_a_noisy_bad_vote_does_not_reject(spark):
    model = weak_rules.fit(simulated(20_000, 0.7, *planted(), 3))
    names, kinds = list(weak_rules.RULES), [vote for vote, _ in weak_rules.RULES.values()]
    praised = [vote if vote == 1 else 0 for vote in kinds]
    rows = [praised, [-1, *praised[1:]], [-1 if vote == -1 else 0 for vote in kinds]]
    scores = [r[0] for r in spark.createDataFrame(rows, names).select(weak_rules.posterior(model)).collect()]
    assert scores[0] > 0.9 and scores[1] > 0.9 and scores[2] < 0.1

    def plain(row):
        odds = math.log(model.prior / (1 - model.prior))
        for vote, g, b in zip(row, model.good, model.bad):
            odds += math.log(g / b) if vote else math.log((1 - g) / (1 - b))
        return 1 / (1 + math.exp(-odds))

    assert scores == pytest.approx([plain(r) for r in rows])


def test_verdict_on_documents(sf_docs):
    """The posterior of the votes decides, and not whether all rules pass."""
    rows = weak_rules.rate_documents(sf_docs).collect()
    counts = Counter(tuple(r[n] for n in weak_rules.RULES) for r in rows if r.n_words >= weak_rules.LEAST_WORDS)
    model = weak_rules.fit(counts)
    for r in rows:
        odds = math.log(model.prior / (1 - model.prior))
        for name, g, b in zip(weak_rules.RULES, model.good, model.bad):
            odds += math.log(g / b) if r[name] else math.log((1 - g) / (1 - b))
        assert r.kept == (not r.base_failed and odds >= 0)


def test_trees_and_paths():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    for tree in trees.forest(x, y, 5, 4, rng)[:2]:
        leaves = [p for p in trees.paths(tree)]
        assert len(leaves) == len(set(leaves))
    mean = np.mean([trees.predict(t, x) for t in trees.forest(x, y, 20, 5, rng)], axis=0)
    assert ((mean > 0.5) == y).mean() > 0.97


def test_rule_ensemble_compiles_to_what_it_fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.random((1500, len(rule_ensemble.FEATURES)))
    y = ((x[:, 1] > 0.6) | (x[:, 4] < 0.1)).astype(float)
    bias, rules = rule_ensemble.fit(x, y)
    assert 0 < len(rules) < 200
    margin = bias + sum(w * rule_ensemble.rule_matrix(x, [r])[:, 0].astype(float) for w, r in rules)
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x[:200]], list(rule_ensemble.FEATURES))
    got = [r[0] for r in frame.select(rule_ensemble.score_column(bias, rules)).collect()]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-margin[:200]))))
    assert (((margin > 0) == y).mean()) > 0.97


def test_rule_ensemble_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = rule_ensemble.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97
    assert scored.count() == docs.count()


def test_rule_ensemble_edges(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0), (6, 0), (77, 1)], "doc_id long, quality int")
    rows = rule_ensemble.score_documents(edge_docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.score == 0.5 for r in rule_ensemble.score_documents(edge_docs, labels.limit(0)).collect())
    assert rule_ensemble.score_documents(edge_docs.limit(0), labels).collect() == []


def brute_kneser_ney(counts, gram):
    """Log-probability of the last character, straight from the definition."""
    levels = [counts]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def p(g):
        if not g:
            return 1 / (kinds + 1)
        level = levels[4 - len(g)]
        n1, n2 = (sum(v == k for v in level.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        after = [v for k, v in level.items() if k[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        return max(level.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

    kinds = len(levels[3])
    return math.log(p(gram))


def test_kneser_ney_follows_its_definition(spark, make_docs):
    texts = {"en": ["the cat sat on the mat", "a cat and a dog"], "de": ["der hund und die katze", "das ist der hund"]}
    docs = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts], "text string, lang string")
    counts = langid.gram_counts(docs)
    own = defaultdict(Counter)
    for lang, ts in texts.items():
        for t in ts:
            padded = f"  {t} "
            own[lang].update(padded[i : i + 4] for i in range(len(padded) - 3))
    assert {(r.lang, r.gram): r.n for r in counts.collect()} == {(k, g): n for k, c in own.items() for g, n in c.items()}
    tables = langid.kneser_ney(counts, ["de", "en"], 10**6)
    seen = sorted(set(own["de"]) | set(own["en"]))
    grams = seen + ["xcat", "zzhu", "t sa", "  th", "und "]
    points = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    got = langid.log_probabilities(points, tables)
    known = {c for g in seen for c in g}
    for k, gram in enumerate(grams):
        for j, lang in enumerate(("de", "en")):
            if set(gram[-1:]) <= {c for g in own[lang] for c in g} and set(gram) <= known:
                assert got[k, j] == pytest.approx(brute_kneser_ney(own[lang], gram), abs=0.05 if gram in own[lang] else 0.35), (gram, lang)


def test_language_identification(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_no_n_gram_is_left_out(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(
        make_docs([(None, None), (9001, ""), (9002, "日本語の文 qqqq wxyz"), (9003, "日本語の文 qqqq wxyz")]).select("doc_id", "text", F.lit(None))
    )
    want = sorted(langid.identify(docs).collect(), key=str)
    for most in (1000, 0):
        got = sorted(langid.identify(docs, most).collect(), key=str)
        assert len(got) == len(want) > 200
        for a, b in zip(got, want):
            assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected)
            assert a.cross_entropy == pytest.approx(b.cross_entropy, abs=1e-4) and a.score == pytest.approx(b.score, abs=1e-3)


def test_language_edges(spark, make_docs):
    rows = [*ROWS, (20, "12 34 !!"), (21, "a"), (22, "日"), (23, "the dog")]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("doc_id") > 5, "en").when(F.col("doc_id") == 4, "de"))
    found = {}
    for r in langid.identify(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sorted(map(str, found)) == sorted({str(i) for i, _ in rows})
    for i, text in rows:
        lettered = any(c.isalpha() for c in text or "")
        assert all((r.lang_pred == "und") != lettered and (r.score > 0) == lettered for r in found[i])
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []
