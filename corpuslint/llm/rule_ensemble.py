"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on a bounded sample of labelled documents; every path of a tree is a rule, the conjunction of
its conditions. Rules get weights by logistic regression with a lasso penalty, which leaves few of them; the penalty is
the one with the best log-loss on a held-back fifth of the sample. The rules kept become one Spark column, so scoring
is a projection.

Null and empty texts have statistics of 0 and get a score like any other. A label counts once per doc_id (the mean of
repeated labels, 1 from one half on); null labels are left out. Without labels of both kinds every score is the share
of 1 among them, or 0.5 with none. Repeated rows and null ``doc_id`` are kept; other columns are not read; an empty
table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, smallest_hashes
from .text_stats import COUNTS, share, with_statistics
from .trees import boosted, paths

FEATURES = {
    "f_words": "CAST(n_words AS DOUBLE)",
    "f_mean_word": share("word_chars", "n_words"),
    "f_symbols": share("n_symbols", "n_words"),
    "f_dup_lines": share("n_dup_lines", "n_lines"),
    "f_repeats": share("n_repeat_words", "n_words"),
    "f_distinct": share("n_distinct_words", "n_words"),
    "f_upper": share("n_upper", "word_chars"),
    "f_digits": share("n_digits", "word_chars"),
    "f_bangs": share("n_bangs", "n_words"),
    "f_stops": share("n_stops", "n_words"),
    "f_same": share("n_same_neighbour", "n_words"),
    "f_long": share("n_long_words", "n_words"),
    "f_line": share("n_words", "n_lines"),
}
Rule = tuple[tuple[int, bool, float], ...]


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.empty((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        out[:, k] = np.all([(x[:, j] > cut) == above for j, above, cut in rule], axis=0)
    return out


def steepness(r: np.ndarray) -> float:
    """Bound of the logistic loss's curvature over the rules and the intercept."""
    return 0.25 * (float(np.linalg.eigvalsh(r.T @ r)[-1]) / len(r) + 1)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray], bound: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """Logistic regression with penalty * sum |weight|, by accelerated proximal gradients."""
    n = len(y)
    w = last = np.r_[start[1], start[0]].astype(np.float32)
    t = 1.0
    for _ in range(steps):
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = w + (t - 1) / t_next * (w - last)
        error = 1 / (1 + np.exp(-(r @ ahead[:-1] + ahead[-1]))) - y
        moved = ahead - np.r_[r.T @ error, error.sum()] / n / bound
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - penalty / bound, 0)
        w, last, t = moved.astype(np.float32), w, t_next
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 1) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return float(np.log(mean / (1 - mean))), []
    held = rng.random(len(y)) < 0.2
    rules = sorted({path for tree in boosted(x[~held], y[~held], trees, depth, 0.2, rng) for path in paths(tree)})
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    support = [float(np.all([(x[~held, j] > cut) == above for j, above, cut in rule], axis=0).mean()) for rule in rules]
    rules = [rule for rule, s in zip(rules, support, strict=True) if 0.002 < s < 0.998]
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    r, tried = rule_matrix(x[~held], rules), rule_matrix(x[held], rules)
    bound = steepness(r)
    model, best = (0.0, np.zeros(len(rules), np.float32)), (np.inf, None)
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        model = lasso(r, y[~held], penalty, model, bound)
        margin = tried @ model[1] + model[0]
        loss = float(np.mean(np.logaddexp(0, np.where(y[held] == 1, -margin, margin))))
        if loss < best[0] - 1e-4:
            best = (loss, model)
    bias, weights = best[1]
    return bias, [(float(w), rule) for w, rule in zip(weights, rules, strict=True) if abs(w) > 1e-6]


def score_column(bias: float, weighted: list[tuple[float, Rule]]) -> Column:
    """Probability of label 1 as a column over ``FEATURES``."""
    names = list(FEATURES)
    terms = [
        "CASE WHEN "
        + " AND ".join(f"{names[j]} {'>' if above else '<='} {cut!r}D" for j, above, cut in rule)
        + f" THEN {weight!r}D ELSE 0D END"
        for weight, rule in weighted
    ]
    return F.expr(f"1D / (1D + exp(-({' + '.join([f'{bias!r}D', *terms])})))")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7, most_labels: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash and the statistics.

    Learns from labels (doc_id, quality) whose id's remainder modulo 4 is not 2: of these the ``most_labels`` with the
    smallest hash of their id."""
    texts = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    stats = checkpointed(with_statistics(texts, "doc_id", "text_hash")).selectExpr(
        "doc_id", "text_hash", *COUNTS, *[f"{sql} AS {name}" for name, sql in FEATURES.items()]
    )
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y")
    ).filter(remainder("doc_id", 4) != 2)
    labelled = stats.select("doc_id", *FEATURES).join(known, "doc_id")
    sample = smallest_hashes(labelled, "doc_id", most_labels, *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in sample], float).reshape(len(sample), len(FEATURES))
    bias, rules = fit(x, np.array([r["y"] for r in sample], float))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return stats.withColumns({"held_out": held, "score": score_column(bias, rules)}).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"), "text_hash", *COUNTS
    )
