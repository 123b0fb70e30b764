"""Quality by weak supervision: rules vote or abstain, and a fitted model weighs the votes.

Each rule looks at statistics of the text and votes (bad or good, by rule) or abstains. Two kinds of documents are
assumed, good and bad, and every rule has a rate of voting on either; thresholds are those usual for web text and are not
fitted. Only the numbers of documents per pattern of votes leave the cluster (at most 2**len(RULES) rows, whatever the
input). Expectation-maximisation on them finds the share of good documents and all rates, and with them every rule's
accuracy, the share of its votes that are right; a rule that votes alike on both kinds weighs nothing. Nothing but the
start says which kind is the good one, and ``PSEUDO`` documents at the start's rates, however many there are in all. The
posterior probability of good is a sum of log-odds over votes and abstentions, compiled into a column, and decides alone
about documents that do not fail the base rules: one bad vote among good ones need not reject.

Null and empty texts have no words: all counts are 0. Texts with fewer than ``LEAST_WORDS`` words get no votes and are not
counted by the fit. Repeated rows and null ``doc_id`` are kept as they are; other columns are not read; an empty table
gives no rows."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed
from .text_stats import share, with_statistics

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS = 5
#: Rule: vote (1 good, -1 bad), condition. With fewer than ``LEAST_WORDS`` words all abstain.
RULES = {
    "symbols": (-1, f"{share('n_symbols', 'n_words')} >= 0.1"),
    "few_letters": (-1, f"{share('n_letters', 'word_chars')} <= 0.8"),
    "duplicate_lines": (-1, f"{share('n_dup_lines', 'n_lines')} >= 0.3"),
    "repeated_words": (-1, f"{share('n_repeat_words', 'n_words')} >= 0.3"),
    "few_distinct_words": (-1, f"{share('n_distinct_words', 'n_words')} <= 0.15"),
    "capitals": (-1, f"{share('n_upper', 'word_chars')} >= 0.4"),
    "exclamation": (-1, f"{share('n_bangs', 'n_words')} >= 0.2"),
    "same_neighbours": (-1, f"{share('n_same_neighbour', 'n_words')} >= 0.1"),
    "letters": (1, f"{share('n_letters', 'word_chars')} >= 0.9"),
    "sentences": (1, f"{share('n_stops', 'n_words')} BETWEEN 0.01 AND 0.5"),
    "word_length": (1, f"{share('word_chars', 'n_words')} BETWEEN 3 AND 10"),
    "fresh_words": (1, f"{share('n_repeat_words', 'n_words')} <= 0.05"),
}
#: Where the fit starts: share of good documents, and by a rule's vote how often it votes on good and on bad ones.
PRIOR, START, PSEUDO = 0.8, {1: (0.8, 0.4), -1: (0.02, 0.3)}, 10


def votes() -> dict[str, Column]:
    enough = F.col("n_words") >= LEAST_WORDS
    return {name: F.when(enough & F.expr(test), vote).otherwise(0) for name, (vote, test) in RULES.items()}


class Model(NamedTuple):
    """Share of good documents, and every rule's rate of voting on good and on bad ones."""

    prior: float
    good: list[float]
    bad: list[float]

    def accuracy(self) -> list[float]:
        """The share of every rule's votes that are right."""
        found = []
        for (vote, _), g, b in zip(RULES.values(), self.good, self.bad, strict=True):
            right = self.prior * g if vote == 1 else (1 - self.prior) * b
            found.append(right / (self.prior * g + (1 - self.prior) * b))
        return found


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 1000) -> Model:
    """Expectation-maximisation over numbers of documents per pattern of votes, until it stands still."""
    start = np.array([START[vote] for vote, _ in RULES.values()]).T
    prior, rates, n = PRIOR, start, np.array(list(patterns.values()), float)
    voted = np.array(list(patterns), float).reshape(len(n), len(RULES)) != 0
    for _ in range(rounds if n.sum() else 0):
        odds = np.log(prior / (1 - prior)) + voted @ np.log(rates[0] / rates[1]) + ~voted @ np.log((1 - rates[0]) / (1 - rates[1]))
        kinds = np.array([n, n]) * [1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))]
        sizes = kinds.sum(axis=1)
        before, last = rates, prior
        rates = (kinds @ voted + PSEUDO * start) / (sizes[:, None] + PSEUDO)
        prior = float((sizes[0] + PSEUDO * PRIOR) / (sizes.sum() + PSEUDO))
        if max(abs(prior - last), np.abs(rates - before).max()) < 1e-9:
            break
    return Model(prior, rates[0].tolist(), rates[1].tolist())


def posterior(model: Model) -> Column:
    """Probability of good from the vote columns."""
    score = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, g, b in zip(RULES, model.good, model.bad, strict=True):
        score += F.when(F.col(name) != 0, math.log(g / b)).otherwise(math.log((1 - g) / (1 - b)))
    return 1 / (1 + F.exp(-score))


def rate_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (posterior) and every rule's vote."""
    stats = checkpointed(with_statistics(docs, "doc_id").withColumns(votes()).select("doc_id", *BASE, *RULES))
    judged = stats.filter(F.col("n_words") >= LEAST_WORDS)
    counts = judged.groupBy(*RULES).agg(F.count("*").alias("n")).collect()
    model = fit({tuple(r[name] for name in RULES): r["n"] for r in counts})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "quality": posterior(model)}).select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"),
        "quality", *RULES,
    )
