"""Small decision trees on a bounded sample in driver memory, given back as plain nested tuples."""

from __future__ import annotations

import numpy as np

Node = tuple  # (feature, threshold, left, right) or (value,); left holds feature <= threshold


def thresholds(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Candidate split points of every feature: middles between neighbouring quantiles."""
    out = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((cuts[:-1] + cuts[1:]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)


def grow(codes: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, depth: int,
         least: float, rng: np.random.Generator, features: int | None = None, ridge: float = 1.0) -> Node:
    """A tree that fits ``target / weight``; ``features`` of them are tried at each split."""
    total, mass = float(target.sum()), float(weight.sum())
    leaf = (total / (mass + ridge),)
    if depth == 0 or len(target) < 2 * least:
        return leaf
    best, choice = 1e-9, None
    tried = range(codes.shape[1]) if features is None else rng.permutation(codes.shape[1])[:features]
    for j in tried:
        if not len(cuts[j]):
            continue
        size = len(cuts[j]) + 1
        n = np.bincount(codes[:, j], minlength=size).cumsum()[:-1]
        t = np.bincount(codes[:, j], target, size).cumsum()[:-1]
        w = np.bincount(codes[:, j], weight, size).cumsum()[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = t**2 / (w + ridge) + (total - t) ** 2 / (mass - w + ridge) - total**2 / (mass + ridge)
        gain[(n < least) | (len(target) - n < least)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = float(gain[k]), (int(j), k)
    if choice is None:
        return leaf
    j, k = choice
    left = codes[:, j] <= k
    sides = [
        grow(codes[s], cuts, target[s], weight[s], depth - 1, least, rng, features, ridge) for s in (left, ~left)
    ]
    return (j, float(cuts[j][k]), *sides)


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    j, cut, left, right = tree
    out, low = np.empty(len(x)), x[:, j] <= cut
    out[low], out[~low] = predict(left, x[low]), predict(right, x[~low])
    return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, rng: np.random.Generator) -> list[Node]:
    """Trees of a boosted logistic model."""
    cuts = thresholds(x)
    codes, margin, grown = binned(x, cuts), np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = rng.random(len(y)) < 0.5
        tree = grow(codes[part], cuts, (y - p)[part], (p * (1 - p))[part], depth, 10, rng)
        margin += rate * predict(tree, x)
        grown.append(tree)
    return grown


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> list[Node]:
    """Random forest: bootstrapped rows, a random third of the features at each split, leaves hold the share of 1."""
    cuts = thresholds(x)
    codes, grown = binned(x, cuts), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        some = max(1, x.shape[1] // 3)
        grown.append(grow(codes[rows], cuts, y[rows].astype(float), np.ones(len(y)), depth, 2, rng, some, ridge=0.0))
    return grown


def paths(tree: Node, so_far: tuple = ()) -> list[tuple]:
    """Every inner and outer node below the root as its conjunction of (feature, above, threshold)."""
    if len(tree) == 1:
        return [so_far] if so_far else []
    j, cut, left, right = tree
    found = [so_far] if so_far else []
    return found + paths(left, (*so_far, (j, False, cut))) + paths(right, (*so_far, (j, True, cut)))


def tree_sql(tree: Node, names: list[str]) -> str:
    """The tree as a SQL expression over the named features."""
    if len(tree) == 1:
        return f"{tree[0]!r}D"
    j, cut, left, right = tree
    return f"CASE WHEN {names[j]} <= {cut!r}D THEN {tree_sql(left, names)} ELSE {tree_sql(right, names)} END"
