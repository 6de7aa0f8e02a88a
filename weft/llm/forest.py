"""A small random forest for tables that fit in memory; prediction is vectorised over rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1: leaf
    limit: np.ndarray  # rows with feature <= limit go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # share of label 1


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(impurity, feature, limit) of the best split by Gini impurity; ties by feature, then limit."""
    best, n, ones = None, len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        a, b = c[:-1], ones - c[:-1]
        gini = np.where(ok, a * (k - a) / k + b * (n - k - b) / (n - k), np.inf)
        at = int(gini.argmin())
        if best is None or gini[at] < best[0]:
            best = (float(gini[at]), int(f), float((v[at] + v[at + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int) -> Tree:
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        at, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, at, at, share])
        if level and 0 < share < 1 and len(rows) >= 2 * least:
            found = _split(x[rows], y[rows], np.sort(rng.choice(x.shape[1], tries, replace=False)), least)
            if found:
                _, f, limit = found
                low = x[rows, f] <= limit
                nodes[at][:4] = f, limit, add(rows[low], level - 1), add(rows[~low], level - 1)
        return at

    add(rng.integers(0, len(y), len(y)), depth)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 10, least: int = 3, seed: int = 7) -> list[Tree]:
    """Bootstrap trees that try sqrt(features) at each split; equal for equal arguments."""
    rng = np.random.default_rng(seed)
    return [grow(x, y, rng, depth, least, max(1, int(np.sqrt(x.shape[1]) + 0.5))) for _ in range(trees)]


def predict(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean share of label 1 over the trees for each row."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = t.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= t.limit[at]
            at = np.where(inner, np.where(low, t.left[at], t.right[at]), at)
        total += t.value[at]
    return total / max(len(forest), 1)
