"""A small decision tree (CART with Gini impurity), fitted on a labelled table."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1):
    """A leaf (bool) or (feature, threshold, tree for <=, tree for >); ties go to the earliest feature and the lowest threshold."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return bool(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cuts = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if not cuts.any():
            continue
        p, q = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        impurity = np.where(cuts, n * p * (1 - p) + (len(y) - n) * q * (1 - q), np.inf)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-12:
            best = impurity[i], f, (v[i] + v[i + 1]) / 2
    if best is None:
        return bool(share >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, float(t), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row) -> bool:
    while tree is not True and tree is not False:
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree
