"""Gradient-boosted trees over sparse yes/no features, small enough to travel with a task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting; a tree node asks for one feature. Leaves are numbers, inner nodes (feature, with, without)."""

    trees: list = field(default_factory=list)
    base: float = 0.0
    rate: float = 0.3

    @staticmethod
    def _grow(rows: np.ndarray, feats: np.ndarray, live: np.ndarray, g: np.ndarray, h: np.ndarray, names: list[str], depth: int, raw: np.ndarray, rate: float, n: np.ndarray, penalty: float = 1.0):
        """A tree over the live rows; (rows, feats) are the set cells of the live part of the matrix, n the weights. Leaves add to raw."""
        total_g, total_h = g[live].sum(), h[live].sum()
        leaf = float(-total_g / (total_h + penalty))
        if depth and n[live].sum() >= 8 and len(rows):
            gw = np.bincount(feats, weights=g[rows], minlength=len(names))
            hw = np.bincount(feats, weights=h[rows], minlength=len(names))
            score = lambda a, b: a * a / (b + penalty)
            gain = score(gw, hw) + score(total_g - gw, total_h - hw) - score(total_g, total_h)
            best = int(np.argmax(gain))
            if gain[best] >= 1e-3:
                has = np.zeros(len(g), dtype=bool)
                has[rows[feats == best]] = True
                cell, node = has[rows], has[live]
                down = lambda c, at: BoostedTrees._grow(rows[c], feats[c], live[at], g, h, names, depth - 1, raw, rate, n, penalty)
                return (names[best], down(cell, node), down(~cell, ~node))
        raw[live] += rate * leaf
        return leaf

    @classmethod
    def fit(cls, rows: Sequence[Sequence[str]], labels: Sequence[int], weights: Sequence[int] | None = None, rounds: int = 60, depth: int = 4, features: int = 1500) -> BoostedTrees:
        """Fit on rows of feature names; of those in three rows or more the most frequent take part, at most as many as features says. Deterministic.

        A row of weight n counts as n equal rows.
        """
        n = np.ones(len(rows)) if weights is None else np.asarray(weights, dtype=np.float64)
        seen: Counter[str] = Counter()
        for r, k in zip(rows, n.tolist()):
            for f in set(r):
                seen[f] += k
        names = [f for f, k in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0])) if k >= 3][:features]
        at = {f: i for i, f in enumerate(names)}
        cells = [(i, at[f]) for i, r in enumerate(rows) for f in sorted(set(r)) if f in at]
        row_of = np.array([i for i, _ in cells], dtype=np.int64)
        feat_of = np.array([j for _, j in cells], dtype=np.int64)
        y = np.asarray(labels, dtype=np.float64)
        mean = min(max(float((n * y).sum() / n.sum()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        model = cls(base=float(np.log(mean / (1 - mean))))
        raw = np.full(len(rows), model.base)
        live = np.arange(len(rows))
        for _ in range(rounds if names and len(set(labels)) > 1 else 0):
            p = 1 / (1 + np.exp(-raw))
            model.trees.append(cls._grow(row_of, feat_of, live, n * (p - y), n * p * (1 - p), names, depth, raw, model.rate, n))
        return model

    def asked(self) -> frozenset[str]:
        """The features that any node asks for; no other bears on a score."""
        out: set[str] = set()
        open_ = list(self.trees)
        while open_:
            if isinstance(node := open_.pop(), tuple):
                out.add(node[0])
                open_ += node[1:]
        return frozenset(out)

    def score(self, row: Sequence[str]) -> float:
        """Probability of a row of feature names."""
        have = set(row)
        raw = self.base
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[1] if tree[0] in have else tree[2]
            raw += self.rate * tree
        return float(1 / (1 + np.exp(-raw)))
