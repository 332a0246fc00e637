"""Gradient-boosted trees on histograms, and isotonic calibration, for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees of a model in flat arrays. A leaf points at itself, so a walk of fixed depth ends."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                down = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smooth: float = 1.0,
    least: int = 5,
) -> Trees:
    """Boosted trees for the logistic loss; splits are sought on ``bins`` quantiles per feature.

    With no rows the model is the constant 0.5; with one class, that class smoothed by one row each.
    """
    n, width = x.shape
    rate_of_ones = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []

    def node() -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    if n == 0 or y.min() == y.max():
        roots.append(node())
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if trees else []
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if trees else None
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        at = np.full(n, root)
        level = [root]
        for d in range(depth + 1):
            index = {k: s for s, k in enumerate(level)}
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            of = slot[at]
            live = of >= 0
            g = np.bincount(of[live], grad[live], len(level))
            h = np.bincount(of[live], hess[live], len(level))
            for k, s in index.items():
                value[k] = rate * g[s] / (h[s] + smooth)
            if d == depth:
                break
            best = np.full(len(level), 1e-6)
            choice: list[tuple[int, int] | None] = [None] * len(level)
            for j in range(width):
                cells = len(edges[j]) + 1
                if cells < 2:
                    continue
                key = of[live] * cells + binned[live, j]
                shape, size = (len(level), cells), len(level) * cells
                gs = np.bincount(key, grad[live], size).reshape(shape).cumsum(axis=1)[:, :-1]
                hs = np.bincount(key, hess[live], size).reshape(shape).cumsum(axis=1)[:, :-1]
                ns = np.bincount(key, minlength=size).reshape(shape).cumsum(axis=1)
                total = ns[:, -1:]
                ns = ns[:, :-1]
                gain = gs**2 / (hs + smooth) + (g[:, None] - gs) ** 2 / (h[:, None] - hs + smooth)
                gain -= (g**2 / (h + smooth))[:, None]
                gain[(ns < least) | (total - ns < least)] = -1
                cut = gain.argmax(axis=1)
                top = gain[np.arange(len(level)), cut]
                for s in np.flatnonzero(top > best):
                    best[s], choice[s] = top[s], (j, int(cut[s]))
            following = []
            for k, s in index.items():
                if choice[s] is None:
                    continue
                j, cut_at = choice[s]
                feature[k], threshold[k] = j, float(edges[j][cut_at])
                left[k], right[k] = node(), node()
                rows = np.flatnonzero(at == k)
                down = binned[rows, j] <= cut_at
                at[rows[down]], at[rows[~down]] = left[k], right[k]
                following += [left[k], right[k]]
            if not following:
                break
            level = following
        margin += np.array(value)[at]
    return Trees(
        np.array(feature, np.int64),
        np.array(threshold),
        np.array(left, np.int64),
        np.array(right, np.int64),
        np.array(value),
        np.array(roots, np.int64),
        depth,
        base,
    )


@dataclass(frozen=True)
class Isotonic:
    """Rising steps from raw scores to probabilities, joined by straight lines."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.to), 0, 1) if len(self.at) else score


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; with fewer than two rows or one class, scores stay as they are."""
    if len(y) < 2 or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    at, first = np.unique(score, return_inverse=True)
    weight = np.bincount(first).astype(float)
    mean = np.bincount(first, y) / weight
    blocks: list[list[float]] = []  # mean, weight, values
    for m, w in zip(mean, weight):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, k2 = blocks.pop()
            m1, w1, k1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return Isotonic(at, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks]))
