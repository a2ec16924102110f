"""Small gradient-boosted trees: fitted in numpy on a bounded sample, applied as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    leaf = Node(value=float(grad.sum() / (hess.sum() + ridge)))
    if depth == 0 or len(grad) < 2 * least:
        return leaf
    base = grad.sum() ** 2 / (hess.sum() + ridge)
    best = (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        cuts = cuts[(cuts + 1 >= least) & (len(v) - cuts - 1 >= least)]
        if len(cuts) == 0:
            continue
        gain = g[cuts] ** 2 / (h[cuts] + ridge) + (g[-1] - g[cuts]) ** 2 / (h[-1] - h[cuts] + ridge) - base
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Node(
        feature=best[1], at=best[2],
        low=_grow(x[side], grad[side], hess[side], depth - 1, least, ridge),
        high=_grow(x[~side], grad[~side], hess[~side], depth - 1, least, ridge),
    )


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, _apply(node.low, x), _apply(node.high, x))


@dataclass
class Boosted:
    """Log-odds as a sum of trees."""

    prior: float
    trees: list[Node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The same log-odds as an expression; feature(j) gives the j-th input."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(feature(node.feature) <= F.lit(node.at), walk(node.low)).otherwise(walk(node.high))

        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Logistic gradient boosting with second-order leaf values."""
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    score = np.full(len(y), model.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, least, ridge)
        _scale(tree, rate)
        model.trees.append(tree)
        score += _apply(tree, x)
    return model


def _scale(node: Node, rate: float) -> None:
    if node.feature < 0:
        node.value *= rate
    else:
        _scale(node.low, rate)
        _scale(node.high, rate)
