"""Gradient-boosted trees on a small labelled sample: fitted with NumPy on the driver, scored as one SQL expression."""

from __future__ import annotations

import numpy as np

Tree = tuple  # (feature, cut, left, right) or (value,)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """(start, trees) of a logistic model; cuts are at values seen, x <= cut goes left."""
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), start), []
    cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
    cuts = [c if len(c) <= 32 else c[np.linspace(0, len(c) - 1, 32).astype(int)] for c in cuts]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> Tree:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level:
            for f, options in enumerate(cuts):
                column = x[rows, f]
                for cut in options:
                    left = column <= cut
                    n = left.sum()
                    if n < least or len(rows) - n < least:
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    if gain > best[0]:
                        best = (gain, (f, float(cut)))
        if best[1] is None:
            return (round(float(rate * gs / (hs + ridge)), 6),)
        f, cut = best[1]
        left = x[rows, f] <= cut
        return (f, cut, grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - q, q * (1 - q), depth)
        trees.append(tree)
        margin += predict_tree(tree, x)
    return start, trees


def predict_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, predict_tree(a, x), predict_tree(b, x))


def margins(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Log odds."""
    return model[0] + sum(predict_tree(t, x) for t in model[1])


def predict(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Probabilities."""
    return 1 / (1 + np.exp(-margins(model, x)))


def to_sql(model: tuple[float, list[Tree]], names: list[str]) -> str:
    """The margin (log odds) as SQL over columns of these names."""

    def one(tree: Tree) -> str:
        if len(tree) == 1:
            return f"{tree[0]!r}D"
        f, cut, a, b = tree
        return f"if({names[f]} <= {cut!r}D, {one(a)}, {one(b)})"

    return " + ".join([f"{model[0]!r}D", *map(one, model[1])])
