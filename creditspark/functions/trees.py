"""Exact Shapley values of tree ensembles, path by path.

Along the path to a leaf each feature j is followed by the explained row (o_j = 1), or it
is not (o_j = 0), and a share z_j of the training rows follows it. With the features S
known, the leaf counts with its value times the product of o over S and of z over the
rest of the path. The Shapley weights of that product are moments of t^k (1 - t)^(m-k),
so a leaf gives feature j

    value * (o_j - z_j) * integral over t in [0, 1] of prod_{i != j} (t o_i + (1 - t) z_i)

and the integral of a polynomial is exact by Gauss-Legendre nodes. A pair of features
leaves both out of the product.

A leaf's contributions depend on a row only by which of its m features follow the path. For
more rows than such patterns they are worked out once per pattern and looked up per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

CELLS = 1 << 20  # numbers in one block of rows x leaves x path features
ROWS = 4096  # looked up at once


class Node(NamedTuple):
    """A node of one tree; a leaf has feature -1. Rows with x[feature] <= threshold go left."""

    id: int
    feature: int
    threshold: float
    left: int
    right: int
    rows: float
    value: float


@dataclass(frozen=True)
class Paths:
    """Leaves whose paths hold the same number m of features, as arrays (leaves, m)."""

    feature: np.ndarray
    low: np.ndarray  # low < x <= high follows the path
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # (leaves,)


def _leaves(tree: dict[int, Node]) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = tree[at]
        if node.feature < 0:
            yield node.value, path
            continue
        low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
        left, right = tree[node.left], tree[node.right]
        todo.append((node.left, {**path, node.feature: (low, min(high, node.threshold), share * left.rows / node.rows)}))
        todo.append((node.right, {**path, node.feature: (max(low, node.threshold), high, share * right.rows / node.rows)}))


def ensemble_paths(trees: Iterable[Sequence[Node]]) -> tuple[list[Paths], float]:
    """Paths of all leaves by their number of features, and the value without any feature known."""
    groups: dict[int, list] = {}
    base = 0.0
    for nodes in trees:
        for value, path in _leaves({n.id: n for n in nodes}):
            base += value * float(np.prod([p[2] for p in path.values()]))
            groups.setdefault(len(path), []).append((value, path))
    out = []
    for m, leaves in sorted(groups.items()):
        if m:
            bounds = np.array([list(path.values()) for _, path in leaves], float)
            out.append(Paths(np.array([list(path) for _, path in leaves]), bounds[..., 0], bounds[..., 1], bounds[..., 2], np.array([v for v, _ in leaves])))
    return out, base


def _without_each(f: np.ndarray) -> np.ndarray:
    """Product of all but one along the last axis, without a division."""
    out = np.ones_like(f)
    for j in range(1, f.shape[-1]):
        out[..., j] = out[..., j - 1] * f[..., j - 1]
    after = np.ones(f.shape[:-1])
    for j in range(f.shape[-1] - 2, -1, -1):
        after = after * f[..., j + 1]
        out[..., j] *= after
    return out


def _blocks(x: np.ndarray, groups: Sequence[Paths]) -> Iterator[tuple[slice, Paths, np.ndarray]]:
    """(rows, paths, o) in blocks of bounded size; a number that is not one goes right, as in Spark's trees."""
    x = np.maximum(np.where(np.isnan(x), np.inf, x), np.finfo(float).min)
    for p in groups:
        m = p.feature.shape[1]
        n_leaves = max(1, min(len(p.value), 4096 // m))
        n_rows = max(1, CELLS // (n_leaves * m))
        for s in range(0, len(p.value), n_leaves):
            q = Paths(*(a[s:s + n_leaves] for a in (p.feature, p.low, p.high, p.share, p.value)))
            for r in range(0, len(x), n_rows):
                v = x[r:r + n_rows][:, q.feature]
                yield slice(r, r + n_rows), q, ((v > q.low) & (v <= q.high)).astype(float)


def _nodes(degree: int) -> Iterator[tuple[float, float]]:
    """Nodes and weights on [0, 1], exact for polynomials of this degree."""
    t, w = np.polynomial.legendre.leggauss(degree // 2 + 1)
    yield from zip((t + 1) / 2, w / 2)


def _leaf_values(o: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contributions per leaf and path feature; ``value`` has one axis less."""
    total = np.zeros(np.broadcast_shapes(o.shape, share.shape))
    for t, w in _nodes(o.shape[-1] - 1):
        total += w * _without_each(t * o + (1 - t) * share)
    return value[..., None] * (o - share) * total


def _leaf_tables(p: Paths) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features, low, high, table (leaves, patterns, m)) of leaves with the same path features, in blocks of bounded size."""
    m = p.feature.shape[1]
    order = np.argsort(p.feature, axis=1)
    feature, low, high, share = (np.take_along_axis(a, order, axis=1) for a in (p.feature, p.low, p.high, p.share))
    sets, of = np.unique(feature, axis=0, return_inverse=True)
    o = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    size = max(1, CELLS // (m << m))
    for i, features in enumerate(sets):
        at = np.flatnonzero(of.ravel() == i)
        for s in range(0, len(at), size):
            some = at[s:s + size]
            yield features, low[some], high[some], _leaf_values(o, share[some, None, :], p.value[some, None])


def _add_from_tables(out: np.ndarray, x: np.ndarray, p: Paths) -> None:
    """Add the contributions of the leaves ``p``: the pattern of a row and leaf is a sum of one bit per feature."""
    m = p.feature.shape[1]
    kind = np.min_scalar_type((1 << m) - 1)
    for features, low, high, table in _leaf_tables(p):
        codes, bins = [], []
        for i, f in enumerate(features):
            edges = np.unique(np.concatenate([low[:, i], high[:, i]]))
            edges = edges[np.isfinite(edges)]
            first = np.where(np.isneginf(low[:, i]), 0, np.searchsorted(edges, low[:, i]) + 1)
            at = np.arange(len(edges) + 1)[:, None]
            codes.append(((at >= first) & (at <= np.searchsorted(edges, high[:, i]))).astype(kind) << kind.type(i))
            bins.append(np.searchsorted(edges, x[:, f]))
        for r in range(0, len(x), ROWS):
            pattern = codes[0][bins[0][r:r + ROWS]]
            for code, b in zip(codes[1:], bins[1:]):
                pattern |= code[b[r:r + ROWS]]
            total, one = np.zeros((len(pattern), m)), np.empty((len(pattern), m))
            for values, at in zip(table, np.ascontiguousarray(pattern.T)):
                total += np.take(values, at, axis=0, out=one, mode="clip")
            out[r:r + ROWS, features] += total


def shapley_values(x: np.ndarray, groups: Sequence[Paths]) -> np.ndarray:
    """(rows, features): with the base value a row's contributions add up to its score."""
    out = np.zeros(x.shape)
    few = [p for p in groups if len(x) < 2 << p.feature.shape[1]]
    for rows, p, o in _blocks(x, few):
        part = _leaf_values(o, p.share, p.value)
        place = (p.feature.reshape(-1, 1) == np.arange(x.shape[1])).astype(float)
        out[rows] += part.reshape(len(o), -1) @ place
    x = np.where(np.isnan(x), np.inf, x)
    for p in groups:
        if len(x) >= 2 << p.feature.shape[1]:
            _add_from_tables(out, x, p)
    return out


def interaction_values(x: np.ndarray, groups: Sequence[Paths]) -> np.ndarray:
    """(rows, features, features): symmetric, each line adds up to the feature's Shapley value."""
    d = x.shape[1]
    out = np.zeros((len(x), d * d))
    for rows, p, o in _blocks(x, groups):
        m, gain = p.feature.shape[1], o - p.share
        for i in range(m):
            total = np.zeros_like(o)
            for t, w in _nodes(max(m - 2, 0)):
                f = t * o + (1 - t) * p.share
                f[..., i] = 1.0
                total += w * _without_each(f)
            part = p.value[:, None] * gain[..., i:i + 1] * gain * total / 2
            part[..., i] = 0.0
            place = ((p.feature[:, i:i + 1] * d + p.feature).reshape(-1, 1) == np.arange(d * d)).astype(float)
            out[rows] += part.reshape(len(o), -1) @ place
    out = out.reshape(len(x), d, d)
    out[:, np.arange(d), np.arange(d)] = shapley_values(x, groups) - out.sum(axis=2)
    return out
