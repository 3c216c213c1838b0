"""Parameter search by density ratio (tree-structured Parzen estimator).

The trials so far are split into the best tenth and the rest. Each parameter gets one
mixture of normals around its values in either part; of a few draws from the good mixture
the one is tried next whose density is largest in proportion to the other mixture.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np

Space = Mapping[str, tuple[float, float, str]]  # (low, high, kind): int, real or log

RANDOM_TRIALS, DRAWS, GOOD_SHARE, MOST_GOOD = 10, 24, 0.1, 25


def _scale(low: float, high: float, kind: str) -> tuple[float, float]:
    if kind == "int":
        return low - 0.5, high + 0.5
    return (math.log(low), math.log(high)) if kind == "log" else (low, high)


def _place(value: float, kind: str) -> float:
    return math.log(value) if kind == "log" else float(value)


def _value(at: float, low: float, high: float, kind: str) -> float:
    if kind == "int":
        return int(min(max(math.floor(at + 0.5), low), high))
    return min(max(math.exp(at) if kind == "log" else at, low), high)


def mixture(at: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centers and widths: one normal per value, as wide as its farther neighbor is away, and a flat one over the whole range."""
    span = high - low
    order = np.argsort(at, kind="stable")
    edges = np.concatenate([[low], at[order], [high]])
    width = np.empty(len(at))
    width[order] = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
    width = np.clip(width, span / min(100, len(at) + 2), span)
    return np.append(at, (low + high) / 2), np.append(width, span)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def log_density(x: np.ndarray, centers: np.ndarray, widths: np.ndarray, low: float, high: float) -> np.ndarray:
    """Log of the mixture's density, each normal cut to the range."""
    inside = _normal_cdf((high - centers) / widths) - _normal_cdf((low - centers) / widths)
    z = (x[:, None] - centers) / widths
    return np.log(np.mean(np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * widths * inside), axis=1))


def _draw(rng: np.random.Generator, centers: np.ndarray, widths: np.ndarray, low: float, high: float) -> np.ndarray:
    """Draws from the cut mixture: a normal is drawn again until it falls into the range."""
    which = rng.integers(len(centers), size=DRAWS)
    out = rng.normal(centers[which], widths[which])
    while (outside := (out < low) | (out > high)).any():
        out[outside] = rng.normal(centers[which[outside]], widths[which[outside]])
    return out


def propose(space: Space, history: Sequence[tuple[Mapping[str, float], float]], seed: int = 42) -> dict[str, float]:
    """Next parameters to try for the largest result; the same history and seed give the same proposal.

    The first ``RANDOM_TRIALS`` proposals are uniform. A trial without a result (not a number) is among the rest.
    """
    rng = np.random.default_rng([seed, len(history)])
    results = np.array([-math.inf if math.isnan(r) else r for _, r in history])
    best = np.argsort(-results, kind="stable")
    n_good = min(math.ceil(GOOD_SHARE * len(history)), MOST_GOOD)
    out = {}
    for name, (low, high, kind) in space.items():
        a, b = _scale(low, high, kind)
        if len(history) < RANDOM_TRIALS:
            out[name] = _value(rng.uniform(a, b), low, high, kind)
            continue
        at = np.array([_place(p[name], kind) for p, _ in history])
        good, rest = mixture(at[best[:n_good]], a, b), mixture(at[best[n_good:]], a, b)
        x = _draw(rng, *good, a, b)
        out[name] = _value(float(x[np.argmax(log_density(x, *good, a, b) - log_density(x, *rest, a, b))]), low, high, kind)
    return out
