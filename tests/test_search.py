"""Proposals of the parameter search against a plain version and against random draws."""

import math
import random

import numpy as np
import pytest

from creditspark.functions import search as S
from creditspark.operators import models as M
from creditspark.sources.fixtures import credit_panel

SPACE = {"x": (-5.0, 5.0, "real"), "k": (1, 20, "int"), "c": (0.01, 100.0, "log")}


def target(p):
    return -(p["x"] - 1.5) ** 2 - 0.05 * (p["k"] - 14) ** 2 - 0.5 * (math.log10(p["c"]) + 1) ** 2


def run(n, seed, choose):
    history = []
    for _ in range(n):
        p = choose(history, seed)
        history.append((p, target(p)))
    return history


def plain_density(x, values, low, high):
    """The mixture written out: one cut normal per value and one over the whole range."""
    total, span, known = 0.0, high - low, sorted(values)
    parts = [((low + high) / 2, span)]
    for i, v in enumerate(known):
        left, right = ([low] + known)[i], (known + [high])[i + 1]
        parts.append((v, min(max(v - left, right - v, span / min(100, len(known) + 2)), span)))
    for m, s in parts:
        cut = 0.5 * (math.erf((high - m) / s / math.sqrt(2)) - math.erf((low - m) / s / math.sqrt(2)))
        total += math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * cut)
    return total / len(parts)


def test_densities_equal_the_plain_version_and_add_up_to_one():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 150):
        values = np.round(rng.uniform(-2, 3, n), 1)  # with ties
        x = np.linspace(-2, 3, 4001)
        got = np.exp(S.log_density(x, *S.mixture(values, -2, 3), -2, 3))
        assert got[::400] == pytest.approx([plain_density(v, values.tolist(), -2, 3) for v in x[::400]], rel=1e-9)
        assert np.trapezoid(got, x) == pytest.approx(1.0, abs=1e-4)


def test_proposals_repeat_stay_in_range_and_follow_the_ratio():
    history = run(30, 3, lambda h, s: S.propose(SPACE, h, s))
    assert history == run(30, 3, lambda h, s: S.propose(SPACE, h, s))
    for p, _ in history:
        assert -5 <= p["x"] <= 5 and 0.01 <= p["c"] <= 100 and p["k"] in range(1, 21) and isinstance(p["k"], int)
    order = sorted(range(30), key=lambda i: -history[i][1])
    good, rest = ([history[i][0]["x"] for i in part] for part in (order[:3], order[3:]))
    ratio = lambda v: plain_density(v, good, -5, 5) / plain_density(v, rest, -5, 5)
    draws = S._draw(np.random.default_rng([3, 30]), *S.mixture(np.array([history[i][0]["x"] for i in order[:3]]), -5, 5), -5, 5)
    assert S.propose(SPACE, history, 3)["x"] == pytest.approx(max(draws, key=ratio))


def test_better_than_random_draws():
    def uniform(history, seed):
        rng = random.Random(1000 * seed + len(history))
        return {"x": rng.uniform(-5, 5), "k": rng.randint(1, 20), "c": 10 ** rng.uniform(-2, 2)}

    found = [[max(r for _, r in run(50, seed, choose)) for seed in range(20)] for choose in (lambda h, s: S.propose(SPACE, h, s), uniform)]
    assert np.median(found[0]) > np.median(found[1]) and np.mean(found[0]) > np.mean(found[1])


def test_equal_and_missing_results():
    history = [({"x": float(i % 3)}, math.nan if i % 4 == 0 else 0.0) for i in range(15)]
    assert -5 <= S.propose({"x": SPACE["x"]}, history)["x"] <= 5


def test_tune_by_proposals_and_by_list(spark):
    cols = ["LIMIT_BAL", "AGE", "PAY_0"]
    df = credit_panel(spark, "/root/testdata/sf0.001").select("ID", *cols, "target")
    trials, best = M.tune(df, cols, "target", "logistic_regression", ["ID"], trials=12)
    t = trials.toPandas()
    assert t["trial"].tolist() == list(range(12)) and str(best) == t.loc[t["mean_auc"].idxmax(), "params"]
    again, _ = M.tune(df, cols, "target", "logistic_regression", ["ID"], trials=1, sampler="random")
    assert again.count() == 1
    listed, chosen = M.tune(df, cols, "target", "random_forest", ["ID"], params=[{"trees": 2, "depth": 2}], folds=2)
    assert chosen == {"trees": 2, "depth": 2} and listed.count() == 1
    with pytest.raises(ValueError):
        M.tune(df, cols, "target", "gbt", ["ID"], trials=0)
