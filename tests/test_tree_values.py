"""Tree contributions against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.functions.trees import Node, ensemble_paths, interaction_values, shapley_values
from creditspark.operators import explain as X
from creditspark.operators import models as M
from creditspark.sources.fixtures import credit_panel

COLS = ["LIMIT_BAL", "AGE", "PAY_0", "PAY_2", "BILL_AMT1"]


def random_tree(rng, d, depth):
    nodes = []

    def grow(rows, left):
        at = len(nodes)
        nodes.append(None)
        if left == 0 or rows < 2 or rng.random() < 0.15:
            nodes[at] = Node(at, -1, 0.0, -1, -1, rows, float(rng.normal()))
            return at
        n = int(rng.integers(1, rows))
        a, b = grow(n, left - 1), grow(rows - n, left - 1)
        nodes[at] = Node(at, int(rng.integers(d)), float(rng.normal()), a, b, rows, 0.0)
        return at

    grow(1000, depth)
    return nodes


def expected(nodes, x, known, at=0):
    n = nodes[at]
    if n.feature < 0:
        return n.value
    if n.feature in known:
        return expected(nodes, x, known, n.left if x[n.feature] <= n.threshold else n.right)
    return sum(nodes[c].rows / n.rows * expected(nodes, x, known, c) for c in (n.left, n.right))


def by_subsets(trees, x, d):
    game = {s: sum(expected(t, x, s) for t in trees) for k in range(d + 1) for s in map(frozenset, combinations(range(d), k))}
    phi, pair = np.zeros(d), np.zeros((d, d))
    for s, v in game.items():
        k = len(s)
        for i in set(range(d)) - s:
            phi[i] += factorial(k) * factorial(d - k - 1) / factorial(d) * (game[s | {i}] - v)
            for j in set(range(d)) - s - {i}:
                pair[i, j] += factorial(k) * factorial(d - k - 2) / (2 * factorial(d - 1)) * (game[s | {i, j}] - game[s | {i}] - game[s | {j}] + v)
    return phi, pair + np.diag(phi - pair.sum(axis=1))


@pytest.mark.parametrize("d, depth", [(1, 3), (3, 6), (6, 5)])
def test_equal_all_subsets(d, depth):
    rng = np.random.default_rng(d)
    trees = [random_tree(rng, d, depth) for _ in range(4)] + [[Node(0, -1, 0.0, -1, -1, 5, 0.25)]]
    x = rng.normal(size=(25, d))
    groups, base = ensemble_paths(trees)
    phi, pairs = shapley_values(x, groups), interaction_values(x, groups)
    assert base == pytest.approx(sum(expected(t, x[0], ()) for t in trees))
    for r in range(len(x)):
        one, two = by_subsets(trees, x[r], d)
        assert phi[r] == pytest.approx(one, abs=1e-12) and pairs[r] == pytest.approx(two, abs=1e-12)


def test_no_rows_and_values_that_are_no_numbers():
    tree = [Node(0, 0, 1.0, 1, 2, 10, 0.0), Node(1, -1, 0.0, -1, -1, 4, 1.0), Node(2, -1, 0.0, -1, -1, 6, 3.0)]
    groups, base = ensemble_paths([tree])
    assert base == pytest.approx(2.2) and shapley_values(np.zeros((0, 1)), groups).shape == (0, 1)
    assert shapley_values(np.array([[np.nan], [np.inf], [1.0]]), groups)[:, 0] == pytest.approx([0.8, 0.8, -1.2])


def test_many_rows_cost_no_more_products_than_patterns(monkeypatch):
    import creditspark.functions.trees as tr

    rng = np.random.default_rng(7)
    groups, _ = ensemble_paths([[n._replace(threshold=round(n.threshold, 1)) for n in random_tree(rng, 5, 7)] for _ in range(5)])
    x = np.round(rng.normal(size=(5000, 5)), 1)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[:3, 0] = np.inf, -np.inf, 0.1
    one_by_one = np.concatenate([shapley_values(x[r:r + 1], groups) for r in range(200)])
    work, product = [], tr._without_each
    monkeypatch.setattr(tr, "_without_each", lambda f: work.append(f.size) or product(f))
    got = shapley_values(x, groups)
    assert got[:200] == pytest.approx(one_by_one, abs=1e-12)
    m = [(p.feature.shape[1], len(p.value)) for p in groups]
    assert sum(work) <= sum(n * (k << k) * ((k - 1) // 2 + 1) for k, n in m)


@pytest.fixture(scope="module")
def data(spark):
    return credit_panel(spark, "/root/testdata/sf0.01").select("ID", *COLS, "target").cache()


@pytest.mark.parametrize("family, params", [("random_forest", {"trees": 8, "depth": 6}), ("gbt", {"rounds": 4, "depth": 4})])
def test_contributions_add_up_to_the_score(spark, data, family, params):
    model = M.train_model(data, COLS, "target", family, **params)
    trees = X.tree_nodes(spark, model)
    got = X.tree_shap(data, "ID", COLS, trees).groupBy("ID").agg((F.sum("contribution") + F.first("base_value")).alias("s")).toPandas().set_index("ID")["s"]
    p = M.add_scores(data, {"m": model}, COLS).select("ID", "p_m").toPandas().set_index("ID")["p_m"].loc[got.index].to_numpy()
    assert len(got) == data.count()
    assert got.to_numpy() == pytest.approx(p if family == "random_forest" else np.log(p / (1 - p)), abs=1e-9)
    few = data.where("ID < 200")
    one = X.tree_shap(few, "ID", COLS, trees).toPandas().set_index(["ID", "feature"])["contribution"]
    both = X.tree_interactions(few, "ID", COLS, trees).toPandas()
    total = both.groupby(["ID", "feature1"])["value"].sum()
    assert total.loc[one.index].to_numpy() == pytest.approx(one.to_numpy(), abs=1e-9)
    assert both.pivot(index=["ID", "feature1"], columns="feature2", values="value").shape == (few.count() * len(COLS), len(COLS))


def test_nulls_count_as_zero_and_absent_columns_raise(spark, data):
    tree = [Node(0, 0, 1.0, 1, 2, 10, 0.0), Node(1, -1, 0.0, -1, -1, 4, 1.0), Node(2, -1, 0.0, -1, -1, 6, 3.0)]
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 2.0)], "ID long, x double")
    got = {r["ID"]: r["contribution"] for r in X.tree_shap(df, "ID", ["x"], [tree]).collect()}
    assert got[1] == got[2] == pytest.approx(-1.2) and got[3] == pytest.approx(0.8)
    assert X.tree_shap(df.limit(0), "ID", ["x"], [tree]).count() == 0
    with pytest.raises(ValueError):
        X.tree_shap(df, "ID", ["y"], [tree])
    with pytest.raises(TypeError):
        X.tree_nodes(spark, M.train_model(data, COLS, "target", "logistic_regression", iterations=2))
