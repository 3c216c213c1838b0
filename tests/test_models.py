"""Invariants of models, explanations and clusterings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.operators import explain as X
from creditspark.operators import models as M
from creditspark.operators import segment as G
from creditspark.operators.rows import stratified_split
from creditspark.sources.fixtures import credit_panel

COLS = ["LIMIT_BAL", "AGE", "PAY_0", "PAY_2"]


@pytest.fixture(scope="module")
def data(spark):
    df = credit_panel(spark, "/root/testdata/sf0.01").select("ID", *COLS, "target")
    return stratified_split(df, ["ID"], "target").cache()


@pytest.fixture(scope="module")
def model(data):
    return M.train_model(data, COLS, "target", "logistic_regression", reg=0.01, iterations=20)


def test_ensemble_is_the_mean(data, model):
    tree = M.train_model(data, COLS, "target", "random_forest", trees=5, depth=3)
    s = M.batch_predict(data, {"a": model, "b": tree}, COLS).limit(200).toPandas()
    assert s["probability"].to_numpy() == pytest.approx((s["p_a"] + s["p_b"]).to_numpy() / 2)
    votes = ((s["p_a"] > 0.5).astype(int) + (s["p_b"] > 0.5)) / 2
    assert s["prediction"].tolist() == (votes >= 0.5).astype(int).tolist()


def test_save_and_load(spark, data, model, tmp_path):
    M.save_models({"lr": model}, str(tmp_path))
    a = M.batch_predict(data, {"m": model}, COLS).agg(F.sum("probability")).first()[0]
    b = M.batch_predict(data, {"m": M.load_model(str(tmp_path), "lr")}, COLS).agg(F.sum("probability")).first()[0]
    assert a == pytest.approx(b)


def test_absent_and_null_features_count_as_zero(spark, model):
    df = spark.createDataFrame([(1, None, 30.0), (2, 0.0, 30.0)], "ID long, LIMIT_BAL double, AGE double")
    p = M.add_scores(df, {"m": model}, COLS).orderBy("ID").toPandas()["p_m"]
    assert p[0] == p[1]


def test_shapley_values_add_up(data, model):
    rows = data.where("ID < 60")
    score = X.scorer(model, COLS)
    s = X.sampled_shap(rows, "ID", COLS, score, X.background(data, ["ID"], COLS, 20), permutations=6).toPandas()
    p = score(rows).select("ID", "p").toPandas().set_index("ID")["p"]
    total = s.groupby("ID")["contribution"].sum() + s.groupby("ID")["base_value"].first()
    assert total.to_numpy() == pytest.approx(p.loc[total.index].to_numpy(), abs=1e-9)


def test_lime_recovers_a_linear_score(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "a": rng.normal(0, 2, 40), "b": rng.normal(1, 3, 40)}))
    score = lambda d: d.withColumn("p", 0.2 * F.col("a") - 0.5 * F.col("b"))
    got = X.lime(df, "id", ["a", "b"], score, samples=3000).toPandas()
    st = df.agg(F.stddev_pop("a"), F.stddev_pop("b")).first()
    w = got.pivot(index="id", columns="feature", values="weight").mean()
    assert w["a"] == pytest.approx(0.2 * st[0], rel=0.05) and w["b"] == pytest.approx(-0.5 * st[1], rel=0.05)


def test_permutation_importance_ignores_an_unused_column(data):
    score = lambda d: d.withColumn("p", F.col("PAY_0") / 10)
    got = {r["feature"]: r["importance"] for r in X.permutation_importance(data, ["ID"], ["PAY_0", "AGE"], "target", score, repeats=2).collect()}
    assert got["PAY_0"] > 0.05 and got["AGE"] == pytest.approx(0.0)


def test_interactions_of_an_additive_score_vanish(data):
    score = lambda d: d.withColumn("p", F.col("PAY_0") + 2 * F.col("AGE") + F.col("PAY_0") * F.col("PAY_2"))
    got = {(r[0], r[1]): r[2] for r in X.interactions(data, "ID", ["PAY_0", "PAY_2", "AGE"], score).collect()}
    assert got[("PAY_0", "PAY_2")] > 0.5 and got[("PAY_0", "AGE")] == pytest.approx(0.0, abs=1e-9)


def dbscan_by_hand(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= m
    label = np.full(len(x), -1)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = k
        while stack:
            for n in np.flatnonzero(d[stack.pop()]):
                if label[n] < 0:
                    label[n] = k
                    if core[n]:
                        stack.append(n)
        k += 1
    return label, core


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.3, (120, 2)), rng.normal(2.2, 0.4, (80, 2)), rng.uniform(-3, 5, (60, 2)), np.zeros((40, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    got = G.dbscan(df, "id", ["a", "b"], 0.3, 5).toPandas().sort_values("id")["cluster"].to_numpy()
    want, core = dbscan_by_hand(x, 0.3, 5)
    assert ((got == -1) == (want == -1)).all()
    pairs = {(g, w) for g, w in zip(got[core], want[core])}
    assert len(pairs) == len(set(got[core])) == len(set(want[core]))


def test_ward_merge_separates_two_blobs():
    c = np.array([[0.0, 0.0], [0.1, 0.0], [5.0, 5.0], [5.1, 5.0]])
    assert G.ward_merge(c, np.ones(4), 2).tolist() == [0, 0, 1, 1]


def test_cluster_indices_and_pca(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (50, 2)), rng.normal(8, 1, (50, 2))])
    lab = np.repeat([0, 1], 50)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(100), "a": x[:, 0], "b": x[:, 1], "cluster": lab}))
    idx = G.cluster_indices(df, ["a", "b"])
    m = np.array([x[lab == k].mean(0) for k in (0, 1)])
    w = sum(((x[lab == k] - m[k]) ** 2).sum() for k in (0, 1))
    b = sum(50 * ((m[k] - x.mean(0)) ** 2).sum() for k in (0, 1))
    s = [np.sqrt(((x[lab == k] - m[k]) ** 2).sum(1)).mean() for k in (0, 1)]
    assert idx["calinski_harabasz"] == pytest.approx(b / (w / 98))
    assert idx["davies_bouldin"] == pytest.approx(sum(s) / np.sqrt(((m[0] - m[1]) ** 2).sum()))
    p, share = G.pca_2d(df, ["a", "b"], ["id"])
    u, sv, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert sum(share) == pytest.approx(1.0)
    assert np.abs(p.toPandas().sort_values("id")["pc1"]).to_numpy() == pytest.approx(np.abs(u[:, 0] * sv[0]), abs=1e-6)


def test_counterfactual_reads_its_table_once(spark):
    rows = [(i, float(i * 7 % 40), float(i % 9), int(i % 5 == 0)) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "ID long, a double, b double, y int").mapInPandas(seen, "ID long, a double, b double, y int")
    got = X.counterfactual(df, "ID", ["a", "b"], "y").toPandas().sort_values("ID")
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d = (((x / x.std(axis=0))[:, None] - (x / x.std(axis=0))[None]) ** 2).sum(axis=2)[y == 1][:, y == 0]
    assert got["distance"].to_numpy() == pytest.approx(np.sqrt(d.min(axis=1)), abs=1e-12)
    at = np.searchsorted(np.flatnonzero(y == 0), got["neighbor"])
    assert d[np.arange(len(got)), at] == pytest.approx(d.min(axis=1), abs=1e-12)
    assert read.value == len(rows)
