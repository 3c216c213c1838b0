"""Large-table paths must give what the simple ones give; both run on the same small rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.functions import ordering
from creditspark.functions.neighbors import nearest
from creditspark.functions.ordering import average_ranks, hash_rank, modes, quantile_dict, quantiles, running_totals
from creditspark.operators.evaluation import roc_auc
from creditspark.operators.kendall import kendall_tau
from creditspark.operators.profiling import spearman


def skewed(spark, n=4000):
    """A third of the rows share one value and one group."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.lognormal(2, 1, n), 3))
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "y": (rng.random(n) < 0.3).astype(int), "u": np.round(rng.random(n), 2)})


@pytest.mark.parametrize("octave,fine", [(4096, 4096), (1, 2)])
def test_quantiles_equal_numpy(spark, monkeypatch, octave, fine):
    """Also when coarse buckets need many rounds."""
    monkeypatch.setattr(ordering, "OCTAVE", octave)
    monkeypatch.setattr(ordering, "FINE", fine)
    pdf = skewed(spark, 1200)
    pdf["w"] = (pdf["v"] - 9) * 1e-7
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.31, 0.5, 0.75, 0.99, 1.0]
    grouped = {(r["g"], r["feature"], r["p"]): r["value"] for r in quantiles(df, ["v", "w"], probs, ["g"]).collect()}
    whole = quantile_dict(df, ["v", "w"], probs)
    assert len(grouped) == 4 * 2 * len(probs)
    for c in ("v", "w"):
        assert [whole[c][p] for p in probs] == pytest.approx(np.quantile(pdf[c], probs).tolist(), rel=1e-12, abs=1e-15)
        for g, part in pdf.groupby("g"):
            assert [grouped[g, c, p] for p in probs] == pytest.approx(np.quantile(part[c], probs).tolist(), rel=1e-12, abs=1e-15)


def test_quantiles_of_extreme_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -1.7e308, -1e-300, -0.0, 5e-324, 1e-300, 1.0, 1.0 + 2 ** -52, 1.7e308, 1.75e308, inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantile_dict(df, ["v"], [i / 10 for i in range(11)])["v"]
    assert [got[i / 10] for i in range(11)] == values
    last = quantile_dict(spark.createDataFrame([(1.0,), (nan,), (2.0,)], "v double"), ["v"], [0.0, 0.5, 1.0])["v"]
    assert (last[0.0], last[0.5]) == (1.0, 2.0) and np.isnan(last[1.0])


def test_quantiles_of_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), (None, 3.0), ("b", 2.0), ("b", None)], "g string, v double")
    assert {(r.g, r.value) for r in quantiles(df, ["v"], [0.5], ["g"]).collect()} == {(None, 2.0), ("a", None), ("b", 2.0)}
    assert quantile_dict(df.where("g = 'a'"), ["v"], [0.5]) == {"v": {0.5: None}}
    assert quantile_dict(df.where("false"), ["v"], [0.5]) == {"v": {0.5: None}}
    assert quantiles(df.where("false"), ["v"], [0.5], ["g"]).collect() == []


def test_many_quantiles_equal_numpy(spark):
    pdf = skewed(spark, 700)
    pdf.loc[::9, "u"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("u", F.when(~F.isnan("u"), F.col("u")))
    probs = [i / 200 for i in range(201)]
    got = quantile_dict(df, ["v", "u"], probs)
    for c in ("v", "u"):
        assert [got[c][p] for p in probs] == pytest.approx(np.nanquantile(pdf[c], probs).tolist())


@pytest.mark.parametrize("task_rows", [50, 10_000_000])
def test_running_totals(spark, task_rows):
    pdf = skewed(spark)
    counts = pdf.groupby("v").size().rename("n").reset_index()
    got = running_totals(spark.createDataFrame(counts), "v", ["n"], task_rows=task_rows).toPandas().sort_values("v")
    assert got["cum_n"].tolist() == counts.sort_values("v")["n"].cumsum().tolist()
    down = running_totals(spark.createDataFrame(counts), "v", ["n"], descending=True, task_rows=task_rows).toPandas().sort_values("v", ascending=False)
    assert down["cum_n"].tolist() == counts.sort_values("v", ascending=False)["n"].cumsum().tolist()


def test_hash_rank_is_a_permutation_and_ignores_partitioning(spark):
    df = spark.createDataFrame(skewed(spark))
    a = hash_rank(df, ["id"], ["g"], total="t").select("id", "g", "rank", "t").toPandas().sort_values("id")
    b = hash_rank(df.repartition(7), ["id"], ["g"]).select("id", "g", "rank").toPandas().sort_values("id")
    assert a["rank"].tolist() == b["rank"].tolist()
    for _, part in a.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
        assert set(part["t"]) == {len(part)}


@pytest.mark.parametrize("task_rows", [40, 10_000_000])
def test_rank_correlations(spark, task_rows):
    pdf = skewed(spark, 900)
    df = spark.createDataFrame(pdf)
    r = average_ranks(df, "v", "r", task_rows).toPandas().set_index("v")["r"]
    want = pdf["v"].rank()
    assert pdf["v"].map(r).tolist() == want.tolist()
    tau = kendall_tau(df, "v", "u", task_rows).first()["r"]
    x, y = pdf["v"].to_numpy(), pdf["u"].to_numpy()
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    assert tau == pytest.approx((sx * sy).sum() / np.sqrt((sx ** 2).sum() * (sy ** 2).sum()), abs=1e-12)
    assert spearman(df, "v", "u").first()["r"] == pytest.approx(np.corrcoef(want, pdf["u"].rank())[0, 1], abs=1e-12)


@pytest.mark.parametrize("task_rows", [5, 10_000_000])
def test_auc_equals_pair_count_and_spark_evaluator(spark, task_rows):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    pdf = skewed(spark, 600)
    df = spark.createDataFrame(pdf)
    pos, neg = pdf[pdf.y == 1]["u"].to_numpy(), pdf[pdf.y == 0]["u"].to_numpy()
    want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    got = roc_auc(df, "y", "u", task_rows=task_rows).first()["roc_auc"]
    assert got == pytest.approx(want, abs=1e-12)
    ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="u", numBins=0)
    assert got == pytest.approx(ev.evaluate(df.withColumn("y", F.col("y").cast("double"))), abs=1e-9)


def test_samples_ignore_partitioning(spark):
    from creditspark.operators.rows import sample_rows

    df = spark.createDataFrame(skewed(spark, 500))
    pick = lambda d: sorted(r["id"] for r in sample_rows(d, ["id"], 40).collect())
    assert pick(df) == pick(df.repartition(9)) and len(set(pick(df))) == 40


def test_correlation_matrix_is_symmetric(spark):
    from creditspark.operators.profiling import correlation_matrix, correlation_pairs, high_correlations

    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 4, 6, 8.5], "c": [4.0, 1, np.nan, 2]})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    pairs = correlation_pairs(df, ["a", "b", "c"])
    got = correlation_matrix(pairs, ["a", "b", "c"]).toPandas().set_index("feature").loc[["a", "b", "c"], ["a", "b", "c"]]
    assert got.to_numpy() == pytest.approx(pdf.corr().to_numpy())
    assert [(r["a"], r["b"]) for r in high_correlations(pairs, 0.9).collect()] == [("a", "b")]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (3, "a"), (1, None)], "n int, s string")
    got = {r["feature"]: r["value"] for r in modes(df, ["n", "s"]).collect()}
    assert got == {"n": "1", "s": "a"}


def test_nearest_equals_brute_force(spark, monkeypatch):
    import creditspark.functions.neighbors as nb

    monkeypatch.setattr(nb, "QUERY_BLOCK", 10)
    monkeypatch.setattr(nb, "CANDIDATE_BLOCK", 25)
    rng = np.random.default_rng(1)
    q, c = rng.integers(0, 9, (30, 3)).astype(float), rng.integers(0, 9, (80, 3)).astype(float)
    mk = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id long, x array<double>")
    got = nearest(mk(q), mk(c), 3).toPandas().sort_values(["query", "rank"])
    d = ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got["neighbor"].to_numpy().reshape(30, 3).tolist() == want.tolist()


def _brute(q, c, ids, k):
    ok = ~np.isnan(q)[:, None, :] & ~np.isnan(c)[None, :, :]
    d2 = np.where(ok, (q[:, None, :] - c[None, :, :]) ** 2, 0.0).sum(axis=2)
    used = ok.sum(axis=2)
    d2 = np.where(used > 0, d2 * (q.shape[1] / np.maximum(used, 1)), np.inf)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2))[:, :k]
    return ids[order], np.take_along_axis(d2, order, axis=1)


def _with_gaps(rng, n, share):
    x = np.concatenate([rng.integers(0, 12, (n, 2)), rng.integers(0, 1000, (n, 1))], axis=1).astype(float)
    x[rng.random(x.shape) < share] = np.nan
    return x


def test_search_compares_near_rows_only(monkeypatch):
    import creditspark.functions.neighbors as nb

    rng, pairs, distances = np.random.default_rng(4), [], nb.squared_distances
    q, c, ids = _with_gaps(rng, 400, 0.05), _with_gaps(rng, 20000, 0.01), rng.permutation(20000)
    monkeypatch.setattr(nb, "squared_distances", lambda a, b: pairs.append(len(a) * len(b)) or distances(a, b))
    near, far = nb.search(q, np.full(len(q), np.inf), c, ids, 3)
    want_near, want_far = _brute(q, c, ids, 3)
    found = np.isfinite(want_far)
    assert (np.isfinite(far) == found).all() and (near[found] == want_near[found]).all() and (far[found] == want_far[found]).all()
    assert sum(pairs) < 0.2 * len(q) * len(c)


def test_nearest_across_blocks_with_gaps_and_copies(spark, monkeypatch):
    import creditspark.functions.neighbors as nb

    rng = np.random.default_rng(5)
    q, c = _with_gaps(rng, 60, 0.1), _with_gaps(rng, 300, 0.1)
    c[200:] = c[7]  # many copies
    q[:20, 0], q[20] = np.nan, np.nan
    for name, size in (("QUERY_BLOCK", 9), ("CANDIDATE_BLOCK", 20), ("SAMPLE", 100), ("LEAF", 5)):
        monkeypatch.setattr(nb, name, size)
    mk = lambda m: spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(m)], "id long, x array<double>")
    got = nearest(mk(q), mk(c), 2).toPandas().sort_values(["query", "rank"])
    near, far = _brute(q, c, np.arange(300), 2)
    found = np.isfinite(far)
    assert got["query"].tolist() == np.repeat(np.arange(60), found.sum(axis=1)).tolist() and 20 not in set(got["query"])
    assert got["neighbor"].tolist() == near[found].tolist() and got["d2"].tolist() == far[found].tolist()
    assert nearest(mk(q), mk(c).limit(0)).count() == 0 and nearest(mk(q).limit(0), mk(c)).count() == 0
