"""Hand-computed cases for the rules that are easy to get wrong."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.functions import expr as E
from creditspark.operators import clean, columns, encode, evaluation, fairness, features, profiling, rows, scoring, selection, series, validation
from creditspark.operators import portfolio
from creditspark.operators import text as text_lists


def one(df):
    return df.first()[0]


def values(df, c):
    return [r[c] for r in df.collect()]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0,), (30,), (31,), (100,), (101,)], "a int")
    assert values(df.select(E.bin_fixed("a", [0, 30, 40, 50, 100]).alias("b")), "b") == [None, 1, 2, 4, None]
    pdf = pd.DataFrame({"x": np.array([0.0, 1.0, 2.5, 5.0, 7.5, 10.0])})
    got = values(spark.createDataFrame(pdf).select(E.bin_by_edges("x", E.equal_width_edges(0.0, 10.0, 4)).alias("b")), "b")
    assert got == (pd.cut(pdf["x"], 4, labels=False) + 1).tolist()


def test_bands_own_their_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (None,)], "p double")
    assert values(df.select(E.risk_band("p").alias("b")), "b") == ["Medium Risk", "Medium Risk", "High Risk", None]
    assert values(df.select(E.risk_band("p", "composite").alias("b")), "b") == ["Low", "Medium", "High", None]


def test_format_values(spark):
    df = spark.createDataFrame([(1234.5,), (-5.0,), (None,)], "v double")
    assert values(df.select(E.format_value("v", "currency").alias("t")), "t") == ["$1,234.50", "$-5.00", "N/A"]
    x = [65050.0, 1e-7, -0.000123, 1.5e25]
    got = values(spark.createDataFrame([(v,) for v in x], "v double").select(E.format_value("v", "scientific").alias("t")), "t")
    assert got == [f"{v:.2e}" for v in x]
    sizes = spark.createDataFrame([(0,), (1536,), (5 * 1024 ** 3,)], "v long")
    assert values(sizes.select(E.format_bytes("v").alias("t")), "t") == ["0 B", "1.5 KB", "5.0 GB"]


def test_safe_divide_and_row_std(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (4.0, 2.0, 6.0)], "a double, b double, c double")
    assert values(df.select(E.safe_divide("a", "b").alias("r")), "r") == [0.0, 2.0]
    got = values(df.select(E.row_std(["a", "b", "c"]).alias("s")), "s")
    assert got == pytest.approx([np.std([1, 0], ddof=1), np.std([4, 2, 6], ddof=1)])


def test_composite_renormalizes_over_present_parts(spark):
    df = spark.createDataFrame([(750, None, None, None, None, None), (None,) * 6],
                               "credit_score int, debt_to_income double, income double, employment_length double, age int, loan_amount double")
    got = scoring.composite_risk(df).collect()
    assert got[0]["composite_score"] == pytest.approx(0.1)
    assert got[1]["composite_score"] == 0.0


def test_score_distribution_drops_zero(spark):
    df = spark.createDataFrame([(0,), (40,), (41,), (70,), (100,)], "risk_score int")
    got = {r["band"]: r["n"] for r in scoring.score_distribution(df).collect()}
    assert got == {"Low": 1, "Medium": 2, "High": 1}


def test_skew_and_kurtosis_equal_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, 3.0, 14.0, 5.0]})
    r = profiling.column_stats(spark.createDataFrame(pdf), ["x"]).first()
    assert r["skewness"] == pytest.approx(pdf["x"].skew())
    assert r["kurtosis"] == pytest.approx(pdf["x"].kurt())
    assert r["mode"] == 2.0 and r["median"] == 2.5


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "a int, b string")
    assert profiling.duplicate_count(df).first()["duplicates"] == 3
    assert profiling.drop_duplicates(df, ["a"], ["b"]).count() == 2


def test_outliers_planted_are_found(spark):
    df = spark.createDataFrame([(x,) for x in [25, 30, 35, 40, 45, 50, 55, 150, 5, 38]], "age int")
    assert clean.outlier_flags(df, ["age"]).agg(F.sum("age_outlier")).first()[0] == 1
    capped = clean.handle_outliers(df, ["age"]).agg(F.max("age")).first()[0]
    q1, q3 = np.percentile([25, 30, 35, 40, 45, 50, 55, 150, 5, 38], [25, 75])
    assert capped == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_impute_auto_drops_and_fills(spark):
    df = spark.createDataFrame([(1, 1.0, "x", None), (2, None, None, None), (3, 4.0, "x", 1.0), (4, 6.0, "y", None)],
                               "id int, v double, s string, mostly double")
    out = clean.impute_auto(df)
    assert out.columns == ["id", "v", "s"]
    assert values(out.orderBy("id"), "v") == [1.0, 4.0, 4.0, 6.0]
    assert values(out.orderBy("id"), "s") == ["x", "x", "x", "y"]


def test_whole_number_columns_keep_fractional_fill(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert values(clean.impute(df, "median").orderBy("v"), "v") == [1.0, 1.5, 2.0]


def test_scalers(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 10.0], "c": [5.0] * 4})
    df = spark.createDataFrame(pdf)
    got = encode.scale(df, "standard").toPandas()
    assert got["x"].tolist() == pytest.approx(((pdf["x"] - pdf["x"].mean()) / pdf["x"].std(ddof=0)).tolist())
    assert encode.scale(df, "minmax").toPandas()["c"].tolist() == [0.0] * 4
    z = encode.scale(spark.createDataFrame(pd.DataFrame({"x": np.arange(101.0)})), "quantile").toPandas()["x"].sort_values().tolist()
    assert z[50] == pytest.approx(0.0, abs=1e-9) and z[75] == pytest.approx(0.6744897501960817, abs=1e-8)
    assert encode.inverse_normal(np.array([0.001, 0.975])) == pytest.approx([-3.090232306167813, 1.959963984540054], rel=1e-8)


def test_onehot_drops_first_and_ignores_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    out = encode.encode_onehot(df, ["s"])
    assert out.columns == ["s_b", "s_missing"]
    fitted = encode.encode_onehot(spark.createDataFrame([("z",)], "s string"), ["s"], {"s": ["a", "b"]})
    assert values(fitted, "s_b") == [0.0]


def test_sparse_onehot_of_any_number_of_levels(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('v', id) END AS s", "concat('t', id % 3) AS t", "'one' AS o")
    levels = encode.onehot_levels(df, ["s", "t", "o"]).cache()
    names = sorted({"missing", *(f"v{i}" for i in range(3000) if i % 7)})
    place = {v: i - 1 for i, v in enumerate(names)}

    def wanted(i):
        one = place["missing" if i % 7 == 0 else f"v{i}"]
        return [p for p in (one, len(names) - 1 + i % 3 - 1 if i % 3 else -1) if p >= 0]

    assert {r.id: r.onehot for r in encode.encode_onehot_sparse(df, ["s", "t", "o"], levels).collect()} == {i: wanted(i) for i in range(3000)}
    vectors = encode.onehot_vector(df, ["s", "t", "o"], levels).where("id < 50").collect()
    assert all(v.onehot.size == len(names) + 1 and v.onehot.indices.tolist() == wanted(v.id) and set(v.onehot.values) <= {1.0} for v in vectors)
    new = spark.createDataFrame([(1, "never seen", None, "one")], "id long, s string, t string, o string")
    assert encode.encode_onehot_sparse(new, ["s", "t", "o"], levels).first().onehot == []
    assert encode.onehot_vector(new, ["s", "t", "o"], levels).first().onehot.numNonzeros() == 0
    none = df.limit(0)
    assert encode.encode_onehot_sparse(none, ["s", "t"]).columns == ["id", "o", "onehot"] and encode.encode_onehot_sparse(none, ["s", "t"]).count() == 0


def test_label_codes_of_many_values(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "s string")
    want = {"a": 0, "b": 1, "c": 2}
    assert {r["s"]: r["s_code"] for r in encode.encode_label(df, "s").collect()} == want


def test_label_codes_follow_the_order_over_many_ranges(spark):
    df = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("value"), "id").repartition(7)
    df = df.unionByName(spark.createDataFrame([(None, None)], "value string, id long"))
    got = encode.encode_label(df, "value")
    assert got.columns == ["value", "id", "value_code"] and dict(got.dtypes)["value_code"] == "bigint"
    assert got.where("NOT (id <=> value_code)").count() == 0 and got.count() == 3001
    assert encode.label_codes(df.limit(0), "value").count() == 0


def test_psi_of_itself_is_zero(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    assert selection.psi(df, df).first()["psi"] == pytest.approx(0.0)
    moved = selection.psi(df, df.select((F.col("x") + 100).alias("x"))).first()
    assert moved["unstable"]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = features.polynomial(df, ["a", "b"])
    assert out.columns == ["a", "b", "a^2", "a b", "b^2"] and out.first()["a b"] == 6.0
    assert features.polynomial(df, ["a", "b"], interaction_only=True).columns == ["a", "b", "a b"]


def test_moving_windows_follow_pandas(spark):
    pdf = pd.DataFrame({"period": pd.date_range("2020-01-01", periods=30, freq="MS"), "value": np.arange(30.0) ** 1.5})
    df = spark.createDataFrame(pdf)
    got = series.centered_trend(series.moving_average(df, window=7)).orderBy("period").toPandas()
    assert got["moving_avg"].tolist() == pytest.approx(pdf["value"].rolling(7).mean().tolist(), nan_ok=True)
    assert got["trend"].tolist() == pytest.approx(pdf["value"].rolling(12, center=True).mean().tolist(), nan_ok=True)
    f = series.linear_forecast(df, horizon=3).orderBy("step").toPandas()
    assert [str(d) for d in f["date"]] == ["2022-07-31", "2022-08-31", "2022-09-30"]
    k, b = np.polyfit(np.arange(30), pdf["value"], 1)
    assert f["forecast"].tolist() == pytest.approx([b + k * (30 + i) for i in range(3)])
    assert series.linear_forecast(df.limit(5)).count() == 0


def test_growth_pads_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 15.0)], "period int, value double")
    assert values(series.growth(df).orderBy("period"), "growth_rate") == [None, 0.0, 50.0]


def test_chi_square_uses_the_correction_for_two_by_two(spark):
    cells = spark.createDataFrame([("a", 1, 10), ("a", 0, 20), ("b", 1, 30), ("b", 0, 5)], "g string, y int, n int")
    r = fairness.chi_square(cells, [], "g", "y").first()
    o = np.array([[10.0, 20.0], [30.0, 5.0]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert r["chi_square"] == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum()) and r["dof"] == 1
    assert fairness.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert fairness.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert fairness.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)


def test_metrics_are_zero_on_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = evaluation.binary_metrics(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1_score"], r["accuracy"], r["matthews_corrcoef"]) == (0.0, 0.0, 0.0, 1.0, 0.0)


def test_threshold_sweep_equals_direct_counts(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(200), np.linspace(0, 1, 100)])
    y = (rng.random(300) < p).astype(int)
    got = evaluation.threshold_sweep(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").orderBy("step").toPandas()
    for t, pr, rc in zip(got["threshold"], got["precision"], got["recall"]):
        hit = p >= t
        mixed = 0 < hit.sum() < len(p)
        assert pr == pytest.approx((y[hit].sum() / hit.sum()) if mixed else 0.0)
        assert rc == pytest.approx((y[hit].sum() / y.sum()) if mixed else 0.0)


def test_split_keeps_class_shares(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "id int, y int")
    got = {(r["y"], r["split"]): r["count"] for r in rows.stratified_split(df, ["id"], "y").groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 80, (0, "validation"): 80, (0, "train"): 240, (1, "test"): 20, (1, "validation"): 20, (1, "train"): 60}


def test_class_balance(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(100)], "id int, y int")
    for method, n in (("under", 15), ("over", 85)):
        assert {r["count"] for r in rows.class_balance(df, ["id"], "y", method).groupBy("y").count().collect()} == {n}
    w = rows.class_balance(df, ["id"], "y", "weight").groupBy("y").agg(F.sum("weight").alias("w"))
    assert values(w, "w") == pytest.approx([50.0, 50.0])


def test_missing_markers_and_names(spark):
    df = spark.createDataFrame([(-999, "N/A", float("nan")), (5, "x", 1.0)], "a int, b string, c double")
    assert columns.missing_markers(df).first() == (None, None, None)
    messy = spark.createDataFrame([(1, 2)], "`Customer ID` int, `Credit-Score` int")
    assert columns.normalize_column_names(messy).columns == ["customer_id", "credit_score"]
    with pytest.raises(ValueError):
        columns.normalize_column_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_validation_reports(spark):
    df = spark.createDataFrame([("17", "a@b.co", "+15551234567"), ("abc", "bad", "12")], "age string, mail string, tel string")
    got = validation.row_rules(df, "mail", "tel", age="age").select("valid_email", "valid_phone", "valid_age").collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False)]
    ranges = {r["check"]: r["n"] for r in validation.validate_ranges(df, {"age": (18, 100)}).collect()}
    assert ranges == {"age:below": 1, "age:above": 0, "age:not_numeric": 1}
    good, bad = validation.split_valid(df, {"age": "int"})
    assert (good.count(), bad.count()) == (1, 1)
    names = {tuple(r) for r in validation.schema_match(df, ["age", "income"]).collect()}
    assert names == {("missing", "income", 0), ("extra", "mail", 2), ("extra", "tel", 2)}


def test_utc_dates(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31),)], "d timestamp")
    assert str(one(df.select(E.month_end("d", 1)))) == "2024-02-29"
    assert one(df.select(E.month_difference(F.lit("2025-03-01").cast("date"), "d"))) == 14


def test_feature_pipeline_removes_gaps_and_constants(spark, sf):
    from creditspark.sources.fixtures import credit_panel

    panel = credit_panel(spark, sf).withColumn("SEX", F.lit(1))
    out = features.feature_pipeline(panel)
    assert "SEX" not in out.columns and "overall_risk_score" in out.columns
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert sum(nulls) == 0
    assert not math.isnan(out.agg(F.avg("avg_pay_ratio")).first()[0])


def test_quantile_transform_equals_numpy(spark):
    df = spark.range(3000).selectExpr("id", "CAST(pow(id % 700, 1.5) AS DOUBLE) AS v")
    got = dict(encode.quantile_to_normal(df, ["v"], 20).select("id", "v").collect())
    v, grid = np.array([(i % 700) ** 1.5 for i in range(3000)]), np.linspace(0, 1, 20)
    edges = np.quantile(v, grid)
    p = (np.interp(v, edges, grid) + 1 - np.interp(-v, -edges[::-1], grid)) / 2
    want = encode.inverse_normal(np.clip(p, 1e-7, 1 - 1e-7))
    assert max(abs(got[i] - want[i]) for i in range(3000)) < 1e-9


def test_scorer_needs_all_model_columns(spark):
    from creditspark.operators.explain import scorer

    with pytest.raises(ValueError, match="needs the columns b"):
        scorer(None, ["a", "b"])(spark.createDataFrame([(1.0,)], "a double"))


def test_best_by_mean_of_all_metrics(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.6, 0.6), ("c", None, 0.6), ("d", None, None)], "name string, auc double, f1 double")
    assert [tuple(r) for r in rows.best_by_mean(df, "name", ["auc", "f1"]).collect()] == [("b", 0.6)]


def test_columns_without_values_and_whole_limits(spark):
    empty = spark.createDataFrame([("a", None), ("b", None)], "k string, v double")
    assert portfolio.density_curve(empty, "v", "k").collect() == []
    flat = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), (None, 1.0)], "k string, v double")
    assert [(r["k"], r["n"]) for r in portfolio.density_curve(flat, "v", "k", points=5).groupBy("k").agg(F.count("*").alias("n")).collect()] == [("a", 5)]
    book = spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, 4.0)], "customer_lifetime_value double, net_profit double, acquisition_cost double")
    assert all(r["value_segment"] is None for r in portfolio.value_segments(book).collect())
    pays = {f"PAY_{i}": 0 for i in (0, 2, 3, 4, 5, 6)}
    for limit, text in ((20000, "($20,000)"), (20000.5, "($20,000.50)")):
        row = text_lists.factor_lists(spark.createDataFrame([{"LIMIT_BAL": limit, "AGE": 30, **pays}])).first()
        assert row["risk_factors"] == [f"Low credit limit {text} may indicate limited creditworthiness"]
        assert row["protective_factors"] == ["No late payments in recent history"]
