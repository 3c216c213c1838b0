"""Model, explanation, segmentation, streaming and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.expr import risk_band
from creditspark.operators import clean as C
from creditspark.operators import explain as X
from creditspark.operators import models as M
from creditspark.operators import scoring as R
from creditspark.operators import segment as G
from creditspark.operators import series as W
from creditspark.operators.columns import feature_category
from creditspark.operators.rows import stratified_split, top_k
from creditspark.plans.quality import union_sql
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.plans.scoring import SCORED
from creditspark.sources import io
from creditspark.sources.fixtures import APPLICANTS, LOANS, PANEL, applicants, credit_panel, loans, table
from creditspark.streaming import live

COLS = ["LIMIT_BAL", "AGE", "PAY_0", "PAY_2", "PAY_3", "BILL_AMT1", "PAY_AMT1", "PAY_AMT2"]
FAST = {"random_forest": {"trees": 10, "depth": 4}, "logistic_regression": {"iterations": 20, "reg": 0.01}, "gbt": {"rounds": 5, "depth": 3}}


def split(spark, sf):
    """Labelled panel with its split, written once because training reads it many times."""
    return io.materialize(stratified_split(credit_panel(spark, sf).select("ID", *COLS, "target"), ["ID"], "target"), "split")


def _trained(spark, sf, families=("logistic_regression",)):
    df = split(spark, sf)
    train = df.where("split = 'train'")
    return df, {f: M.train_model(train, COLS, "target", f, **FAST[f]) for f in families}


# --- T, R3, R4: models ----------------------------------------------------------

@query("t01_train_model")
def t01(spark, sf):
    df, models = _trained(spark, sf, ("random_forest",))
    return M.batch_predict(df.where("split = 'test'"), models, COLS).select("ID", "target", "probability", "prediction", "risk_category")


@query("t01_early_stopping")
def t01e(spark, sf):
    df = split(spark, sf).where("split <> 'test'").withColumn("is_validation", F.col("split") == "validation")
    model = M.train_model(df, COLS, "target", "xgboost", validation="is_validation", rounds=8, depth=3)
    return spark.createDataFrame([(model.stages[-1].getNumTrees,)], "rounds_used int")


@query("t02_train_all_best")
def t02(spark, sf):
    df = split(spark, sf)
    metrics, best, _ = M.train_all_best(df.where("split = 'train'"), df.where("split = 'test'"), COLS, "target", FAST)
    return metrics.withColumn("best", F.col("model") == best)


@query("t03_tune")
def t03(spark, sf):
    grid = [{"trees": 5, "depth": 3}, {"trees": 10, "depth": 4}]
    trials, _ = M.tune(split(spark, sf), COLS, "target", "random_forest", ["ID"], params=grid)
    return trials


@query("t03_parzen_search")
def t03p(spark, sf):
    """Fifty proposals by density ratio, the usual number of a study."""
    trials, _ = M.tune(split(spark, sf), COLS, "target", "logistic_regression", ["ID"])
    return trials


@query("t04_cross_validate")
def t04(spark, sf):
    folds = M.cross_validate(split(spark, sf), COLS, "target", "logistic_regression", ["ID"], k=3, **FAST["logistic_regression"])
    return M.summarize_folds(folds)


@query("t04_stratified_folds", f"""WITH {PANEL}, n AS (SELECT target, count(*) AS n FROM panel GROUP BY 1) SELECT target, CAST(i AS INTEGER) AS fold, CAST((n - i + 4) // 5 AS BIGINT) AS n FROM n, range(5) t(i)""")
def t04f(spark, sf):
    return M.add_folds(credit_panel(spark, sf), ["ID"], "target", 5).groupBy("target", "fold").agg(F.count("*").alias("n"))


@query("t05_feature_importance")
def t05(spark, sf):
    df, models = _trained(spark, sf, ("random_forest",))
    return M.feature_importance(models["random_forest"], COLS, df)


@query("r03_batch_predict")
def r03(spark, sf):
    df, models = _trained(spark, sf, ("random_forest", "logistic_regression"))
    return M.batch_predict(df, models, COLS).select("ID", "probability", "prediction", "risk_category")


@query("r03_prediction_summary")
def r03s(spark, sf):
    df, models = _trained(spark, sf, ("logistic_regression",))
    return R.probability_summary(M.batch_predict(df, models, COLS), "probability", "prediction")


@query("r04_explain_prediction")
def r04(spark, sf):
    df, models = _trained(spark, sf)
    full = credit_panel(spark, sf)
    return M.explain_prediction(full, models, COLS).select("ID", "probability", "risk_category", "confidence", "risk_factors", "protective_factors", "key_features")


# --- X: explanations --------------------------------------------------------------

# fixed example coefficients of a linear score, so that the contributions have a SQL form
LINEAR = {"LIMIT_BAL": -0.000002, "AGE": -0.01, "PAY_0": 0.6, "PAY_2": 0.3, "PAY_3": 0.2, "BILL_AMT1": 0.000001}
SHAP = PANEL + ", shap AS (" + union_sql(
    f"""SELECT "ID", "MARRIAGE" AS cohort, '{c}' AS feature, {w!r}::DOUBLE * ("{c}" - (SELECT avg("{c}") FROM panel)) AS contribution FROM panel""" for c, w in LINEAR.items()) + \
    "), base AS (SELECT -1.0 + " + " + ".join(f'{w!r}::DOUBLE * avg("{c}")' for c, w in LINEAR.items()) + " AS base_value FROM panel)"


def contributions(spark, sf):
    return X.linear_shap(credit_panel(spark, sf), "ID", list(LINEAR), list(LINEAR.values()), -1.0)


@query("x01_linear_shap", rounded_sql(f'WITH {SHAP} SELECT "ID", feature, contribution, base_value FROM shap, base', "ID feature", "contribution base_value", 6))
def x01(spark, sf):
    return rounded(contributions(spark, sf), 6)


@query("x02_kernel_shap")
def x02(spark, sf):
    df, models = _trained(spark, sf)
    return X.sampled_shap(df, "ID", COLS, X.scorer(models["logistic_regression"], COLS), X.background(df, ["ID"], COLS), permutations=4)


# fixed example tree: (id, feature, threshold, left, right, rows, value)
TREE_COLS = ["PAY_0", "LIMIT_BAL", "AGE"]
TREE = [X.Node(*n) for n in (
    (0, 0, 0.5, 1, 2, 1000, 0.0), (1, 1, 100000.0, 3, 4, 700, 0.0), (2, 2, 40.0, 5, 6, 300, 0.0), (3, 0, -0.5, 7, 8, 300, 0.0),
    (4, -1, 0.0, -1, -1, 400, 0.10), (5, -1, 0.0, -1, -1, 180, 0.60), (6, 1, 200000.0, 9, 10, 120, 0.0),
    (7, -1, 0.0, -1, -1, 120, 0.15), (8, -1, 0.0, -1, -1, 180, 0.25), (9, -1, 0.0, -1, -1, 70, 0.75), (10, -1, 0.0, -1, -1, 50, 0.45))]
# the same leaves by hand: bounds and share of the training rows per feature, value; game = expected value of every set of known features
_GAME = PANEL + """, leaf(p0, p1, pz, l0, l1, lz, a0, a1, az, v) AS (VALUES
 (-1e18, 0.5, 0.7, 1e5, 1e18, 4 / 7.0::DOUBLE, -1e18, 1e18, 1.0, 0.10), (-1e18, -0.5, 0.28, -1e18, 1e5, 3 / 7.0::DOUBLE, -1e18, 1e18, 1.0, 0.15),
 (-0.5, 0.5, 0.42, -1e18, 1e5, 3 / 7.0::DOUBLE, -1e18, 1e18, 1.0, 0.25), (0.5, 1e18, 0.3, -1e18, 1e18, 1.0, -1e18, 40, 0.6, 0.60),
 (0.5, 1e18, 0.3, -1e18, 2e5, 7 / 12.0::DOUBLE, 40, 1e18, 0.4, 0.75), (0.5, 1e18, 0.3, 2e5, 1e18, 5 / 12.0::DOUBLE, 40, 1e18, 0.4, 0.45)),
game AS (SELECT "ID", m, sum(v::DOUBLE * CASE WHEN m & 1 > 0 THEN ("PAY_0" > p0 AND "PAY_0" <= p1)::INT ELSE pz END * CASE WHEN m & 2 > 0 THEN ("LIMIT_BAL" > l0 AND "LIMIT_BAL" <= l1)::INT ELSE lz END
 * CASE WHEN m & 4 > 0 THEN ("AGE" > a0 AND "AGE" <= a1)::INT ELSE az END) AS g FROM panel, leaf, range(8) t(m) GROUP BY 1, 2),
names(bit, feature) AS (VALUES (1, 'PAY_0'), (2, 'LIMIT_BAL'), (4, 'AGE')),
shap AS (SELECT a."ID", feature, bit, sum((b.g - a.g) * CASE WHEN bit_count(a.m) = 1 THEN 1 ELSE 2 END / 6) AS contribution FROM game a JOIN names ON a.m & bit = 0 JOIN game b ON a."ID" = b."ID" AND b.m = a.m + bit GROUP BY 1, 2, 3),
pairs AS (SELECT a."ID", x.feature AS feature1, y.feature AS feature2, sum(a.g - b.g - c.g + d.g) / 4 AS value FROM game a JOIN names x ON a.m & x.bit = 0 JOIN names y ON a.m & y.bit = 0 AND x.bit <> y.bit
 JOIN game b ON a."ID" = b."ID" AND b.m = a.m + x.bit JOIN game c ON a."ID" = c."ID" AND c.m = a.m + y.bit JOIN game d ON a."ID" = d."ID" AND d.m = a.m + x.bit + y.bit GROUP BY 1, 2, 3)"""


@query("x02_tree_shap", rounded_sql(f'WITH {_GAME} SELECT s."ID", feature, contribution, g AS base_value FROM shap s JOIN game ON s."ID" = game."ID" AND m = 0', "ID feature", "contribution base_value", 6))
def x02t(spark, sf):
    return rounded(X.tree_shap(credit_panel(spark, sf), "ID", TREE_COLS, [TREE]), 6)


@query("x02_forest_shap")
def x02f(spark, sf):
    """Every row under a forest of the usual size; the contributions of a row add up to its probability."""
    df = split(spark, sf)
    model = M.train_model(df.where("split = 'train'"), COLS, "target", "random_forest")
    return X.tree_shap(df, "ID", COLS, X.tree_nodes(spark, model))


@query("x03_lime")
def x03(spark, sf):
    df, models = _trained(spark, sf)
    return X.lime(df, "ID", COLS, X.scorer(models["logistic_regression"], COLS), samples=100)


@query("x04_global_importance", rounded_sql(f"WITH {SHAP}, g AS (SELECT feature, avg(abs(contribution)) AS importance, avg(contribution) AS mean_contribution FROM shap GROUP BY 1) SELECT *, importance / sum(importance) OVER () AS share FROM g",
                                            "feature", "importance mean_contribution share", 6))
def x04(spark, sf):
    return rounded(X.global_importance(contributions(spark, sf)), 6)


@query("x05_permutation_importance")
def x05(spark, sf):
    df, models = _trained(spark, sf)
    return X.permutation_importance(df, ["ID"], COLS, "target", X.scorer(models["logistic_regression"], COLS), repeats=2)


@query("x06_cohort_importance", rounded_sql(f"WITH {SHAP}, g AS (SELECT cohort, feature, avg(abs(contribution)) AS importance FROM shap GROUP BY 1, 2) SELECT *, importance / sum(importance) OVER (PARTITION BY cohort) AS share FROM g",
                                            "cohort feature", "importance share", 6))
def x06(spark, sf):
    who = credit_panel(spark, sf).select("ID", F.col("MARRIAGE").alias("cohort"))
    return rounded(X.cohort_importance(contributions(spark, sf).join(who, "ID"), "cohort").drop("mean_contribution"), 6)


_CAT = "CASE WHEN contains(lower(feature), 'income') OR contains(lower(feature), 'debt_to_income') THEN 'financial' WHEN contains(lower(feature), 'age') OR contains(lower(feature), 'employment_length') THEN 'demographic' WHEN contains(lower(feature), 'loan_amount') THEN 'loan_specific' ELSE 'other' END"


@query("m14_feature_categories", f"WITH {SHAP} SELECT DISTINCT feature, {_CAT} AS category FROM shap")
def m14(spark, sf):
    return contributions(spark, sf).select("feature", feature_category("feature").alias("category")).distinct()


@query("x07_category_contribution", rounded_sql(f"""WITH {SHAP}, g AS (SELECT "ID", {_CAT} AS category, sum(contribution) AS total FROM shap GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY "ID" ORDER BY abs(total) DESC, category) = 1 AS "primary" FROM g""",
                                                "ID category primary", "total", 6))
def x07(spark, sf):
    return rounded(X.category_contribution(contributions(spark, sf), "ID"), 6)


@query("x07_risk_drivers", rounded_sql(f"""WITH {SHAP} SELECT "ID", feature, contribution, CAST(rk AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY "ID" ORDER BY contribution DESC, feature) AS rk FROM shap WHERE contribution > 0) WHERE rk <= 5""",
                                       "ID feature rank", "contribution", 6))
def x07r(spark, sf):
    return rounded(X.risk_drivers(contributions(spark, sf), "ID").select("ID", "feature", "contribution", "rank"), 6)


@query("x07_explanation_summary", f"""WITH {SHAP}, p AS (SELECT "ID", "AGE" / 80.0 AS p FROM panel), g AS (SELECT "ID", {_CAT} AS category, sum(contribution) AS total FROM shap GROUP BY 1, 2),
c AS (SELECT "ID", category FROM g QUALIFY row_number() OVER (PARTITION BY "ID" ORDER BY abs(total) DESC, category) = 1), t AS (SELECT "ID", feature FROM shap WHERE contribution > 0 QUALIFY row_number() OVER (PARTITION BY "ID" ORDER BY contribution DESC, feature) = 1)
SELECT p."ID", concat_ws('. ', 'Risk Assessment: ' || CASE WHEN p < 0.3 THEN 'Low Risk' WHEN p < 0.7 THEN 'Medium Risk' ELSE 'High Risk' END, 'Primary risk driver: ' || upper(category[1]) || category[2:] || ' factors', 'Most significant factor: ' || feature || ' (Increases Risk)') || '.' AS summary
FROM p LEFT JOIN c ON p."ID" = c."ID" LEFT JOIN t ON p."ID" = t."ID" """)
def x07s(spark, sf):
    return X.explanation_summary(contributions(spark, sf), "ID", credit_panel(spark, sf).select("ID", (F.col("AGE") / 80.0).alias("p")))


@query("w09_waterfall", rounded_sql(f"""WITH {SHAP} SELECT "ID", feature, contribution, CAST(row_number() OVER w AS INTEGER) AS step, base_value + sum(contribution) OVER (w ROWS UNBOUNDED PRECEDING) AS running_total FROM shap, base WINDOW w AS (PARTITION BY "ID" ORDER BY abs(contribution) DESC, feature)""",
                                    "ID feature step", "contribution running_total", 6))
def w09(spark, sf):
    return rounded(W.waterfall(contributions(spark, sf), "ID").drop("base_value"), 6)


@query("k03_top_features", rounded_sql(f"WITH {SHAP} SELECT feature, avg(abs(contribution)) AS importance FROM shap GROUP BY 1 ORDER BY 2 DESC LIMIT 3", "feature", "importance", 6))
def k03f(spark, sf):
    return rounded(top_k(X.global_importance(contributions(spark, sf)).select("feature", "importance"), "importance", 3), 6)


@query("x08_stability")
def x08(spark, sf):
    df = credit_panel(spark, sf)
    cols, w = ["PAY_0", "PAY_2", "PAY_3"], [0.6, 0.3, 0.2]
    return X.stability(df, "ID", cols, lambda d, k: X.linear_shap(d, k, cols, w, means=[0.0, 0.0, 0.0]), draws=20)


_PRODUCT = rounded_sql("""WITH m AS (SELECT avg("PAY_0") AS p, avg("PAY_2") AS q, avg("AGE") AS g FROM panel)
SELECT 'PAY_0' AS feature1, 'PAY_2' AS feature2, avg(abs(("PAY_0" - p) * ("PAY_2" - q))) AS interaction_strength FROM panel, m
UNION ALL SELECT 'AGE', 'PAY_0', avg(abs(("AGE" - g) * ("PAY_0" - p) * "LIMIT_BAL" / 100000)) FROM panel, m
UNION ALL SELECT 'AGE', 'PAY_2', 0.0""", "feature1 feature2", "interaction_strength", 6)


@query("x09_interactions_product", f"WITH {PANEL} {_PRODUCT}")
def x09p(spark, sf):
    """A score whose second differences are known; LIMIT_BAL is needed by it but not varied."""
    score = lambda d: d.withColumn("p", F.col("PAY_0") * F.col("PAY_2") + F.col("AGE") * F.col("PAY_0") * F.col("LIMIT_BAL") / 100000)
    return rounded(X.interactions(credit_panel(spark, sf).select("ID", "AGE", "PAY_0", "PAY_2", "LIMIT_BAL"), "ID", ["AGE", "PAY_0", "PAY_2"], score), 6)


@query("x09_interactions")
def x09(spark, sf):
    df, models = _trained(spark, sf, ("random_forest",))
    return X.interactions(df, "ID", COLS[:5], X.scorer(models["random_forest"], COLS))


@query("x09_shap_interactions", rounded_sql(f"""WITH {_GAME} SELECT "ID", feature1, feature2, value FROM pairs
UNION ALL SELECT s."ID", feature, feature, contribution - (SELECT sum(value) FROM pairs p WHERE p."ID" = s."ID" AND feature1 = s.feature) FROM shap s""", "ID feature1 feature2", "value", 6))
def x09s(spark, sf):
    return rounded(X.tree_interactions(credit_panel(spark, sf), "ID", TREE_COLS, [TREE]), 6)


@query("x09_interaction_strength", rounded_sql(f"""WITH {_GAME} SELECT feature1, feature2, avg(abs(value)) AS interaction_strength FROM pairs
WHERE (feature1, feature2) IN (('PAY_0', 'LIMIT_BAL'), ('PAY_0', 'AGE'), ('LIMIT_BAL', 'AGE')) GROUP BY 1, 2""", "feature1 feature2", "interaction_strength", 6))
def x09t(spark, sf):
    return rounded(X.interaction_strength(X.tree_interactions(credit_panel(spark, sf), "ID", TREE_COLS, [TREE]), TREE_COLS), 6)


@query("x09_forest_interactions")
def x09f(spark, sf):
    """All pairs of the model's features, by a forest of the registered fast size."""
    df, models = _trained(spark, sf, ("random_forest",))
    values = X.tree_interactions(df, "ID", COLS, X.tree_nodes(spark, models["random_forest"]))
    return X.interaction_strength(values, COLS, top=None)


_NEAR = ["LIMIT_BAL", "AGE", "PAY_0"]


@query("x10_counterfactual", rounded_sql(f"""WITH {PANEL}, s AS (SELECT {', '.join(f'stddev_pop("{c}") AS s_{c}' for c in _NEAR)} FROM panel),
d AS (SELECT q."ID", o."ID" AS neighbor, {' + '.join(f'pow(q."{c}" / s_{c} - o."{c}" / s_{c}, 2)' for c in _NEAR)} AS d2 FROM panel q, panel o, s WHERE q.target = 1 AND o.target = 0)
SELECT "ID", sqrt(min(d2)) AS distance FROM d GROUP BY 1""", "ID", "distance", 6))
def x10(spark, sf):
    return rounded(X.counterfactual(credit_panel(spark, sf), "ID", _NEAR, "target").select("ID", "distance"), 6)


_KNN = ["age", "credit_score", "annual_income", "existing_debt"]
_SHARED = " + ".join(f"(CASE WHEN q.{c} IS NOT NULL AND o.{c} IS NOT NULL THEN 1 ELSE 0 END)" for c in _KNN)
_D2 = " + ".join(f"coalesce(pow(q.{c} - o.{c}, 2), 0)" for c in _KNN)
HOLES = APPLICANTS + """, holes AS (SELECT customer_id, CAST(CASE WHEN customer_id % 17 <> 0 THEN age END AS DOUBLE) AS age, CAST(CASE WHEN customer_id % 19 <> 0 THEN credit_score END AS DOUBLE) AS credit_score,
 CASE WHEN customer_id % 13 <> 0 THEN annual_income END AS annual_income, existing_debt FROM applicants)"""


def _knn_sql(c):
    return f"""k_{c} AS (SELECT customer_id, avg(v) AS v FROM (SELECT q.customer_id, o.{c} AS v, row_number() OVER (PARTITION BY q.customer_id ORDER BY ({_D2}) * (4 / ({_SHARED})), o.customer_id) AS rn
 FROM holes q, holes o WHERE q.{c} IS NULL AND o.{c} IS NOT NULL) WHERE rn <= 5 GROUP BY 1)"""


@query("c03_impute_knn", rounded_sql(f"""WITH {HOLES}, {', '.join(_knn_sql(c) for c in _KNN[:3])} SELECT h.customer_id, coalesce(h.age, a.v) AS age, coalesce(h.credit_score, c.v) AS credit_score, coalesce(h.annual_income, i.v) AS annual_income
FROM holes h LEFT JOIN k_age a ON h.customer_id = a.customer_id LEFT JOIN k_credit_score c ON h.customer_id = c.customer_id LEFT JOIN k_annual_income i ON h.customer_id = i.customer_id""",
    "customer_id", "age credit_score annual_income"))
def c03(spark, sf):
    k = F.col("customer_id")
    df = applicants(spark, sf).select(k, F.when(k % 17 != 0, F.col("age")).alias("age"), F.when(k % 19 != 0, F.col("credit_score")).alias("credit_score"),
                                      F.when(k % 13 != 0, F.col("annual_income")).alias("annual_income"), "existing_debt")
    return rounded(C.impute_knn(df, "customer_id", _KNN).drop("existing_debt"))


# --- G: segmentation ------------------------------------------------------------------

SEG = ["age", "credit_score", "annual_income"]
Z = [f"z_{c}" for c in SEG]


def prepared(spark, sf):
    return G.prepare(applicants(spark, sf).select("customer_id", *SEG), SEG)


@query("g01_kmeans")
def g01(spark, sf):
    df = prepared(spark, sf)
    return G.kmeans(df, 4, restarts=2).transform(df).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in SEG])


@query("g02_gaussian_mixture")
def g02(spark, sf):
    df = prepared(spark, sf)
    return G.gaussian_mixture(df, 3).transform(df).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in SEG])


@query("g03_hierarchical")
def g03(spark, sf):
    return G.hierarchical(prepared(spark, sf), 4, micro=50).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in SEG])


@query("g04_dbscan")
def g04(spark, sf):
    df = G.prepare(credit_panel(spark, sf).select("ID", "LIMIT_BAL", "AGE"), ["LIMIT_BAL", "AGE"])
    return G.dbscan(df, "ID", ["z_LIMIT_BAL", "z_AGE"], 0.15, 5)


@query("g05_choose_k")
def g05(spark, sf):
    return G.choose_k(prepared(spark, sf), Z, range(2, 5), restarts=1)


@query("g06_cluster_profiles", rounded_sql(f"WITH {APPLICANTS} " + union_sql(
    f"SELECT previous_defaults AS cluster, '{c}' AS feature, count(*) AS size, count(*) * 100.0 / (SELECT count(*) FROM applicants) AS percentage, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median FROM applicants GROUP BY 1" for c in SEG),
    "cluster feature size", "percentage mean std min max median"))
def g06(spark, sf):
    return rounded(G.cluster_profiles(applicants(spark, sf).withColumnRenamed("previous_defaults", "cluster"), SEG))


@query("g07_cluster_insights", f"""WITH {APPLICANTS}, m AS (SELECT previous_defaults AS cluster, avg(credit_score) s, avg(annual_income) i, avg(age) a FROM applicants GROUP BY 1)
SELECT cluster, CASE WHEN s >= 750 THEN 'Excellent credit profile - Premium customers' WHEN s >= 650 THEN 'Good credit profile - Standard customers' ELSE 'Poor credit profile - High-risk customers' END || '; ' ||
 CASE WHEN i >= 100000 THEN 'High-income segment' WHEN i >= 50000 THEN 'Middle-income segment' ELSE 'Low-income segment' END || '; ' ||
 CASE WHEN a >= 55 THEN 'Senior customers - Stable income' WHEN a >= 35 THEN 'Mid-career professionals' ELSE 'Young professionals - Growth potential' END AS insights FROM m""")
def g07(spark, sf):
    p = G.cluster_profiles(applicants(spark, sf).withColumnRenamed("previous_defaults", "cluster"), SEG)
    return G.cluster_insights(p, names={"credit_score": "credit_score", "income": "annual_income", "age": "age"}).select("cluster", F.concat_ws("; ", "insights").alias("insights"))


@query("g08_pca_2d", rounded_sql(f"""WITH {APPLICANTS}, z AS (SELECT customer_id, (credit_score - avg(credit_score) OVER ()) / stddev_pop(credit_score) OVER () AS a, (annual_income - avg(annual_income) OVER ()) / stddev_pop(annual_income) OVER () AS b FROM applicants),
r AS (SELECT sign(corr(a, b)) AS s, abs(corr(a, b)) AS c FROM z) SELECT customer_id, abs(a + s * b) / sqrt(2) AS pc1, abs(a - s * b) / sqrt(2) AS pc2, (1 + c) / 2 AS share1, (1 - c) / 2 AS share2 FROM z, r""", "customer_id", "pc1 pc2 share1 share2", 6))
def g08(spark, sf):
    # two standardized columns have a closed form; components are compared up to their sign
    df = G.prepare(applicants(spark, sf).select("customer_id", "credit_score", "annual_income"), ["credit_score", "annual_income"])
    pcs, share = G.pca_2d(df, ["z_credit_score", "z_annual_income"], ["customer_id"])
    return rounded(pcs.select("customer_id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"), F.lit(share[0]).alias("share1"), F.lit(share[1]).alias("share2")), 6)


# --- Z: streaming -----------------------------------------------------------------------

def event_stream(spark, sf, **kw):
    return live.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet", **kw)


@query("z01_stream_scoring", f"WITH {SCORED} SELECT customer_id, risk_score, risk_level FROM scored")
def z01(spark, sf):
    out = io.scratch_path(spark, "scored")
    src = io.scratch_path(spark, "applicants")
    applicants(spark, sf).write.parquet(src)
    rows = live.read_stream(spark, src, applicants(spark, sf).schema)
    live.stream_scoring(rows, R.applicant_score, out, io.scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).select("customer_id", "risk_score", "risk_level")


@query("z02_live_kpis", rounded_sql("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, avg(value) AS mean_value, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) AS error_share FROM events GROUP BY 1, 2",
                                    "window_start event_type n", "mean_value error_share"))
def z02(spark, sf):
    out = io.scratch_path(spark, "kpis")
    k = live.live_kpis(event_stream(spark, sf), "ts", "value", F.col("value") < 5, "event_type")
    live.start_table(k, out, io.scratch_path(spark, "ckpt"), "complete").awaitTermination()
    return rounded(spark.read.parquet(out))


_DR = "CASE WHEN value BETWEEN lo AND hi THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) END"


@query("z03_drift_monitor", rounded_sql(f"""WITH old AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-10'), r AS (SELECT min(value) lo, max(value) hi FROM old),
e AS (SELECT {_DR} AS b, count(*) / (SELECT count(*) FROM old) AS e FROM old, r GROUP BY 1), a AS (SELECT {_DR} AS b, count(*) / (SELECT count(*) FROM events) AS a FROM events, r GROUP BY 1),
p AS (SELECT sum((coalesce(a, 0.0001) - coalesce(e, 0.0001)) * ln(coalesce(a, 0.0001) / coalesce(e, 0.0001))) AS psi FROM range(10) t(i) LEFT JOIN e ON e.b = i LEFT JOIN a ON a.b = i)
SELECT 0 AS batch, 'value' AS feature, psi, psi > 0.1 AS alert FROM p""", "batch feature alert", "psi", 6))
def z03(spark, sf):
    out = io.scratch_path(spark, "drift")
    base = table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    live.drift_monitor(event_stream(spark, sf), base, ["value"], out, io.scratch_path(spark, "ckpt")).awaitTermination()
    return rounded(spark.read.parquet(out), 6)


# --- S: sources and sinks -----------------------------------------------------------------

_CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("s01_scan_csv", _CUST)
def s01(spark, sf):
    df, path = table(spark, sf, "customer"), io.scratch_path(spark, "csv")
    df.write.option("sep", ";").option("header", True).csv(path)
    return io.scan_csv(spark, path, df.schema, sep=";")


@query("s01_scan_csv_skip", _CUST)
def s01b(spark, sf):
    df, path = table(spark, sf, "customer"), io.scratch_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return io.scan_csv(spark, path, df.schema, header=False, skip_rows=1)


@query("s02_scan_json", _CUST)
def s02(spark, sf):
    df, path = table(spark, sf, "customer"), io.scratch_path(spark, "json")
    io.sink_json(df, path)
    return io.scan_json(spark, path, df.schema, multi_line=False)


@query("s03_scan_parquet", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def s03(spark, sf):
    return io.scan_parquet(spark, f"{sf}/lineitem.parquet").where("l_quantity > 10").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("s04_load_processed", f"WITH {LOANS} SELECT loan_id, loan_amount FROM loans")
def s04(spark, sf):
    path = io.scratch_path(spark, "processed")
    io.sink_parquet(loans(spark, sf).select("loan_id", "loan_amount"), path)
    return io.load_processed(spark, path)


@query("s05_sql_source", f"WITH {LOANS} SELECT product_type, count(*) AS n FROM loans WHERE credit_score >= 700 GROUP BY 1")
def s05(spark, sf):
    return io.sql_source(spark, "SELECT product_type, count(*) AS n FROM loan_book WHERE credit_score >= :low GROUP BY product_type",
                         {"loan_book": loans(spark, sf)}, {"low": 700})


@query("s06_sink_csv", f"WITH {LOANS} SELECT loan_id, product_type, credit_score FROM loans")
def s06(spark, sf):
    path = io.scratch_path(spark, "out")
    df = loans(spark, sf).select("loan_id", "product_type", "credit_score")
    io.sink_csv(df, path)
    return io.scan_csv(spark, path, df.schema)


@query("s07_sink_json", f"WITH {LOANS} SELECT risk_category, count(*) AS n FROM loans GROUP BY 1")
def s07(spark, sf):
    path = io.scratch_path(spark, "report")
    io.sink_json(loans(spark, sf).groupBy("risk_category").agg(F.count("*").alias("n")), path)
    return io.scan_json(spark, path, multi_line=False)


@query("s08_sink_parquet", f"WITH {SCORED} SELECT customer_id, risk_score, risk_level FROM scored")
def s08(spark, sf):
    path = io.scratch_path(spark, "scored")
    io.sink_parquet(R.applicant_score(applicants(spark, sf)).select("customer_id", "risk_score", "risk_level"), path, ["risk_level"])
    return io.scan_parquet(spark, path)


@query("s09_save_load_model")
def s09(spark, sf):
    df, models = _trained(spark, sf)
    path = io.scratch_path(spark, "models")
    M.save_models(models, path)
    loaded = M.load_model(path, "logistic_regression")
    return M.batch_predict(df, {"m": loaded}, COLS).select("ID", "probability", risk_band("probability").alias("risk_category"))


@query("s10_save_load_prep_config", rounded_sql(f"WITH {LOANS} SELECT loan_id, (loan_amount - avg(loan_amount) OVER ()) / stddev_pop(loan_amount) OVER () AS loan_amount FROM loans", "loan_id", "loan_amount", 6))
def s10(spark, sf):
    from creditspark.operators.encode import apply_scaler, fit_scaler
    df, path = loans(spark, sf).select("loan_id", "loan_amount"), io.scratch_path(spark, "prep")
    fit = fit_scaler(df, ["loan_amount"])
    io.save_prep_config(spark, {"center": {c: v[0] for c, v in fit.items()}, "scale": {c: v[1] for c, v in fit.items()}}, path)
    got = io.load_prep_config(spark, path)
    return rounded(apply_scaler(df, {c: (got["center"][c], got["scale"][c]) for c in got["center"]}), 6)
