"""Feature engineering, scaling, encoding, selection and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.expr import bin_by_edges
from creditspark.functions.ordering import quantile_dict
from creditspark.operators import encode as X
from creditspark.operators import features as E
from creditspark.operators import profiling as Q
from creditspark.operators import selection as S
from creditspark.plans.quality import union_sql
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.sources.fixtures import (APPLICANTS, BILL_COLS, GAPS, LOANS, PAID_COLS, PANEL, PANEL_FEATURES, PAY_COLS, applicants,
                                          applicants_with_gaps, credit_panel, loans)
from creditspark.sources.io import materialize


def _list(cols):
    return "[" + ", ".join(f'"{c}"' for c in cols) + "]"


def _count(cols, cond):
    return "(" + " + ".join(f'CASE WHEN "{c}" {cond} THEN 1 ELSE 0 END' for c in cols) + ")"


_RATIOS = ", ".join(f'"PAY_AMT{i}" / ("BILL_AMT{i}" + 1) AS pay_ratio_{i}' for i in range(1, 7))
ENGINEERED = PANEL + f""", e2 AS (SELECT *, list_avg({_list(BILL_COLS)}) AS avg_bill_amt, list_max({_list(BILL_COLS)}) AS max_bill_amt, list_min({_list(BILL_COLS)}) AS min_bill_amt,
 list_stddev_samp({_list(BILL_COLS)}) AS std_bill_amt FROM panel),
e2b AS (SELECT *, avg_bill_amt / ("LIMIT_BAL" + 1) AS avg_utilization_ratio, max_bill_amt / ("LIMIT_BAL" + 1) AS max_utilization_ratio,
 ("BILL_AMT1" - "BILL_AMT6") / ("BILL_AMT6" + 1) AS bill_amt_trend, std_bill_amt / (avg_bill_amt + 1) AS bill_amt_volatility FROM e2),
e3 AS (SELECT *, list_avg({_list(PAY_COLS)}) AS avg_pay_status, list_max({_list(PAY_COLS)}) AS max_pay_delay, {_count(PAY_COLS, '> 0')} AS pay_delay_frequency, {_count(PAY_COLS, '>= 2')} AS severe_delay_count,
 list_avg({_list(PAID_COLS)}) AS avg_pay_amt, list_sum({_list(PAID_COLS)}) AS total_pay_amt, {_RATIOS} FROM e2b),
e3b AS (SELECT *, 1 - list_stddev_samp({_list(PAID_COLS)}) / (avg_pay_amt + 1) AS pay_amt_consistency, list_avg([{', '.join(f'pay_ratio_{i}' for i in range(1, 7))}]) AS avg_pay_ratio FROM e3),
e4 AS (SELECT *, "LIMIT_BAL" / ("AGE" + 1) AS limit_per_age, avg_bill_amt / ("LIMIT_BAL" + 1) AS debt_burden, avg_pay_amt / (avg_bill_amt + 1) AS payment_burden,
 ("PAY_AMT1" - "PAY_AMT6") / ("PAY_AMT6" + 1) AS financial_trend, ("BILL_AMT6" - "BILL_AMT1") / ("BILL_AMT1" + 1) AS balance_trend FROM e3b),
e5 AS (SELECT *, max_pay_delay * 0.3 + pay_delay_frequency * 0.2 + severe_delay_count * 0.5 AS payment_risk_score,
 max_utilization_ratio * 0.4 + debt_burden * 0.3 + (1 - payment_burden) * 0.3 AS credit_risk_score FROM e4),
e5b AS (SELECT *, payment_risk_score * 0.6 + credit_risk_score * 0.4 AS overall_risk_score FROM e5),
e6 AS (SELECT *, CASE WHEN "PAY_6" > "PAY_0" THEN 1 ELSE 0 END AS payment_improving, CASE WHEN "PAY_0" > "PAY_6" THEN 1 ELSE 0 END AS payment_deteriorating,
 list_avg({_list(PAY_COLS[:3])}) AS recent_pay_avg, list_avg({_list(PAY_COLS[3:])}) AS historical_pay_avg FROM e5b),
q AS (SELECT {', '.join(f'quantile_cont("LIMIT_BAL", {i / 5}) AS q{i}' for i in range(1, 5))} FROM panel),
engineered AS (SELECT *, recent_pay_avg - historical_pay_avg AS behavior_change, "AGE" * "LIMIT_BAL" / 1000000 AS age_limit_interaction, "AGE" * overall_risk_score AS age_risk_interaction,
 "SEX" * "LIMIT_BAL" / 1000000 AS gender_limit_interaction, "SEX" * overall_risk_score AS gender_risk_interaction, "EDUCATION" * "LIMIT_BAL" / 1000000 AS education_limit_interaction,
 CASE WHEN "AGE" <= 30 THEN 1.0 WHEN "AGE" <= 40 THEN 2.0 WHEN "AGE" <= 50 THEN 3.0 WHEN "AGE" <= 100 THEN 4.0 END::DOUBLE AS age_group,
 CASE WHEN "LIMIT_BAL" <= q1 THEN 1.0 WHEN "LIMIT_BAL" <= q2 THEN 2.0 WHEN "LIMIT_BAL" <= q3 THEN 3.0 WHEN "LIMIT_BAL" <= q4 THEN 4.0 ELSE 5.0 END::DOUBLE AS limit_group,
 CASE WHEN "AGE" < 25 OR "AGE" > 65 OR "EDUCATION" > 3 OR "MARRIAGE" = 3 THEN 1 ELSE 0 END AS high_risk_demo FROM e6, q)"""

GROUPS = {
    "e02_features_utilization": ("", "avg_bill_amt max_bill_amt min_bill_amt std_bill_amt avg_utilization_ratio max_utilization_ratio bill_amt_trend bill_amt_volatility"),
    "e03_features_payment": ("pay_delay_frequency severe_delay_count max_pay_delay", "avg_pay_status avg_pay_amt total_pay_amt pay_amt_consistency pay_ratio_1 pay_ratio_6 avg_pay_ratio"),
    "e04_features_health": ("", "limit_per_age debt_burden payment_burden financial_trend balance_trend"),
    "e05_features_risk_scores": ("", "payment_risk_score credit_risk_score overall_risk_score"),
    "e06_features_temporal": ("payment_improving payment_deteriorating", "recent_pay_avg historical_pay_avg behavior_change"),
    "e07_features_interaction": ("", "age_limit_interaction age_risk_interaction gender_limit_interaction gender_risk_interaction education_limit_interaction"),
    "e08_features_demographic": ("high_risk_demo", "age_group limit_group"),
}
STEPS = [E.features_utilization, E.features_payment, E.features_health, E.features_risk_scores, E.features_temporal,
         E.features_interaction, E.features_demographic]


def _group(name, upto, plain, doubles):
    cols = f"{plain} {doubles}".split()

    digits = {"e02_features_utilization": 4, "e07_features_interaction": 6}.get(name, 5)

    @query(name, rounded_sql(f"WITH {ENGINEERED} SELECT * FROM engineered", f"ID {plain}", doubles, digits))
    def run(spark, sf):
        df = credit_panel(spark, sf)
        for step in STEPS[:upto]:
            df = step(df)
        return rounded(df.select("ID", *cols), digits)


for _i, (_n, (_p, _d)) in enumerate(GROUPS.items(), 1):
    _group(_n, _i, _p, _d)

_BASIC = " ".join(f"credit_util_{i} payment_ratio_{i}" for i in range(1, 7))


@query("e01_features_basic", rounded_sql(f"""WITH {PANEL} SELECT "ID", {', '.join(f'"BILL_AMT{i}" / ("LIMIT_BAL" + 1) AS credit_util_{i}, "PAY_AMT{i}" / ("BILL_AMT{i}" + 1) AS payment_ratio_{i}' for i in range(1, 7))},
 list_avg({_list(BILL_COLS)}) AS avg_bill_amt, list_avg({_list(PAID_COLS)}) AS avg_pay_amt, {_count(PAY_COLS, '> 0')} AS delay_count, list_max({_list(PAY_COLS)}) AS max_delay FROM panel""",
    "ID delay_count max_delay", f"{_BASIC} avg_bill_amt avg_pay_amt", 5))
def e01(spark, sf):
    return rounded(E.features_basic(credit_panel(spark, sf)).select("ID", "delay_count", "max_delay", *_BASIC.split(), "avg_bill_amt", "avg_pay_amt"), 5)


@query("e09_all_features", rounded_sql(f"WITH {ENGINEERED} SELECT * FROM engineered", "ID high_risk_demo pay_delay_frequency",
                                           "avg_utilization_ratio avg_pay_ratio overall_risk_score behavior_change age_risk_interaction limit_group", 5))
def e09(spark, sf):
    return rounded(E.feature_pipeline(materialize(credit_panel(spark, sf), "panel")).select(
        "ID", "high_risk_demo", "pay_delay_frequency", "avg_utilization_ratio", "avg_pay_ratio", "overall_risk_score", "behavior_change",
        "age_risk_interaction", "limit_group"), 5)


@query("e10_polynomial", rounded_sql(f"""WITH {APPLICANTS} SELECT customer_id, debt_to_income_ratio * debt_to_income_ratio AS "debt_to_income_ratio^2", debt_to_income_ratio * employment_length AS "debt_to_income_ratio_x", employment_length * employment_length AS "employment_length^2" FROM applicants""",
                                     "customer_id", "debt_to_income_ratio^2 debt_to_income_ratio_x employment_length^2", 6))
def e10(spark, sf):
    out = E.polynomial(applicants(spark, sf), ["debt_to_income_ratio", "employment_length"])
    return rounded(out.withColumnRenamed("debt_to_income_ratio employment_length", "debt_to_income_ratio_x").select(
        "customer_id", "`debt_to_income_ratio^2`", "debt_to_income_ratio_x", "`employment_length^2`"), 6)


@query("j01_attach_columns", rounded_sql(f"WITH {APPLICANTS} SELECT customer_id, age * credit_score * 1.0 AS product FROM applicants", "customer_id", "product"))
def j01(spark, sf):
    out = E.polynomial(applicants(spark, sf), ["age", "credit_score"], interaction_only=True)
    return rounded(out.select("customer_id", F.col("`age credit_score`").alias("product")))


_SC = ["loan_amount", "credit_score", "default_probability"]
_SCALE = {
    "standard": lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()",
    "minmax": lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())",
    "robust": lambda c: f"({c} - median({c}) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())",
}


def _scale(method):
    @query(f"e11_scale_{method}", rounded_sql(f"WITH {LOANS} SELECT loan_id, {', '.join(f'{_SCALE[method](c)} AS {c}' for c in _SC)} FROM loans", "loan_id", " ".join(_SC), 6))
    def run(spark, sf):
        return rounded(X.scale(loans(spark, sf).select("loan_id", *_SC), method, cols=_SC), 6)


for _m in _SCALE:
    _scale(_m)


def _acklam(p: str) -> str:
    """SQL of the inverse normal distribution, with the coefficients of the operator."""

    def poly(c, x):
        return "(" + "(" * (len(c) - 1) + repr(c[0]) + "".join(f") * {x} + {v!r}" for v in c[1:]) + ")"

    tail, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    outer = f"{poly(X._C, tail)} / {poly([*X._D, 1.0], tail)}"
    inner = f"{poly(X._A, f'({q} * {q})')} * {q} / {poly([*X._B, 1.0], f'({q} * {q})')}"
    return f"CASE WHEN least({p}, 1 - {p}) < 0.02425 THEN (CASE WHEN {p} < 0.5 THEN 1 ELSE -1 END) * ({outer}) ELSE {inner} END"


def _quantile_scaled(c: str) -> str:
    """Middle of the probabilities whose quantiles equal the value, else the line between the quantiles around it."""
    edges = (f"s_{c} AS (SELECT list({c}::DOUBLE ORDER BY {c}) AS s, count({c}) AS n, least(1000, count(*)) AS k FROM loans WHERE {c} IS NOT NULL), "
             f"r_{c} AS (SELECT s, i / (k - 1)::DOUBLE AS g, i / (k - 1)::DOUBLE * (n - 1) AS pos FROM s_{c}, range(0, 1000) t(i) WHERE i < k), "
             f"q_{c} AS (SELECT g, CASE WHEN a = b THEN a ELSE a * (1 - f) + b * f END AS q FROM (SELECT g, s[floor(pos)::INT + 1] AS a, s[ceil(pos)::INT + 1] AS b, pos - floor(pos) AS f FROM r_{c}) i)")
    below = f"d_{c} AS (SELECT q, max(g) AS g_hi, min(g) AS g_lo, lead(q) OVER (ORDER BY q) AS q_next, lead(min(g)) OVER (ORDER BY q) AS g_next FROM q_{c} GROUP BY q)"
    p = f"p_{c} AS (SELECT l.loan_id, least(greatest(CASE WHEN l.{c} = d.q OR d.q_next IS NULL THEN (g_lo + g_hi) / 2 ELSE g_hi + (l.{c} - d.q) / (d.q_next - d.q) * (g_next - g_hi) END, 1e-7), 1 - 1e-7) AS p FROM loans l ASOF LEFT JOIN d_{c} d ON l.{c}::DOUBLE >= d.q)"
    return f"{edges}, {below}, {p}"


@query("e11_scale_quantile", f"WITH {LOANS}, {', '.join(map(_quantile_scaled, _SC))} SELECT loan_id, "
       + ", ".join(f"round({_acklam(f'p_{c}.p')}, 6) AS {c}" for c in _SC) + " FROM " + " JOIN ".join(f"p_{c}" + (" USING (loan_id)" if i else "") for i, c in enumerate(_SC)))
def e11q(spark, sf):
    out = X.scale(loans(spark, sf).select("loan_id", *_SC), "quantile", cols=_SC)
    return out.select("loan_id", *[F.round(c, 6).alias(c) for c in _SC])


@query("e12_encode_onehot", f"""WITH {GAPS} SELECT customer_id, CASE WHEN coalesce(loan_purpose, 'missing') = 'home' THEN 1.0 ELSE 0.0 END::DOUBLE AS loan_purpose_home,
 CASE WHEN loan_purpose IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS loan_purpose_missing, CASE WHEN coalesce(loan_purpose, 'missing') = 'personal' THEN 1.0 ELSE 0.0 END::DOUBLE AS loan_purpose_personal FROM gaps""")
def e12(spark, sf):
    return X.encode_onehot(applicants_with_gaps(spark, sf).select("customer_id", "loan_purpose"), ["loan_purpose"])


@query("e12_onehot_sparse", f"""WITH {LOANS}, c AS (SELECT loan_id, CAST(customer_id AS VARCHAR) AS u, coalesce(CAST(product_type AS VARCHAR), 'missing') AS p FROM loans),
 l AS (SELECT 'customer_id' AS name, u AS level, row_number() OVER (ORDER BY u) - 2 AS place FROM (SELECT DISTINCT u FROM c)
  UNION ALL SELECT 'product_type', p, row_number() OVER (ORDER BY p) - 2 + (SELECT count(DISTINCT u) - 1 FROM c) FROM (SELECT DISTINCT p FROM c)),
 k AS (SELECT name, level, place FROM l WHERE place >= CASE WHEN name = 'customer_id' THEN 0 ELSE (SELECT count(DISTINCT u) - 1 FROM c) END)
SELECT loan_id, coalesce(CAST(a.place AS VARCHAR), '') || CASE WHEN a.place IS NOT NULL AND b.place IS NOT NULL THEN ',' ELSE '' END || coalesce(CAST(b.place AS VARCHAR), '') AS positions
 FROM c LEFT JOIN k a ON a.name = 'customer_id' AND a.level = u LEFT JOIN k b ON b.name = 'product_type' AND b.level = p""")
def e12_sparse(spark, sf):
    """Customer and product as one sparse row; customers are far more than the columns of a table."""
    df = loans(spark, sf).select("loan_id", F.col("customer_id").cast("string").alias("customer_id"), "product_type")
    out = X.encode_onehot_sparse(df, ["customer_id", "product_type"])
    return out.select("loan_id", F.array_join(F.col("onehot").cast("array<string>"), ",").alias("positions"))


@query("e13_encode_label", f"WITH {LOANS} SELECT loan_id, CAST(dense_rank() OVER (ORDER BY product_type) - 1 AS INTEGER) AS product_type_code FROM loans")
def e13(spark, sf):
    return X.encode_label(loans(spark, sf), "product_type").select("loan_id", F.col("product_type_code").cast("int"))


@query("e14_preparation", rounded_sql(f"""WITH {GAPS}, f AS (SELECT customer_id, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM gaps)) AS age, coalesce(annual_income, (SELECT median(annual_income) FROM gaps)) AS annual_income, coalesce(loan_purpose, 'missing') AS p FROM gaps)
SELECT customer_id, (age - avg(age) OVER ()) / stddev_pop(age) OVER () AS age, (annual_income - avg(annual_income) OVER ()) / stddev_pop(annual_income) OVER () AS annual_income,
 CASE WHEN p = 'home' THEN 1.0 ELSE 0.0 END AS loan_purpose_home, CASE WHEN p = 'missing' THEN 1.0 ELSE 0.0 END AS loan_purpose_missing, CASE WHEN p = 'personal' THEN 1.0 ELSE 0.0 END AS loan_purpose_personal FROM f""",
    "customer_id", "age annual_income loan_purpose_home loan_purpose_missing loan_purpose_personal", 6))
def e14(spark, sf):
    df = applicants_with_gaps(spark, sf).select("customer_id", "age", "annual_income", "loan_purpose")
    return rounded(X.apply_preparation(df, X.fit_preparation(df, ["age", "annual_income"], ["loan_purpose"])), 6)


@query("e14_ml_stages")
def e14ml(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = applicants_with_gaps(spark, sf).withColumn("age", F.col("age").cast("double"))
    out = X.prep_pipeline(["age", "annual_income"], ["loan_purpose"]).fit(df).transform(df)
    return out.select("customer_id", vector_to_array("features").alias("v")).select("customer_id", *[F.col("v")[i].alias(f"f{i}") for i in range(5)])


@query("e14_full_preparation", f"""WITH {PANEL}, t AS (SELECT target, count(*) n, round(count(*) * 0.2) AS te FROM panel GROUP BY 1), v AS (SELECT *, round((n - te) * 0.25) AS va FROM t)
SELECT target, 'test' AS split, CAST(te AS BIGINT) AS n FROM v UNION ALL SELECT target, 'validation', CAST(va AS BIGINT) FROM v UNION ALL SELECT target, 'train', CAST(n - te - va AS BIGINT) FROM v""")
def e14f(spark, sf):
    return X.full_preparation(materialize(credit_panel(spark, sf), "panel"), "target", ["ID"]).groupBy("target", "split").agg(F.count("*").alias("n"))


_FEATS = ["LIMIT_BAL", "AGE", *PAY_COLS, *BILL_COLS]


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@query("e15_drop_correlated", f"WITH {LOANS}, r AS (" + union_sql(f"SELECT '{b}' AS c, corr({a}, {b}) AS r FROM loans" for a, b in _pairs(["loan_amount", "credit_score", "score_twice", "age"]) if "score_twice" not in (a, b))
       + " UNION ALL SELECT 'score_twice', corr(credit_score, 2 * credit_score + 1) FROM loans) SELECT c AS dropped FROM r WHERE abs(r) > 0.95")
def e15(spark, sf):
    df = loans(spark, sf).select("loan_amount", "credit_score", (2 * F.col("credit_score") + 1).alias("score_twice"), "age")
    kept = S.drop_correlated(df).columns
    return spark.createDataFrame([(c,) for c in df.columns if c not in kept], "dropped string")


@query("e16_anova_rank", rounded_sql(f"WITH {PANEL} " + union_sql(
    f"""SELECT '{c}' AS feature, (SELECT sum(n * pow(m - t, 2)) / (count(*) - 1) / (sum(v * n) / (sum(n) - count(*))) FROM (SELECT count(*) n, avg("{c}") m, var_pop("{c}") v, (SELECT avg("{c}") FROM panel) t FROM panel GROUP BY target)) AS score"""
    for c in _FEATS), "feature", "score", 5))
def e16(spark, sf):
    return rounded(S.anova_rank(credit_panel(spark, sf), "target", _FEATS), 5)


@query("e17_chi2_rank", rounded_sql(f"WITH {PANEL} " + union_sql(
    f"""SELECT '{c}' AS feature, (SELECT sum(pow(o - e, 2) / e) FROM (SELECT o, sum(o) OVER () * n / sum(n) OVER () AS e FROM (SELECT count(*) n, sum("{c}" - lo + 1) o FROM panel, (SELECT min("{c}") lo FROM panel) GROUP BY target))) AS score"""
    for c in _FEATS), "feature", "score", 3))
def e17(spark, sf):
    return rounded(S.chi2_rank(credit_panel(spark, sf), "target", _FEATS), 3)


def _mi(c):
    edges = ", ".join(f'quantile_cont("{c}", {i / 10}) AS q{i}' for i in range(1, 10))
    bins = " + ".join(f"(CASE WHEN x > q{i} THEN 1 ELSE 0 END)" for i in range(1, 10))
    return f"""SELECT '{c}' AS feature, (SELECT sum(n / t * ln(n * t / (a * b))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY target) AS a, sum(n) OVER (PARTITION BY bin) AS b
 FROM (SELECT target, {bins} AS bin, count(*)::DOUBLE AS n FROM (SELECT target, "{c}" AS x FROM panel), (SELECT {edges} FROM panel) GROUP BY 1, 2))) AS score"""


@query("e18_mutual_info_rank", rounded_sql(f"WITH {PANEL} " + union_sql(_mi(c) for c in ["LIMIT_BAL", *BILL_COLS]), "feature", "score", 6))
def e18(spark, sf):
    return rounded(S.mutual_info_rank(credit_panel(spark, sf), "target", ["LIMIT_BAL", *BILL_COLS]), 6)


@query("e19_rfe_rank")
def e19(spark, sf):
    names = S.rfe_rank(materialize(credit_panel(spark, sf).select("LIMIT_BAL", "AGE", *PAY_COLS, "target")), "target", ["LIMIT_BAL", "AGE", *PAY_COLS], k=5, trees=10, depth=4)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position int, feature string")


@query("e20_select_features", f"WITH {PANEL}, r AS (" + union_sql(
    f"""SELECT '{c}' AS feature, (SELECT sum(n * pow(m - t, 2)) / (count(*) - 1) / (sum(v * n) / (sum(n) - count(*))) FROM (SELECT count(*) n, avg("{c}") m, var_pop("{c}") v, (SELECT avg("{c}") FROM panel) t FROM panel GROUP BY target)) AS score"""
    for c in _FEATS) + ") SELECT feature FROM r ORDER BY score DESC LIMIT 6")
def e20(spark, sf):
    names = S.select_features(credit_panel(spark, sf), "target", "f_classif", 6, _FEATS)
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _psi(c):
    b = f"CASE WHEN {c} BETWEEN lo AND hi THEN least(floor(({c} - lo) / ((hi - lo) / 10)), 9) END"
    return f"""SELECT '{c}' AS feature, (SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(coalesce(e.n, 0) / (SELECT count({c}) FROM old), CASE WHEN e.n IS NULL THEN 0.0001 ELSE 0 END) AS e,
 greatest(coalesce(a.n, 0) / (SELECT count({c}) FROM new), CASE WHEN a.n IS NULL THEN 0.0001 ELSE 0 END) AS a FROM range(10) t(i)
 LEFT JOIN (SELECT {b} AS bin, count(*) n FROM old, (SELECT min({c}) lo, max({c}) hi FROM old) GROUP BY 1) e ON e.bin = i
 LEFT JOIN (SELECT {b} AS bin, count(*) n FROM new, (SELECT min({c}) lo, max({c}) hi FROM old) GROUP BY 1) a ON a.bin = i)) AS psi"""


_DRIFT = ["loan_amount", "credit_score", "annual_income", "customer_lifetime_value"]
_OLDNEW = LOANS + ", old AS (SELECT * FROM loans WHERE origination_date < TIMESTAMP '1998-07-01'), new AS (SELECT * REPLACE (loan_amount * 1.3 AS loan_amount) FROM loans WHERE origination_date >= TIMESTAMP '1998-07-01')"


@query("e21_psi", rounded_sql(f"WITH {_OLDNEW}, p AS (" + union_sql(_psi(c) for c in _DRIFT) + ") SELECT *, psi > 0.1 AS unstable FROM p", "feature unstable", "psi", 6))
def e21(spark, sf):
    df = loans(spark, sf)
    cut = F.lit("1998-07-01").cast("timestamp")
    new = df.where(F.col("origination_date") >= cut).withColumn("loan_amount", F.col("loan_amount") * 1.3)
    return rounded(S.psi(df.where(F.col("origination_date") < cut), new, _DRIFT), 6)


@query("j04_common_columns", rounded_sql(f"WITH {_OLDNEW}, p AS (" + union_sql(_psi(c) for c in ["loan_amount", "age"]) + ") SELECT feature, psi FROM p", "feature", "psi", 6))
def j04(spark, sf):
    df = loans(spark, sf)
    cut = F.lit("1998-07-01").cast("timestamp")
    new = df.where(F.col("origination_date") >= cut).select((F.col("loan_amount") * 1.3).alias("loan_amount"), "age", F.lit(1).alias("only_new"))
    old = df.where(F.col("origination_date") < cut).select("loan_amount", "age", "credit_score")
    return rounded(S.psi(old, new).select("feature", "psi"), 6)


@query("m09_bin_quantile", f"""WITH {LOANS}, q AS (SELECT {', '.join(f'quantile_cont(loan_amount, {i / 5}) AS q{i}' for i in range(1, 5))} FROM loans)
SELECT loan_id, CASE WHEN loan_amount <= q1 THEN 1 WHEN loan_amount <= q2 THEN 2 WHEN loan_amount <= q3 THEN 3 WHEN loan_amount <= q4 THEN 4 ELSE 5 END AS bin FROM loans, q""")
def m09(spark, sf):
    df = loans(spark, sf)
    q = quantile_dict(df, ["loan_amount"], [i / 5 for i in range(6)])["loan_amount"]
    return df.select("loan_id", bin_by_edges("loan_amount", [q[i / 5] for i in range(6)]).alias("bin"))


@query("a22_feature_report", f"""WITH {PANEL}, r AS (SELECT count(*) AS n FROM panel), i AS (SELECT 'original' AS item, {len(PANEL_FEATURES) + 2} AS n UNION ALL SELECT 'final', {len(PANEL_FEATURES) + 18} UNION ALL SELECT 'new', 16 UNION ALL SELECT 'removed', 0)
SELECT item, i.n, i.n / {float(len(PANEL_FEATURES) + 2)} AS ratio, r.n AS "rows", i.n * r.n AS cells FROM i, r""")
def a22(spark, sf):
    df = credit_panel(spark, sf)
    return Q.feature_report(df, E.features_basic(df)).select("item", "n", "ratio", "rows", "cells")
