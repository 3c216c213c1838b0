"""Columns, filters, validation, profiling and cleaning queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from creditspark.functions import expr as E
from creditspark.operators import clean as C
from creditspark.operators import columns as N
from creditspark.operators import profiling as Q
from creditspark.operators import rows as R
from creditspark.operators import validation as V
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.schemas import BILLS, CODE_LABELS, PAY_STATUS, PAYMENTS
from creditspark.sources.fixtures import (APPLICANTS, BILL_COLS, GAPS, LOANS, PAID_COLS, PANEL, applicants, applicants_with_gaps,
                                          credit_panel, loans, table)


def union_sql(parts):
    return " UNION ALL ".join(parts)


# --- P: columns ---------------------------------------------------------------

MESSY = {"c_custkey": "Customer ID", "c_name": "First Name", "c_acctbal": "Credit-Score", "c_mktsegment": " Employment Status "}


@query("p01_normalize_column_names", 'SELECT c_custkey AS customer_id, c_name AS first_name, c_nationkey, c_acctbal AS credit_score, c_mktsegment AS employment_status FROM customer')
def p01(spark, sf):
    return N.normalize_column_names(table(spark, sf, "customer").withColumnsRenamed(MESSY))


@query("p02_clean_column_names", f"""WITH {PANEL} SELECT "ID" AS id, "LIMIT_BAL" AS limit_bal, "PAY_0" AS pay_1, "PAY_2" AS pay_2, target AS default_payment_next_month FROM panel""")
def p02(spark, sf):
    df = credit_panel(spark, sf).withColumnRenamed("target", "default.payment.next.month")
    return N.clean_column_names(df).select("id", "limit_bal", "pay_1", "pay_2", "default_payment_next_month")


@query("p03_coerce_types", """SELECT CAST(o_orderkey AS VARCHAR) AS id, TRY_CAST(o_orderstatus AS DOUBLE) AS bad, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS good,
 CAST(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS INTEGER) AS target FROM orders""")
def p03(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("bad"), p.alias("good"), p.alias("target"))
    return N.coerce_types(df, numeric=["bad", "good"], ids=["id"], integers=["target"])


def _case(col, mapping):
    return "CASE " + col + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items()) + " END"


@query("p04_decode_categories", f"""WITH {PANEL} SELECT "ID", {_case('"SEX"', CODE_LABELS["SEX"])} AS "SEX_label", {_case('"EDUCATION"', CODE_LABELS["EDUCATION"])} AS "EDUCATION_label",
 {_case('"MARRIAGE"', CODE_LABELS["MARRIAGE"])} AS "MARRIAGE_label", {_case('"PAY_0"', CODE_LABELS["PAY"])} AS "PAY_0_label" FROM panel""")
def p04(spark, sf):
    return N.decode_categories(credit_panel(spark, sf)).select("ID", "SEX_label", "EDUCATION_label", "MARRIAGE_label", "PAY_0_label")


@query("j03_lookup_dimension", "SELECT c_custkey, c_nationkey, n_name AS c_nationkey_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j03(spark, sf):
    return N.decode_by_dimension(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name").select(
        "c_custkey", "c_nationkey", "c_nationkey_label")


@query("p05_select_columns", f"""WITH {GAPS} SELECT customer_id, coalesce(CAST(age AS DOUBLE), 0.0::DOUBLE) AS age, coalesce(annual_income, 0.0::DOUBLE) AS annual_income, 0.0::DOUBLE AS absent FROM gaps""")
def p05(spark, sf):
    return N.select_features(applicants_with_gaps(spark, sf), ["age", "annual_income", "absent"], keep=["customer_id"])


_P = "default_probability"


@query("p06_risk_band", f"""WITH {LOANS} SELECT loan_id, CASE WHEN {_P} < 0.3::DOUBLE THEN 'Low Risk' WHEN {_P} < 0.7::DOUBLE THEN 'Medium Risk' ELSE 'High Risk' END AS probability_band,
 CASE WHEN {_P} <= 0.3::DOUBLE THEN 'Low' WHEN {_P} <= 0.6::DOUBLE THEN 'Medium' ELSE 'High' END AS composite_band,
 CASE WHEN {_P} < 0.25 THEN 'Low Risk' WHEN {_P} < 0.5 THEN 'Medium Risk' WHEN {_P} < 0.75 THEN 'High Risk' ELSE 'Very High Risk' END AS quartile_band,
 CASE WHEN {_P} < 0.2::DOUBLE THEN 'Low Risk' WHEN {_P} < 0.5 THEN 'Medium Risk' WHEN {_P} < 0.8::DOUBLE THEN 'High Risk' ELSE 'Very High Risk' END AS config_band,
 CASE WHEN {_P} < 0.3::DOUBLE THEN '#2ca02c' WHEN {_P} < 0.7::DOUBLE THEN '#ff7f0e' ELSE '#d62728' END AS color FROM loans""")
def p06(spark, sf):
    return loans(spark, sf).select("loan_id", *[E.risk_band(_P, s).alias(f"{s}_band") for s in ("probability", "composite", "quartile", "config")],
                                   E.risk_color(E.risk_band(_P)).alias("color"))


@query("p07_score_band", f"""WITH {LOANS} SELECT band, count(*) n FROM (SELECT CASE WHEN credit_score BETWEEN 800 AND 850 THEN 'Excellent' WHEN credit_score BETWEEN 740 AND 799 THEN 'Very Good'
 WHEN credit_score BETWEEN 670 AND 739 THEN 'Good' WHEN credit_score BETWEEN 580 AND 669 THEN 'Fair' WHEN credit_score BETWEEN 300 AND 579 THEN 'Poor' END band FROM loans) GROUP BY 1""")
def p07(spark, sf):
    return loans(spark, sf).groupBy(E.score_band("credit_score").alias("band")).agg(F.count("*").alias("n"))


@query("p08_confidence_label", f"""WITH {LOANS} SELECT loan_id, CASE WHEN {_P} < 0.1::DOUBLE OR {_P} > 0.9::DOUBLE THEN 'High' WHEN {_P} < 0.3::DOUBLE OR {_P} > 0.7::DOUBLE THEN 'Medium' ELSE 'Low' END AS confidence FROM loans""")
def p08(spark, sf):
    return loans(spark, sf).select("loan_id", E.confidence_label(_P).alias("confidence"))


@query("p09_recommendation", f"""WITH {LOANS} SELECT loan_id, CASE WHEN {_P} >= 0.7::DOUBLE THEN 'REJECT - High risk of default. Consider declining the application.'
 WHEN {_P} >= 0.3::DOUBLE THEN 'REVIEW - Medium risk. Consider additional verification or reduced credit limit.'
 ELSE 'APPROVE - Low risk of default. Application can be approved.' END AS recommendation,
 CASE WHEN credit_score / 8.5 >= 70 THEN 'Reject' WHEN credit_score / 8.5 >= 40 THEN 'Review Required' ELSE 'Approve' END AS by_score FROM loans""")
def p09(spark, sf):
    return loans(spark, sf).select("loan_id", E.recommendation(_P).alias("recommendation"), E.recommendation(F.col("credit_score") / 8.5, "score").alias("by_score"))


@query("p11_format_values", f"""WITH {GAPS} SELECT customer_id, coalesce(format('${{:,.2f}}', annual_income), 'N/A') AS income_text, coalesce(format('{{:.1f}}%', credit_score / 850.0::DOUBLE * 100), 'N/A') AS pct_text,
 CASE WHEN length(loan_purpose) > 6 THEN substr(loan_purpose, 1, 3) || '...' ELSE loan_purpose END AS short_text,
 coalesce(format('{{:.2e}}', annual_income), 'N/A') AS sci_text FROM gaps""")
def p11(spark, sf):
    return applicants_with_gaps(spark, sf).select(
        "customer_id", E.format_value("annual_income", "currency").alias("income_text"),
        E.format_value(F.col("credit_score") / 850.0, "percentage", 1).alias("pct_text"),
        E.truncate_text("loan_purpose", 6).alias("short_text"), E.format_value("annual_income", "scientific").alias("sci_text"))


@query("p12_flatten_struct", """SELECT o_orderkey AS "order.key", o_custkey AS "order.customer.id", o_totalprice AS "total" FROM orders""")
def p12(spark, sf):
    o = table(spark, sf, "orders").select(
        F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id")).alias("customer")).alias("order"),
        F.col("o_totalprice").alias("total"))
    return N.flatten_struct(o)


@query("p13_mask_pii", "SELECT c_custkey, sha256(c_name) AS email FROM customer")
def p13(spark, sf):
    return N.mask_pii(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("email")))


@query("p14_unique_id", "SELECT c_custkey, 'CUST_' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS id FROM customer")
def p14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.unique_id("CUST_", 12, keys=["c_custkey"]).alias("id"))


@query("s11_missing_markers", """SELECT c_custkey, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_mktsegment END AS segment, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation FROM customer""")
def s11(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "AUTOMOBILE", "N/A").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") == 7, -999).otherwise(F.col("c_nationkey")).alias("nation"))
    return N.missing_markers(df)


@query("m01_safe_divide", f"WITH {APPLICANTS} SELECT customer_id, coalesce(existing_debt / nullif(previous_defaults, 0), 0.0) AS ratio FROM applicants")
def m01(spark, sf):
    return applicants(spark, sf).select("customer_id", E.safe_divide("existing_debt", "previous_defaults").alias("ratio"))


@query("m02_utilization_payment_ratio", rounded_sql(f"""WITH {PANEL} SELECT "ID", coalesce("BILL_AMT1" / nullif("LIMIT_BAL", 0), 0) AS utilization, coalesce("PAY_AMT1" / nullif("BILL_AMT1", 0), 0) AS paid FROM panel""",
                                                    "ID", "utilization paid", 8))
def m02(spark, sf):
    return rounded(credit_panel(spark, sf).select("ID", E.credit_utilization("BILL_AMT1", "LIMIT_BAL").alias("utilization"),
                                                  E.payment_ratio("PAY_AMT1", "BILL_AMT1").alias("paid")), 8)


_BILL_LIST = "[" + ", ".join(f'"{c}"' for c in BILL_COLS) + "]"


@query("m03_row_stats", rounded_sql(f"""WITH {PANEL} SELECT "ID", list_avg({_BILL_LIST}) AS mean, list_max({_BILL_LIST}) AS max, list_min({_BILL_LIST}) AS min, list_stddev_samp({_BILL_LIST}) AS std,
 list_sum({_BILL_LIST}) AS total FROM panel""", "ID", "mean max min std total", 3))
def m03(spark, sf):
    return rounded(credit_panel(spark, sf).select(
        "ID", E.row_mean(BILL_COLS).alias("mean"), E.row_max(BILL_COLS).alias("max"), E.row_min(BILL_COLS).alias("min"),
        E.row_std(BILL_COLS).alias("std"), E.row_sum(BILL_COLS).alias("total")), 3)


@query("m15_json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS details FROM events""")
def m15(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("details"))


# --- F: filters and validation ------------------------------------------------

@query("f01_in_filter", f"WITH {LOANS} SELECT loan_id FROM loans WHERE product_type IN ('AUTOMOBILE', 'BUILDING') AND risk_category = 'High'")
def f01(spark, sf):
    return R.in_filter(loans(spark, sf), {"product_type": ["AUTOMOBILE", "BUILDING"], "risk_category": "High", "absent": 1}).select("loan_id")


@query("f02_range_filter", f"""WITH {LOANS} SELECT loan_id FROM loans WHERE origination_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
 AND credit_score BETWEEN 500 AND 700 AND annual_income >= 40000""")
def f02(spark, sf):
    return R.range_filter(loans(spark, sf), {
        "origination_date": (datetime(1996, 1, 1), datetime(1998, 12, 31)),
        "credit_score": (500, 700), "annual_income": (40000, None)}).select("loan_id")


@query("f03_search_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def f03(spark, sf):
    return R.search_filter(table(spark, sf, "part"), "p_name", "Red").select("p_partkey", "p_name")


_GAPCOLS = ["customer_id", "age", "annual_income", "credit_score", "loan_purpose", "existing_debt", "defaulted"]
_NULLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _GAPCOLS)


@query("f05_validate_frame", f"""WITH {GAPS}, c AS (SELECT count(*) AS n, CAST(sum({_NULLS}) AS BIGINT) AS nulls FROM gaps), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM gaps))
SELECT 'info' AS severity, 'rows' AS "check", n FROM c UNION ALL SELECT 'error', 'too_few_rows', CASE WHEN n < 10 THEN 1 ELSE 0 END FROM c
UNION ALL SELECT 'error', 'too_many_rows', CASE WHEN n > 100 THEN 1 ELSE 0 END FROM c
UNION ALL SELECT 'warning', 'null_values', nulls FROM c UNION ALL SELECT 'warning', 'duplicate_rows', n - k FROM c, d UNION ALL SELECT 'error', 'missing_column:income', 1
UNION ALL {union_sql(f"SELECT 'info', 'nulls:{c}', count(*) - count({c}) FROM gaps" for c in _GAPCOLS)}""")
def f05(spark, sf):
    return V.validate_frame(applicants_with_gaps(spark, sf), ["age", "income"], 10, 100)


_CARD = [("error", "target_domain", "target NOT IN (0, 1)"), ("warning", "sex_domain", '"SEX" NOT IN (1, 2)'), ("warning", "education_domain", '"EDUCATION" NOT BETWEEN 0 AND 6'),
         ("warning", "marriage_domain", '"MARRIAGE" NOT BETWEEN 0 AND 3'), ("warning", "age_range", '"AGE" NOT BETWEEN 18 AND 100'), ("error", "negative_limit", '"LIMIT_BAL" < 0'),
         *[("warning", f"{c}_range", f'"{c}" NOT BETWEEN -2 AND 8') for c in PAY_STATUS], *[("warning", f"{c}_negative", f'"{c}" < 0') for c in [*BILLS, *PAYMENTS]]]


@query("f06_validate_uci", f"""WITH {PANEL} {union_sql(f"SELECT '{s}' AS severity, '{n}' AS " + '"check"' + f", count(*) FILTER (WHERE {c}) AS n FROM panel" for s, n, c in _CARD)}
UNION ALL SELECT 'warning', 'default_rate_bounds', CASE WHEN avg(target) BETWEEN 0.1 AND 0.5 THEN 0 ELSE 1 END FROM panel""")
def f06(spark, sf):
    return V.validate_card_clients(credit_panel(spark, sf), "target")


_RANGES = {"age": (18, 100), "credit_score": (300, 850), "debt_to_income_ratio": (0, 1), "employment_length": (0, 50), "loan_amount": (1000, 300000)}


@query("f07_validate_ranges", f"WITH {APPLICANTS} " + union_sql(
    f"SELECT 'error' AS severity, '{c}:below' AS \"check\", count(*) FILTER (WHERE {c} < {lo}) AS n FROM applicants UNION ALL SELECT 'error', '{c}:above', count(*) FILTER (WHERE {c} > {hi}) FROM applicants UNION ALL SELECT 'error', '{c}:not_numeric', 0"
    for c, (lo, hi) in _RANGES.items()))
def f07(spark, sf):
    return V.validate_ranges(applicants(spark, sf), _RANGES)


@query("f08_validate_batch", f"""WITH {GAPS} SELECT 'error' AS severity, 'age_range' AS "check", count(*) FILTER (WHERE age NOT BETWEEN 0 AND 120) AS n FROM gaps
UNION ALL SELECT 'error', 'negative_income', count(*) FILTER (WHERE annual_income < 0) FROM gaps UNION ALL SELECT 'error', 'null:age', count(*) - count(age) FROM gaps
UNION ALL SELECT 'error', 'null:annual_income', count(*) - count(annual_income) FROM gaps
UNION ALL {union_sql(f"SELECT 'error', 'missing_column:{c}', count(*) FROM gaps" for c in V.BATCH_REQUIRED if c not in _GAPCOLS)}""")
def f08(spark, sf):
    return V.validate_batch(applicants_with_gaps(spark, sf))


@query("f09_split_valid", f"""WITH {GAPS} SELECT customer_id, age, annual_income, age IS NOT NULL AND annual_income IS NOT NULL AS accepted,
 (age IS NULL)::INTEGER + (annual_income IS NULL)::INTEGER AS n_errors FROM gaps""")
def f09s(spark, sf):
    good, bad = V.split_valid(applicants_with_gaps(spark, sf).select("customer_id", "age", "annual_income"), {"age": "int", "annual_income": "double"})
    return good.withColumns({"accepted": F.lit(True), "n_errors": F.lit(0)}).unionByName(
        bad.withColumns({"accepted": F.lit(False), "n_errors": F.size("errors")}).drop("errors"))


@query("f09_validate_model_input", f"""WITH {GAPS} SELECT customer_id, concat_ws('; ', CASE WHEN age IS NULL THEN 'Feature ''age'' cannot be None' END,
 CASE WHEN annual_income IS NULL THEN 'Feature ''annual_income'' cannot be None' END, CASE WHEN loan_purpose IS NULL THEN 'Feature ''loan_purpose'' cannot be None' ELSE 'Feature ''loan_purpose'' type error' END) AS errors FROM gaps""")
def f09(spark, sf):
    out = V.validate_model_input(applicants_with_gaps(spark, sf), {"age": "int", "annual_income": "double", "loan_purpose": "double"})
    return out.select("customer_id", F.concat_ws("; ", "errors").alias("errors"))


_PROC = ["LIMIT_BAL", "AGE", "BILL_AMT1", "PAY_AMT1"]


@query("f10_validate_processed", f"WITH {PANEL} " + union_sql(
    f"SELECT 'error' AS severity, '{c}:infinite' AS \"check\", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'warning', '{c}:extreme', CASE WHEN max(abs(\"{c}\")) > 1000 THEN 1 ELSE 0 END FROM panel" for c in _PROC)
    + " UNION ALL SELECT 'warning', 'minority_below_5pct', CASE WHEN least(avg(target), 1 - avg(target)) < 0.05 THEN 1 ELSE 0 END FROM panel")
def f10(spark, sf):
    return V.validate_processed(credit_panel(spark, sf), "target", _PROC)


@query("f11_row_rules", r"""SELECT c_custkey, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS valid_email, regexp_matches(phone, '^\+?1?\d{9,15}$') AS valid_phone,
 coalesce(TRY_CAST(score AS DOUBLE) BETWEEN 300 AND 850, false) AS valid_score FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no-at-sign' ELSE lower(c_name) || '@bank.com' END AS email,
 '+1' || CAST(c_custkey * 1234567 AS VARCHAR) AS phone, CASE WHEN c_custkey % 9 = 0 THEN 'abc' ELSE CAST(c_custkey AS VARCHAR) END AS score FROM customer)""")
def f11(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(
        k, F.when(k % 5 == 0, "no-at-sign").otherwise(F.concat(F.lower("c_name"), F.lit("@bank.com"))).alias("email"),
        F.concat(F.lit("+1"), (k * 1234567).cast("string")).alias("phone"), F.when(k % 9 == 0, "abc").otherwise(k.cast("string")).alias("score"))
    return V.row_rules(df, "email", "phone", "score").select("c_custkey", "valid_email", "valid_phone", "valid_score")


@query("f12_schema_match", f"""WITH {GAPS} SELECT 'missing' AS kind, 'income' AS "column", CAST(0 AS BIGINT) AS "values" UNION ALL SELECT 'extra', 'annual_income', count(annual_income) FROM gaps
UNION ALL SELECT 'extra', 'loan_purpose', count(loan_purpose) FROM gaps UNION ALL SELECT 'extra', 'existing_debt', count(existing_debt) FROM gaps UNION ALL SELECT 'extra', 'defaulted', count(defaulted) FROM gaps""")
def f12(spark, sf):
    return V.schema_match(applicants_with_gaps(spark, sf), ["customer_id", "age", "income", "credit_score"])


# --- K: sorting, top-k, sampling, sets -----------------------------------------

@query("k01_head_preview", f"WITH {LOANS} SELECT loan_id, loan_amount FROM loans ORDER BY loan_id LIMIT 5")
def k01(spark, sf):
    return R.head(loans(spark, sf).select("loan_id", "loan_amount"), ["loan_id"], 5)


@query("k02_paginate", f"WITH {LOANS} SELECT loan_id, loan_amount FROM loans ORDER BY loan_amount DESC, loan_id LIMIT 10 OFFSET 20")
def k02(spark, sf):
    return R.paginate(loans(spark, sf).select("loan_id", "loan_amount"), [F.desc("loan_amount"), "loan_id"], 3, 10)


@query("k02_page_after", f"WITH {LOANS} SELECT loan_id FROM loans WHERE loan_id > 5000 ORDER BY loan_id LIMIT 25")
def k02b(spark, sf):
    return R.page_after(loans(spark, sf).select("loan_id"), "loan_id", 5000, 25)


@query("k03_top_k", f"""WITH {LOANS} SELECT product_type, loan_id, loan_amount, CAST("rank" AS INTEGER) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY loan_amount DESC, loan_id) AS "rank" FROM loans) WHERE "rank" <= 5""")
def k03(spark, sf):
    return R.top_k_per_group(loans(spark, sf), ["product_type"], "loan_amount", 5, tie=["loan_id"]).select("product_type", "loan_id", "loan_amount", "rank")


@query("k04_sort_by_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC")
def k04(spark, sf):
    return R.sort_by_abs(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])


@query("k05_best_by_metric", rounded_sql(f"WITH {LOANS}, m AS (SELECT region, product_type, avg(default_probability) AS pd FROM loans GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pd, product_type) k FROM m) SELECT region, product_type, pd FROM r WHERE k = 1",
                                         "region product_type", "pd", 8))
def k05(spark, sf):
    m = loans(spark, sf).groupBy("region", "product_type").agg(F.avg("default_probability").alias("pd"))
    return rounded(R.best_by(m, "product_type", "pd", largest=False, by=["region"]), 8)


@query("k05_best_by_mean_metric", rounded_sql(f"WITH {LOANS}, m AS (SELECT region, product_type, avg(1 - default_probability) AS safe, avg(credit_score) / 850 AS score FROM loans GROUP BY 1, 2), r AS (SELECT region, product_type, (safe + score) / 2 AS mean_metric, row_number() OVER (PARTITION BY region ORDER BY (safe + score) / 2 DESC, product_type) k FROM m) SELECT region, product_type, mean_metric FROM r WHERE k = 1",
                                              "region product_type", "mean_metric", 8))
def k05_mean(spark, sf):
    m = loans(spark, sf).groupBy("region", "product_type").agg(F.avg(1 - F.col("default_probability")).alias("safe"), (F.avg("credit_score") / 850).alias("score"))
    return rounded(R.best_by_mean(m, "product_type", ["safe", "score"], by=["region"]), 8)


@query("k06_sample_rows")
def k06(spark, sf):
    return R.sample_rows(loans(spark, sf), ["loan_id"], 100).select("loan_id", "loan_amount")


@query("k07_stratified_split", f"""WITH {PANEL}, t AS (SELECT target, count(*) n, round(count(*) * 0.2) AS te FROM panel GROUP BY 1), v AS (SELECT *, round((n - te) * 0.25) AS va FROM t)
SELECT target, 'test' AS split, CAST(te AS BIGINT) AS n FROM v UNION ALL SELECT target, 'validation', CAST(va AS BIGINT) FROM v UNION ALL SELECT target, 'train', CAST(n - te - va AS BIGINT) FROM v""")
def k07(spark, sf):
    return R.stratified_split(credit_panel(spark, sf), ["ID"], "target").groupBy("target", "split").agg(F.count("*").alias("n"))


@query("k08_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def k08(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.set_difference(table(spark, sf, "customer"), big, ["c_custkey"]).select("c_custkey")


@query("k09_append_rows", f"WITH {GAPS} SELECT customer_id, count(*) AS n FROM gaps GROUP BY 1")
def k09(spark, sf):
    base = applicants(spark, sf).select("customer_id")
    return R.append_rows(base, base.where(F.col("customer_id") % 50 == 0)).groupBy("customer_id").agg(F.count("*").alias("n"))


@query("t06_class_balance", f"""WITH {PANEL}, t AS (SELECT target, count(*) n FROM panel GROUP BY 1), m AS (SELECT min(n) lo, max(n) hi FROM t)
SELECT 'under' AS method, target, lo AS n FROM t, m UNION ALL SELECT 'over', target, hi FROM t, m""")
def t06(spark, sf):
    p = credit_panel(spark, sf).select("ID", "target")
    parts = [R.class_balance(p, ["ID"], "target", m).groupBy("target").agg(F.count("*").alias("n")).select(F.lit(m).alias("method"), "target", "n")
             for m in ("under", "over")]
    return parts[0].unionByName(parts[1])


# --- A18-A32: profiling -------------------------------------------------------

_NUMS = ["loan_amount", "credit_score", "annual_income"]


@query("a18_describe", rounded_sql(f"WITH {LOANS} " + union_sql(
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM loans" for c in _NUMS),
    "feature count", "mean std min q25 q50 q75 max", 3))
def a18(spark, sf):
    return rounded(Q.describe(loans(spark, sf), _NUMS), 3)


@query("a19_column_stats", rounded_sql(f"WITH {LOANS} " + union_sql(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS variance, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, min({c}) AS min, max({c}) AS max, max({c}) - min({c}) AS range, median({c}) AS median, (SELECT {c} FROM loans GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM loans"
    for c in ["credit_score", "annual_income", "interest_rate"]), "feature", "mean std variance skewness kurtosis min max range median mode", 3))
def a19(spark, sf):
    return rounded(Q.column_stats(loans(spark, sf), ["credit_score", "annual_income", "interest_rate"]), 3)


@query("a20_dataset_info", f"""WITH {GAPS}, c AS (SELECT count(*) AS n, sum({_NULLS}) AS nulls FROM gaps), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM gaps))
SELECT 'rows' AS item, CAST(n AS DOUBLE) AS value FROM c UNION ALL SELECT 'columns', 7 UNION ALL SELECT 'missing_cells', nulls FROM c UNION ALL SELECT 'duplicate_rows', n - k FROM c, d
UNION ALL SELECT 'numeric_columns', 6 UNION ALL SELECT 'text_columns', 1 UNION ALL SELECT 'defaulted=' || defaulted, count(*) FROM gaps GROUP BY defaulted""")
def a20(spark, sf):
    return Q.dataset_info(applicants_with_gaps(spark, sf), "defaulted")


@query("a21_feature_metadata", rounded_sql(f"WITH {GAPS} " + union_sql(
    f"SELECT '{c}' AS feature, '{t}' AS dtype, count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(DISTINCT {c}) AS \"distinct\", "
    + ("NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS skewness" if t == "string" else f"avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, skewness({c}) AS skewness") + " FROM gaps"
    for c, t in zip(_GAPCOLS, ["bigint", "int", "double", "int", "string", "double", "int"])), "feature dtype nulls distinct", "null_pct mean std min max skewness"))
def a21(spark, sf):
    return rounded(Q.feature_metadata(applicants_with_gaps(spark, sf)))


@query("a23_missing_report", rounded_sql(f"WITH {GAPS} " + union_sql(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM gaps" for c in ["age", "annual_income", "credit_score", "loan_purpose", "existing_debt"]),
    "feature missing", "missing_pct"))
def a23(spark, sf):
    return rounded(Q.missing_report(applicants_with_gaps(spark, sf)))


_FLAGS = ["age", "annual_income", "credit_score", "loan_purpose", "existing_debt"]
_FLAGSQL = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in _FLAGS)


@query("a24_missing_pattern", f"WITH {GAPS} SELECT {', '.join(_FLAGS)}, count(*) AS n FROM (SELECT {_FLAGSQL} FROM gaps) GROUP BY ALL")
def a24(spark, sf):
    return Q.missing_pattern(applicants_with_gaps(spark, sf), _FLAGS)


@query("a25_quality_score", rounded_sql(f"""WITH {GAPS}, c AS (SELECT count(*) AS n, CAST(sum({_NULLS}) AS BIGINT) AS nulls FROM gaps), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM gaps)),
s AS (SELECT (n * 7 - nulls) * 100.0 / (n * 7) AS completeness, k * 100.0 / n AS uniqueness, 6 * 100.0 / 7 AS consistency, nulls AS missing_cells, n - k AS duplicate_rows, n * 7 AS total_cells, nulls * 100.0 / (n * 7) AS missing_percentage, (n - k) * 100.0 / n AS duplicate_percentage FROM c, d)
SELECT *, (completeness + uniqueness + consistency) / 3 AS overall FROM s""", "missing_cells duplicate_rows total_cells", "completeness uniqueness consistency missing_percentage duplicate_percentage overall"))
def a25(spark, sf):
    return rounded(Q.quality_score(applicants_with_gaps(spark, sf)))


@query("a26_infer_feature_types", f"WITH {PANEL} " + union_sql(
    f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT \"{c}\") < 10 AND count(DISTINCT \"{c}\") / count(*) < 0.05 THEN 'categorical' ELSE 'numeric' END AS kind FROM panel"
    for c in ["LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", *PAY_STATUS, *BILLS, *PAYMENTS]))
def a26(spark, sf):
    return Q.infer_feature_types(credit_panel(spark, sf), ["ID", "target"])


_CORR = ["loan_amount", "credit_score", "annual_income", "debt_to_income", "default_probability", "age"]


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@query("a27_correlation_matrix", rounded_sql(f"WITH {LOANS} " + union_sql(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM loans" for a, b in _pairs(_CORR)), "a b", "r", 6))
def a27(spark, sf):
    return rounded(Q.correlation_pairs(loans(spark, sf), _CORR), 6)


_RANKED = ["age", "credit_score", "annual_income"]
_RANKSQL = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKED)


@query("a27_spearman", rounded_sql(f"WITH {APPLICANTS}, rk AS (SELECT {_RANKSQL} FROM applicants) " + union_sql(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rk" for a, b in _pairs(_RANKED)), "a b", "r", 6))
def a27s(spark, sf):
    return rounded(Q.correlation_pairs(applicants(spark, sf), _RANKED, "spearman"), 6)


@query("a28_target_correlation", rounded_sql(f"WITH {PANEL}, r AS (" + union_sql(f"SELECT '{c}' AS feature, corr(\"{c}\", target) AS r FROM panel" for c in ["LIMIT_BAL", "AGE", *PAY_STATUS, *BILLS]) + ") SELECT feature, r, abs(r) AS abs_r FROM r ORDER BY abs(r) DESC LIMIT 10",
                                             "feature", "r abs_r", 6))
def a28(spark, sf):
    return rounded(Q.target_correlation(credit_panel(spark, sf), "target", ["LIMIT_BAL", "AGE", *PAY_STATUS, *BILLS]), 6)


@query("a29_percentiles", rounded_sql(f"WITH {LOANS} " + union_sql(f"SELECT risk_category, 'loan_amount' AS feature, {p / 100}::DOUBLE AS p, quantile_cont(loan_amount, {p / 100}) AS value FROM loans GROUP BY 1" for p in (25, 50, 75, 90, 95)), "risk_category feature", "p value", 4))
def a29(spark, sf):
    return rounded(Q.percentiles(loans(spark, sf), "loan_amount", (25, 50, 75, 90, 95), ["risk_category"]), 4)


@query("a31_duplicates", f"WITH {GAPS} SELECT count(*) AS \"rows\", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) AS duplicates FROM gaps")
def a31(spark, sf):
    return Q.duplicate_count(applicants_with_gaps(spark, sf))


@query("a31_duplicate_groups", f"WITH {GAPS} SELECT customer_id, age, annual_income, loan_purpose, count(*) AS copies FROM gaps GROUP BY ALL HAVING count(*) > 1")
def a31g(spark, sf):
    return Q.duplicate_groups(applicants_with_gaps(spark, sf), ["customer_id", "age", "annual_income", "loan_purpose"])


@query("a31_drop_duplicates", f"WITH {LOANS} SELECT customer_id, loan_id, loan_amount FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY origination_date, loan_id) AS rn FROM loans) WHERE rn = 1")
def a31d(spark, sf):
    return Q.drop_duplicates(loans(spark, sf).select("customer_id", "loan_id", "loan_amount", "origination_date"), ["customer_id"],
                             ["origination_date", "loan_id"]).select("customer_id", "loan_id", "loan_amount")


@query("a32_box_stats", rounded_sql(f"""WITH {LOANS}, b AS (SELECT region, min(loan_amount) AS min, max(loan_amount) AS max, count(*) AS n, quantile_cont(loan_amount, 0.25) AS q1, median(loan_amount) AS median, quantile_cont(loan_amount, 0.75) AS q3 FROM loans GROUP BY 1)
SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM b""", "region n", "min max q1 median q3 lower_fence upper_fence", 4))
def a32(spark, sf):
    return rounded(Q.box_stats(loans(spark, sf), "loan_amount", "region"), 4)


@query("a38_target_balance", rounded_sql(f"WITH {PANEL} SELECT target, count(*) n, count(*) / sum(count(*)) OVER () AS share FROM panel GROUP BY 1", "target n", "share", 6))
def a38(spark, sf):
    return rounded(Q.target_balance(credit_panel(spark, sf), "target"), 6)


# --- C: cleaning --------------------------------------------------------------

@query("c01_impute_auto", f"""WITH {GAPS}, f AS (SELECT median(age) a, median(annual_income) i, median(credit_score) c, (SELECT loan_purpose FROM gaps WHERE loan_purpose IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) p FROM gaps)
SELECT customer_id, CAST(coalesce(age, a) AS DOUBLE) AS age, coalesce(annual_income, i) AS annual_income, CAST(coalesce(credit_score, c) AS DOUBLE) AS credit_score, coalesce(loan_purpose, p) AS loan_purpose, defaulted FROM gaps, f""")
def c01(spark, sf):
    out = C.impute_auto(applicants_with_gaps(spark, sf))
    return out.withColumns({"age": F.col("age").cast("double"), "credit_score": F.col("credit_score").cast("double")})


@query("c02_impute_simple", rounded_sql(f"WITH {GAPS}, f AS (SELECT avg(annual_income) i, avg(existing_debt) d FROM gaps) SELECT customer_id, coalesce(annual_income, i) AS annual_income, coalesce(existing_debt, d) AS existing_debt FROM gaps, f",
                                        "customer_id", "annual_income existing_debt"))
def c02(spark, sf):
    return rounded(C.impute(applicants_with_gaps(spark, sf), "mean", ["annual_income", "existing_debt", "loan_purpose"]).select("customer_id", "annual_income", "existing_debt"))


_OUT = ["loan_amount", "acquisition_cost", "default_probability"]


def _fence(c, k):
    return f"quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower, quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper"


@query("c04_outlier_flags", rounded_sql(f"WITH {LOANS} " + union_sql(
    f"SELECT '{c}' AS feature, lower, upper, count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outliers, count(*) FILTER (WHERE {c} < lower OR {c} > upper) * 100.0 / count(*) AS outlier_pct FROM loans, (SELECT {_fence(c, 0.1)} FROM loans) GROUP BY lower, upper"
    for c in _OUT), "feature outliers", "lower upper outlier_pct"))
def c04(spark, sf):
    return rounded(C.outlier_report(loans(spark, sf), _OUT, threshold=0.1))


@query("c04_zscore_flags", f"WITH {LOANS}, s AS (SELECT avg(loan_amount) m, stddev_pop(loan_amount) d FROM loans) SELECT loan_id, CASE WHEN abs(loan_amount - m) > 1.5 * d THEN 1 ELSE 0 END AS loan_amount_outlier FROM loans, s")
def c04z(spark, sf):
    return C.outlier_flags(loans(spark, sf), ["loan_amount"], "zscore").select("loan_id", "loan_amount_outlier")


@query("c05_handle_outliers", rounded_sql(f"WITH {LOANS}, f AS (SELECT {_fence('loan_amount', 0.1)} FROM loans) SELECT loan_id, greatest(lower, least(upper, loan_amount)) AS loan_amount FROM loans, f", "loan_id", "loan_amount"))
def c05(spark, sf):
    return rounded(C.handle_outliers(loans(spark, sf).select("loan_id", "loan_amount"), ["loan_amount"], threshold=0.1))


@query("c05_remove_sequential", f"""WITH {LOANS}, f AS (SELECT {_fence('loan_amount', 0.1)} FROM loans), l2 AS (SELECT l.* FROM loans l, f WHERE loan_amount BETWEEN lower AND upper), g AS (SELECT {_fence('annual_income', 0.1)} FROM l2)
SELECT loan_id FROM l2, g WHERE annual_income BETWEEN lower AND upper""")
def c05r(spark, sf):
    return C.handle_outliers(loans(spark, sf), ["loan_amount", "annual_income"], action="remove", threshold=0.1, sequential=True).select("loan_id")


@query("c06_infinity_cleanup", rounded_sql("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS ratio FROM lineitem), m AS (SELECT median(ratio) m FROM s)
SELECT l_orderkey, l_linenumber, coalesce(ratio, m) AS ratio FROM s, m""", "l_orderkey l_linenumber", "ratio", 6))
def c06(spark, sf):
    d = F.col("l_discount") + 0.0
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             F.when(d > 0, F.col("l_tax") / F.when(d > 0, d)).otherwise(float("inf")).alias("ratio"))
    return rounded(C.infinity_cleanup(df, ["ratio"]), 6)


@query("c07_drop_constant", f"WITH {LOANS} SELECT loan_id, loan_amount FROM loans")
def c07(spark, sf):
    return C.drop_constant(loans(spark, sf).select("loan_id", "loan_amount", F.lit(7).alias("same")))


_TAU = ["age", "previous_defaults"]


@query("a27_kendall", rounded_sql(f"""WITH {APPLICANTS}, s AS (SELECT sum(sign(p.age - q.age) * sign(p.previous_defaults - q.previous_defaults)) / 2 AS s FROM applicants p, applicants q),
n AS (SELECT count(*) * (count(*) - 1) / 2 AS n0 FROM applicants), t1 AS (SELECT sum(c * (c - 1) / 2) AS n1 FROM (SELECT count(*) c FROM applicants GROUP BY age)), t2 AS (SELECT sum(c * (c - 1) / 2) AS n2 FROM (SELECT count(*) c FROM applicants GROUP BY previous_defaults))
SELECT 'age' AS a, 'previous_defaults' AS b, s / sqrt((n0 - n1) * (n0 - n2)) AS r FROM s, n, t1, t2""", "a b", "r", 8))
def a27k(spark, sf):
    return rounded(Q.correlation_pairs(applicants(spark, sf), _TAU, "kendall"), 8)
