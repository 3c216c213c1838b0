"""Queries on rule-based scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import scoring as S
from creditspark.operators.text import factor_lists, reason_codes, risk_explanation
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.sources.fixtures import APPLICANTS, LOANS, PANEL, applicants, credit_panel, loans

SCORED = APPLICANTS + """, scored AS (
SELECT *, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
 CASE WHEN risk_score >= 70 THEN 'Reject' WHEN risk_score >= 40 THEN 'Review Required' ELSE 'Approve' END AS recommendation
FROM (SELECT *, CAST(greatest(0, least(100, 50
 + CASE WHEN age < 25 THEN 10 WHEN age > 60 THEN 5 ELSE -5 END
 + CASE WHEN annual_income < 30000 THEN 15 WHEN annual_income > 80000 THEN -10 ELSE 0 END
 + CASE WHEN monthly_expenses / (annual_income / 12) > 0.5 THEN 20
        WHEN monthly_expenses / (annual_income / 12) < 0.3 THEN -10 ELSE 0 END
 + CASE WHEN credit_history_length < 2 THEN 15 WHEN credit_history_length > 10 THEN -10 ELSE 0 END
 + 10 * previous_defaults
 + CASE WHEN credit_utilization > 80 THEN 15 WHEN credit_utilization < 30 THEN -5 ELSE 0 END
 + CASE WHEN existing_debt > 0.5 * annual_income THEN 10 ELSE 0 END)) AS INTEGER) AS risk_score FROM applicants))"""


def scored(spark, sf):
    return S.applicant_score(applicants(spark, sf))


@query("r02_applicant_score", f"WITH {SCORED} SELECT customer_id, risk_score, risk_level, recommendation FROM scored")
def r02(spark, sf):
    return scored(spark, sf).select("customer_id", "risk_score", "risk_level", "recommendation")


def risk_by_level(spark, sf):
    return rounded(scored(spark, sf).groupBy("risk_level").agg(
        F.count("*").alias("n"), F.avg("risk_score").alias("mean_score"), F.avg("annual_income").alias("mean_income")))


query("r02_risk_by_level", rounded_sql(
    f"WITH {SCORED} SELECT risk_level, count(*) n, avg(risk_score) mean_score, avg(annual_income) mean_income FROM scored GROUP BY 1",
    "risk_level n", "mean_score mean_income"))(risk_by_level)


@query("a14_batch_summary", rounded_sql(f"""WITH {SCORED} SELECT count(*) total, avg(risk_score) mean_score,
 count(*) FILTER (WHERE risk_level = 'High') high_count, count(*) FILTER (WHERE risk_level = 'Medium') medium_count,
 count(*) FILTER (WHERE risk_level = 'Low') low_count,
 count(*) FILTER (WHERE risk_level = 'High') / count(*) high_share FROM scored""",
    "total high_count medium_count low_count", "mean_score high_share"))
def a14(spark, sf):
    return rounded(S.batch_summary(scored(spark, sf)))


@query("a13_score_distribution", f"""WITH {SCORED} SELECT band, count(*) n FROM (SELECT CASE
 WHEN risk_score > 0 AND risk_score <= 40 THEN 'Low' WHEN risk_score > 40 AND risk_score <= 70 THEN 'Medium'
 WHEN risk_score > 70 AND risk_score <= 100 THEN 'High' END band FROM scored) WHERE band IS NOT NULL GROUP BY band""")
def a13(spark, sf):
    return S.score_distribution(scored(spark, sf))


@query("f04_result_filter", f"""WITH {SCORED} SELECT customer_id, risk_score, risk_level FROM scored
 WHERE risk_level IN ('High', 'Medium') AND risk_score BETWEEN 30 AND 80""")
def f04(spark, sf):
    return S.result_filter(scored(spark, sf), ["High", "Medium"], 30, 80).select("customer_id", "risk_score", "risk_level")


COMPOSITE = LOANS + """, parts AS (SELECT *,
 CASE WHEN credit_score >= 740 THEN 0.1 WHEN credit_score >= 670 THEN 0.3 WHEN credit_score >= 580 THEN 0.6 ELSE 0.9 END::DOUBLE AS p1,
 CASE WHEN debt_to_income <= 0.2 THEN 0.1 WHEN debt_to_income <= 0.36 THEN 0.4 WHEN debt_to_income <= 0.5 THEN 0.7 ELSE 0.9 END::DOUBLE AS p2,
 CASE WHEN annual_income >= 80000 THEN 0.1 WHEN annual_income >= 50000 THEN 0.3 WHEN annual_income >= 30000 THEN 0.6 ELSE 0.8 END::DOUBLE AS p3,
 CASE WHEN employment_length >= 10 THEN 0.1 WHEN employment_length >= 5 THEN 0.3 WHEN employment_length >= 2 THEN 0.6 ELSE 0.8 END::DOUBLE AS p4,
 CASE WHEN age BETWEEN 30 AND 55 THEN 0.2 WHEN age BETWEEN 25 AND 65 THEN 0.4 ELSE 0.6 END::DOUBLE AS p5,
 CASE WHEN loan_amount / annual_income <= 2 THEN 0.2 WHEN loan_amount / annual_income <= 4 THEN 0.5
      WHEN loan_amount / annual_income <= 6 THEN 0.7 ELSE 0.9 END::DOUBLE AS p6 FROM loans),
composite AS (SELECT *, (0.0::DOUBLE + p1*0.35::DOUBLE + p2*0.25::DOUBLE + p3*0.2::DOUBLE + p4*0.1::DOUBLE + p5*0.05::DOUBLE + p6*0.05::DOUBLE)
  / (0.0::DOUBLE + 0.35::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE) AS composite_score FROM parts)"""


def composite(spark, sf):
    return S.composite_risk(loans(spark, sf), income="annual_income")


@query("r01_composite_risk", rounded_sql(f"""WITH {COMPOSITE} SELECT loan_id, composite_score,
 CASE WHEN composite_score <= 0.3 THEN 'Low' WHEN composite_score <= 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
 least(3.5 + composite_score * 10, 25) AS recommended_rate FROM composite""",
    "loan_id risk_level", "composite_score recommended_rate", 6))
def r01(spark, sf):
    return rounded(composite(spark, sf).select("loan_id", "composite_score", "risk_level", "recommended_rate"), 6)


@query("m05_interest_rate", rounded_sql(f"""WITH {COMPOSITE} SELECT product_type, avg(least(3.5 + composite_score * 10, 25)) AS mean_rate,
 max(least(3.5 + composite_score * 10, 25)) AS max_rate FROM composite GROUP BY 1""", "product_type", "mean_rate max_rate"))
def m05(spark, sf):
    return rounded(composite(spark, sf).groupBy("product_type").agg(
        F.avg("recommended_rate").alias("mean_rate"), F.max("recommended_rate").alias("max_rate")))


@query("p10_auto_decision", f"""WITH {LOANS}, d AS (SELECT loan_id, default_probability AS p,
 list_filter([CASE WHEN loan_amount > 500000 THEN 'loan_amount' END, CASE WHEN credit_score < 600 THEN 'credit_score' END,
  CASE WHEN debt_to_income > 0.4::DOUBLE THEN 'debt_to_income' END, CASE WHEN employment_length < 2 THEN 'employment_length' END],
  lambda x: x IS NOT NULL) AS failed FROM loans)
SELECT loan_id, array_to_string(failed, ',') AS failed_limits,
 CASE WHEN len(failed) > 0 OR p >= 0.4::DOUBLE THEN 'manual_review' WHEN p < 0.3::DOUBLE THEN 'auto_approve' ELSE 'standard_review' END AS decision
FROM d""")
def p10(spark, sf):
    return S.auto_decision(loans(spark, sf), "default_probability").select(
        "loan_id", F.concat_ws(",", "failed_limits").alias("failed_limits"), "decision")


@query("m11_reason_codes", f"""WITH {APPLICANTS}, r AS (SELECT customer_id, list_filter([
 CASE WHEN annual_income < 30000 THEN 'Low annual income' END,
 CASE WHEN previous_defaults > 0 THEN previous_defaults || ' previous defaults' END,
 CASE WHEN credit_utilization > 80 THEN 'High credit utilization' END,
 CASE WHEN credit_history_length < 2 THEN 'Limited credit history' END,
 CASE WHEN annual_income > 0 AND monthly_expenses / (annual_income / 12) > 0.5 THEN 'High debt-to-income ratio' END,
 CASE WHEN existing_debt > annual_income * 0.5 THEN 'High existing debt burden' END], lambda x: x IS NOT NULL) f FROM applicants)
SELECT customer_id, CASE WHEN len(f) > 0 THEN array_to_string(f, '; ') ELSE 'No significant risk factors identified' END AS reasons,
 CAST(greatest(len(f), 1) AS INTEGER) AS n FROM r""")
def m11(spark, sf):
    return applicants(spark, sf).select("customer_id", reason_codes().alias("r")).select(
        "customer_id", F.concat_ws("; ", "r").alias("reasons"), F.size("r").alias("n"))


@query("m12_factor_lists", f"""WITH {PANEL}, f AS (SELECT *, {' + '.join(f'(CASE WHEN "PAY_{i}" > 0 THEN 1 ELSE 0 END)' for i in (0, 2, 3, 4, 5, 6))} AS late FROM panel)
SELECT "ID", concat_ws('; ', CASE WHEN "LIMIT_BAL" < 50000 THEN 'Low credit limit ($' || format('{{:,.2f}}', "LIMIT_BAL") || ') may indicate limited creditworthiness' END,
 CASE WHEN "AGE" < 25 THEN 'Young age (' || "AGE" || ') associated with higher default risk' END,
 CASE WHEN late > 3 THEN 'Multiple late payments (' || late || '/6 months) indicate payment difficulties' END) AS risk_factors,
 concat_ws('; ', CASE WHEN "LIMIT_BAL" > 500000 THEN 'High credit limit ($' || format('{{:,.2f}}', "LIMIT_BAL") || ') indicates financial stability' END,
 CASE WHEN "AGE" > 50 THEN 'Mature age (' || "AGE" || ') associated with lower default risk' END,
 CASE WHEN late = 0 THEN 'No late payments in recent history' END) AS protective_factors FROM f""")
def m12(spark, sf):
    return factor_lists(credit_panel(spark, sf)).select(
        "ID", F.concat_ws("; ", "risk_factors").alias("risk_factors"),
        F.concat_ws("; ", "protective_factors").alias("protective_factors"))


def _level(c):
    return f"CASE WHEN {c} <= 0.3 THEN 'Low' WHEN {c} <= 0.6 THEN 'Medium' ELSE 'High' END"


_PART_SQL = " || ".join(
    f"'- {t}: ' || {_level(p)} || ' (' || format('{{:.2f}}', {p}) || ')' || chr(10)"
    for t, p in [("Credit Score", "p1"), ("Debt To Income", "p2"), ("Income", "p3"), ("Employment Length", "p4"),
                 ("Age", "p5"), ("Loan Amount", "p6")])


@query("m13_explanation_text", f"""WITH {COMPOSITE}, s AS (SELECT *, round(composite_score, 6) AS sc FROM composite)
SELECT loan_id, '**Risk Level: ' || {_level('sc')} || '** (Score: ' || format('{{:.4f}}', sc) || ')' || chr(10) || chr(10)
 || '**Risk Factors:**' || chr(10) || {_PART_SQL} || chr(10) || '**Recommendations:**' || chr(10)
 || CASE {_level('sc')} WHEN 'Low' THEN '- Approve loan with standard terms' || chr(10) || '- Consider offering premium rates' || chr(10)
 WHEN 'Medium' THEN '- Approve with careful monitoring' || chr(10) || '- Consider additional documentation' || chr(10) || '- Apply moderate risk premium' || chr(10)
 ELSE '- High risk - consider rejection' || chr(10) || '- If approved, require significant risk premium' || chr(10) || '- Implement strict monitoring' || chr(10) END AS explanation
FROM s""")
def m13(spark, sf):
    df = composite(spark, sf).withColumn("composite_score", F.round("composite_score", 6))
    return df.select("loan_id", risk_explanation(places=4).alias("explanation"))
