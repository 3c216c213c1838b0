"""Evaluation and fair-lending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import evaluation as V
from creditspark.operators import fairness as L
from creditspark.plans.quality import union_sql
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.plans.scoring import COMPOSITE, composite
from creditspark.sources.fixtures import APPLICANTS, GAPS, applicants, applicants_with_gaps, table

# labels and scores: composite risk as the score, loan status as the label
SC = COMPOSITE + """, s AS (SELECT loan_id, CASE WHEN status = 'default' THEN 1 ELSE 0 END AS label, round(composite_score, 6) AS score, default_probability AS other,
 CASE WHEN round(composite_score, 6) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM composite),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS pp, count(*) FILTER (WHERE label = 0) AS nn FROM s),
pts AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY 1),
run AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, pp, nn FROM pts, tot WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cm AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE tp, count(*) FILTER (WHERE label = 0 AND prediction = 1)::DOUBLE fp,
 count(*) FILTER (WHERE label = 1 AND prediction = 0)::DOUBLE fn, count(*) FILTER (WHERE label = 0 AND prediction = 0)::DOUBLE tn FROM s)"""


def labelled(spark, sf):
    # known to be non-null, so no filter on it is copied into the scan
    score = F.coalesce(F.round("composite_score", 6), F.lit(0.0))
    return composite(spark, sf).select(
        "loan_id", F.when(F.col("status") == "default", 1).otherwise(0).alias("label"), score.alias("score"),
        F.col("default_probability").alias("other"), F.when(score >= 0.5, 1).otherwise(0).alias("prediction"))


@query("v01_confusion_matrix", rounded_sql(f"WITH {SC} SELECT label, prediction, count(*) n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label) AS row_pct FROM s GROUP BY 1, 2", "label prediction n", "row_pct"))
def v01(spark, sf):
    return rounded(V.confusion_matrix(labelled(spark, sf), "label", "prediction"))


_BIN = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1_score,
 (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) AS matthews_corrcoef"""


@query("v02_binary_metrics", rounded_sql(f"WITH {SC} SELECT {_BIN} FROM cm", "", "precision recall accuracy f1_score matthews_corrcoef", 8))
def v02(spark, sf):
    return rounded(V.binary_metrics(labelled(spark, sf), "label", "prediction").drop("tp", "fp", "fn", "tn"), 8)


_REP = """r AS (SELECT '1' AS class, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score, CAST(tp + fn AS BIGINT) AS support FROM cm
UNION ALL SELECT '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fp + fn), CAST(tn + fp AS BIGINT) FROM cm)"""


@query("v03_weighted_metrics", rounded_sql(f"""WITH {SC}, {_REP} SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r""",
    "class support", "precision recall f1_score", 8))
def v03(spark, sf):
    return rounded(V.class_report(labelled(spark, sf), "label", "prediction"), 8)


@query("v03_weighted_by_part", rounded_sql(f"""WITH {SC}, g AS (SELECT loan_id % 5 AS part, label, prediction FROM s),
k AS (SELECT DISTINCT part, label AS class FROM g UNION SELECT part, prediction FROM g),
c AS (SELECT k.part, class, count(*) FILTER (WHERE label = class AND prediction = class)::DOUBLE AS tp, count(*) FILTER (WHERE prediction = class) AS predicted,
 count(*) FILTER (WHERE label = class) AS support FROM k JOIN g ON g.part = k.part GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
 CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1_score FROM c)
SELECT part, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score,
 CAST(sum(support) AS BIGINT) AS support FROM m GROUP BY 1""", "part support", "precision recall f1_score", 8))
def v03w(spark, sf):
    parts = labelled(spark, sf).withColumn("part", F.col("loan_id") % 5)
    return rounded(V.weighted_metrics(parts, "label", "prediction", ["part"]), 8)


@query("v04_roc_auc", rounded_sql(f"WITH {SC} SELECT sum(neg * (tp - pos / 2)) / (max(pp) * max(nn)) AS roc_auc FROM run", "", "roc_auc", 10))
def v04(spark, sf):
    return rounded(V.roc_auc(labelled(spark, sf), "label", "score"), 10)


@query("v05_roc_curve", rounded_sql(f"WITH {SC} SELECT score AS threshold, fp / nn AS fpr, tp / pp AS tpr FROM run", "", "threshold fpr tpr", 8))
def v05(spark, sf):
    return rounded(V.roc_curve(labelled(spark, sf), "label", "score"), 8)


@query("v05_pr_curve", rounded_sql(f"WITH {SC} SELECT score AS threshold, tp / (tp + fp) AS precision, tp / pp AS recall FROM run", "", "threshold precision recall", 8))
def v05p(spark, sf):
    return rounded(V.pr_curve(labelled(spark, sf), "label", "score"), 8)


_LOSS = "avg(-CASE WHEN label = 1 THEN ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, x))) ELSE ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, x))) END)"


@query("v06_average_precision_logloss", rounded_sql(f"WITH {SC} SELECT (SELECT sum(pos / pp * tp / (tp + fp)) FROM run) AS average_precision, (SELECT {_LOSS} FROM (SELECT label, score AS x FROM s)) AS log_loss", "", "average_precision log_loss", 8))
def v06(spark, sf):
    df = labelled(spark, sf).withColumn("one", F.lit(1))
    return rounded(V.average_precision(df, "label", "score", ["one"]).join(V.log_loss(df, "label", "score", ["one"]), "one").drop("one"), 8)


_CUTS = [i * (1.0 / 99) for i in range(99)] + [1.0]


@query("v07_threshold_sweep", rounded_sql(f"""WITH {SC}, t AS (SELECT unnest({list(range(100))})::INTEGER AS step, unnest({_CUTS})::DOUBLE AS threshold),
c AS (SELECT step, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0)::DOUBLE AS fp, count(*) AS n, max(pp) AS pp FROM s, t, tot GROUP BY 1, 2)
SELECT step, threshold, CASE WHEN tp + fp > 0 AND tp + fp < n THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fp > 0 AND tp + fp < n THEN tp / pp ELSE 0 END AS recall,
 CASE WHEN tp + fp > 0 AND tp + fp < n THEN 2 * tp / (tp + fp + pp) ELSE 0 END AS f1_score FROM c""", "step", "threshold precision recall f1_score", 8))
def v07(spark, sf):
    return rounded(V.threshold_sweep(labelled(spark, sf), "label", "score"), 8)


_EDGES = [i * 0.1 for i in range(1, 10)]
_CAL = "CASE " + " ".join(f"WHEN other <= {e!r}::DOUBLE THEN {i}" for i, e in enumerate(_EDGES)) + " ELSE 9 END"


@query("v08_calibration_curve", rounded_sql(f"WITH {SC} SELECT {_CAL} AS bin, avg(other) AS mean_predicted, avg(label) AS fraction_positive, count(*) AS n FROM s GROUP BY 1", "bin n", "mean_predicted fraction_positive", 8))
def v08(spark, sf):
    return rounded(V.calibration_curve(labelled(spark, sf), "label", "other"), 8)


@query("v09_business_metrics", rounded_sql(f"""WITH {SC}, b AS (SELECT count(*) n, count(*) FILTER (WHERE score < 0.3) lo, count(*) FILTER (WHERE score >= 0.3 AND score < 0.7) md, count(*) FILTER (WHERE score >= 0.7) hi FROM s)
SELECT n AS total_customers, CAST(tp AS BIGINT) AS correctly_identified_defaults, CAST(fp AS BIGINT) AS false_alarms, CAST(fn AS BIGINT) AS missed_defaults, CAST(tn AS BIGINT) AS true_negatives,
 lo AS low_risk_count, md AS medium_risk_count, hi AS high_risk_count, CAST(tp + fn AS BIGINT) AS actual_defaults, CAST(tp + fp AS BIGINT) AS predicted_defaults, (tp + fn) / n AS actual_default_rate, (tp + fp) / n AS predicted_default_rate,
 lo * 100.0 / n AS low_risk_pct, md * 100.0 / n AS medium_risk_pct, hi * 100.0 / n AS high_risk_pct FROM cm, b""",
    "total_customers correctly_identified_defaults false_alarms missed_defaults true_negatives low_risk_count medium_risk_count high_risk_count actual_defaults predicted_defaults",
    "actual_default_rate predicted_default_rate low_risk_pct medium_risk_pct high_risk_pct", 6))
def v09(spark, sf):
    return rounded(V.business_metrics(labelled(spark, sf), "label", "prediction", "score"), 6)


def long_scores(spark, sf):
    return labelled(spark, sf).select("label", "score", "other").unpivot(["label"], ["score", "other"], "model", "x")


def _one_model(c):
    return f"""SELECT '{c}' AS model, {_BIN}, (SELECT sum(neg * (tp - pos / 2)) / (max(pp) * max(nn)) FROM r_{c}) AS roc_auc, (SELECT sum(pos / pp * tp / (tp + fp)) FROM r_{c}) AS average_precision,
 (SELECT {_LOSS} FROM (SELECT label, {c} AS x FROM s)) AS log_loss FROM (SELECT count(*) FILTER (WHERE label = 1 AND {c} >= 0.5)::DOUBLE tp, count(*) FILTER (WHERE label = 0 AND {c} >= 0.5)::DOUBLE fp,
 count(*) FILTER (WHERE label = 1 AND {c} < 0.5)::DOUBLE fn, count(*) FILTER (WHERE label = 0 AND {c} < 0.5)::DOUBLE tn FROM s)"""


def _run(c):
    return f"""p_{c} AS (SELECT {c} AS x, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY 1),
r_{c} AS (SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pp, nn FROM p_{c}, tot WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING))"""


MODELS = f"{SC}, {_run('score')}, {_run('other')}, models AS ({_one_model('score')} UNION ALL {_one_model('other')})"
_MET = "precision recall accuracy f1_score matthews_corrcoef roc_auc average_precision log_loss"


def compared(spark, sf):
    return V.compare_models(long_scores(spark, sf), "label", "x").drop("tp", "fp", "fn", "tn")


@query("v10_compare_models", rounded_sql(f"WITH {MODELS} SELECT * FROM models", "model", _MET, 8))
def v10(spark, sf):
    return rounded(compared(spark, sf), 8)


@query("v11_model_report", f"""WITH {MODELS} SELECT model, CASE WHEN roc_auc >= 0.85 THEN 'Excellent' WHEN roc_auc >= 0.75 THEN 'Good' WHEN roc_auc >= 0.65 THEN 'Fair' ELSE 'Poor' END AS performance_level,
 concat_ws(' | ', CASE WHEN roc_auc < 0.75 THEN 'ROC-AUC (' || format('{{:.3f}}', roc_auc) || ') below target (0.75). Consider feature engineering.' END,
 CASE WHEN precision < 0.7 THEN 'Low precision (' || format('{{:.3f}}', precision) || '). Consider adjusting threshold or improving features.' END,
 CASE WHEN recall < 0.65 THEN 'Low recall (' || format('{{:.3f}}', recall) || '). Consider class balancing or threshold adjustment.' END,
 CASE WHEN abs(precision - recall) > 0.2 THEN 'Significant precision-recall imbalance. Review threshold optimization.' END) AS recommendations FROM models""")
def v11(spark, sf):
    return V.model_report(compared(spark, sf)).select("model", "performance_level", F.concat_ws(" | ", "recommendations").alias("recommendations"))


@query("v12_threshold_gate", rounded_sql(f"WITH {MODELS}, g AS (" + union_sql(
    f"SELECT model, '{m}' AS metric, {m} AS value, {V.MINIMUM[m]}::DOUBLE AS minimum, {V.GOAL[m]}::DOUBLE AS goal, {0.6 if m == 'accuracy' else 'NULL'}::DOUBLE AS baseline FROM models" for m in V.MINIMUM)
    + ") SELECT *, CASE WHEN value >= goal THEN 'target' WHEN value >= minimum THEN 'acceptable' ELSE 'below minimum' END AS status, coalesce(baseline - value > 0.05, false) AS degraded FROM g",
    "model metric status degraded", "value minimum goal baseline", 8))
def v12(spark, sf):
    return rounded(V.threshold_gate(compared(spark, sf), ["model"], baseline={"accuracy": 0.6}), 8)


# --- L: fair lending ----------------------------------------------------------

ATTRS = ["race", "ethnicity", "sex"]
GC = APPLICANTS + ", gl AS (" + union_sql(f"SELECT '{a}' AS attribute, {a} AS \"group\", loan_approved AS y, predicted_approval AS p FROM applicants" for a in ATTRS) + """),
gc AS (SELECT attribute, "group", count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE p = 1) AS pred, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
 count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM gl GROUP BY 1, 2)"""


def _parity(c):
    return f"""SELECT *, impact_ratio >= 0.8 AS passes_80_percent_rule FROM (SELECT attribute, "group", n, {c} / n AS rate, sum({c}) OVER w / sum(n) OVER w AS overall_rate,
 min({c} / n) OVER w / max({c} / n) OVER w AS impact_ratio FROM gc WINDOW w AS (PARTITION BY attribute))"""


@query("l01_missing_groups", f"""WITH {GAPS} SELECT 'loan_purpose' AS attribute, count(*) - count(loan_purpose) AS missing FROM gaps
UNION ALL SELECT 'age', count(*) - count(age) FROM gaps""")
def l01m(spark, sf):
    """Rows that a fairness report by these attributes has to leave out."""
    return L.missing_groups(applicants_with_gaps(spark, sf), ["loan_purpose", "age"])


@query("l01_demographic_parity", rounded_sql(f"WITH {GC} {_parity('pos')}", "attribute group n passes_80_percent_rule", "rate overall_rate impact_ratio", 8))
def l01(spark, sf):
    return rounded(L.demographic_parity(applicants(spark, sf), "loan_approved", ATTRS), 8)


@query("l02_equalized_odds", rounded_sql(f"""WITH {GC} SELECT attribute, "group", coalesce(tp / nullif(tp + fn, 0), 0) AS true_positive_rate, coalesce(fp / nullif(fp + tn, 0), 0) AS false_positive_rate, n AS sample_size FROM gc""",
                                         "attribute group sample_size", "true_positive_rate false_positive_rate", 8))
def l02(spark, sf):
    return rounded(L.equalized_odds(applicants(spark, sf), "loan_approved", "predicted_approval", ATTRS), 8)


@query("l03_group_calibration", rounded_sql(f"""WITH {GC} SELECT attribute, "group", pred / n AS predicted_rate, pos / n AS actual_rate, abs(pred / n - pos / n) AS calibration_error FROM gc""",
                                            "attribute group", "predicted_rate actual_rate calibration_error", 8))
def l03(spark, sf):
    return rounded(L.group_calibration(applicants(spark, sf), "loan_approved", "predicted_approval", ATTRS), 8)


_CHI = """e AS (SELECT attribute, "group", y, o, sum(o) OVER (PARTITION BY attribute, "group") * sum(o) OVER (PARTITION BY attribute, y) / sum(o) OVER (PARTITION BY attribute) AS e
 FROM (SELECT attribute, "group", 1 AS y, pos::DOUBLE AS o FROM gc UNION ALL SELECT attribute, "group", 0, n - pos FROM gc)),
x AS (SELECT attribute, count(DISTINCT "group") - 1 AS dof, sum(pow(abs(o - e), 2) / e) AS plain, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS corrected FROM e GROUP BY 1)"""


@query("l04_adverse_impact", rounded_sql(f"""WITH {GC}, {_CHI}, p AS ({_parity('pos')}) SELECT p.attribute, min(overall_rate) AS overall_rate, min(impact_ratio) AS impact_ratio, bool_and(passes_80_percent_rule) AS passes_80_percent_rule, min(dof) AS dof,
 min(CASE WHEN dof = 1 THEN corrected ELSE plain END) AS chi_square, min(CASE WHEN dof = 1 THEN corrected ELSE plain END) > min(CASE dof WHEN 1 THEN 3.841458820694124 ELSE 7.814727903251179 END) AS statistically_significant FROM p JOIN x ON p.attribute = x.attribute GROUP BY 1""",
    "attribute passes_80_percent_rule dof statistically_significant", "overall_rate impact_ratio chi_square", 6))
def l04(spark, sf):
    return rounded(L.adverse_impact(applicants(spark, sf), "loan_approved", ATTRS).drop("p_value"), 6)


@query("l04_contingency_residuals", rounded_sql(f"""WITH {APPLICANTS}, c AS (SELECT race, loan_approved, count(*) AS observed FROM applicants GROUP BY 1, 2),
e AS (SELECT *, sum(observed) OVER (PARTITION BY race) * sum(observed) OVER (PARTITION BY loan_approved) / sum(observed) OVER ()::DOUBLE AS expected FROM c) SELECT *, (observed - expected) / sqrt(expected) AS residual FROM e""",
    "race loan_approved observed", "expected residual", 6))
def l04r(spark, sf):
    return rounded(L.contingency_residuals(applicants(spark, sf), "race", "loan_approved"), 6)


@query("l05_fairness_report", rounded_sql(f"""WITH {GC} SELECT p.*, coalesce(tp / nullif(tp + fn, 0), 0) AS true_positive_rate, coalesce(fp / nullif(fp + tn, 0), 0) AS false_positive_rate, pred / gc.n AS predicted_rate, pos / gc.n AS actual_rate,
 abs(pred / gc.n - pos / gc.n) AS calibration_error FROM ({_parity('pred')}) p JOIN gc ON p.attribute = gc.attribute AND p."group" = gc."group" """,
    "attribute group n passes_80_percent_rule", "rate overall_rate impact_ratio true_positive_rate false_positive_rate predicted_rate actual_rate calibration_error", 8))
def l05(spark, sf):
    return rounded(L.fairness_report(applicants(spark, sf), "loan_approved", "predicted_approval", ATTRS), 8)


@query("l06_hmda_report", rounded_sql(f"""WITH {GC} SELECT attribute || '_breakdown' AS section, "group" AS item, n::DOUBLE AS value FROM gc UNION ALL SELECT 'summary', 'total_applications', count(*) FROM applicants
UNION ALL SELECT 'loan_amount_stats', 'mean', avg(loan_amount) FROM applicants UNION ALL SELECT 'loan_amount_stats', 'min', min(loan_amount) FROM applicants UNION ALL SELECT 'loan_amount_stats', 'max', max(loan_amount) FROM applicants
UNION ALL SELECT 'loan_amount_stats', 'median', median(loan_amount) FROM applicants UNION ALL SELECT 'action_taken', 'approved', sum(loan_approved) FROM applicants UNION ALL SELECT 'action_taken', 'denied', count(*) - sum(loan_approved) FROM applicants
UNION ALL SELECT 'action_taken', 'approval_rate', avg(loan_approved) FROM applicants""", "section item", "value"))
def l06(spark, sf):
    return rounded(L.hmda_report(applicants(spark, sf)))


_ISSUES = f"""coalesce((SELECT string_agg(DISTINCT 'Potential disparate impact detected for ' || attribute, '; ' ORDER BY 'Potential disparate impact detected for ' || attribute) FROM ({_parity('pos')}) WHERE NOT passes_80_percent_rule AND attribute IN ('race', 'ethnicity')), '')"""


@query("l07_regulatory_check", f"WITH {GC} SELECT 'ECOA' AS regulation, {_ISSUES} = '' AS compliant, {_ISSUES} AS issues UNION ALL SELECT 'GDPR', true, ''")
def l07(spark, sf):
    return L.regulatory_check(applicants(spark, sf))


@query("l08_compliance_summary", rounded_sql(f"""WITH {GC}, f AS (SELECT DISTINCT attribute FROM ({_parity('pos')}) WHERE NOT passes_80_percent_rule), c AS (SELECT CASE WHEN {_ISSUES} = '' THEN 100.0 ELSE 50.0 END AS compliance_score, (SELECT count(*) FROM f) AS disparate_impact_issues)
SELECT *, CASE WHEN disparate_impact_issues > 0 OR compliance_score < 80 THEN 'High' WHEN compliance_score < 90 THEN 'Medium' ELSE 'Low' END AS risk_level,
 CASE WHEN disparate_impact_issues = 0 AND compliance_score = 100 THEN 'Continue monitoring model performance and fairness metrics; Conduct regular compliance audits and reviews; Maintain documentation of all compliance activities'
 ELSE concat_ws('; ', (SELECT string_agg('Address disparate impact in ' || attribute || ' - consider model adjustments or additional review processes', '; ' ORDER BY attribute) FROM f),
  CASE WHEN compliance_score < 100 THEN 'Resolve ECOA compliance issues - review policies and procedures' END) END AS recommendations FROM c""",
    "disparate_impact_issues risk_level recommendations", "compliance_score"))
def l08(spark, sf):
    return rounded(L.compliance_summary(applicants(spark, sf), "loan_approved", ATTRS))


@query("l09_audit_trail", 'SELECT min(ts) AS start, max(ts) AS "end", count(*) AS total_activities FROM events')
def l09(spark, sf):
    return L.audit_summary(table(spark, sf, "events"), "ts")


@query("l09_latest_activities", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def l09b(spark, sf):
    return L.latest_activities(table(spark, sf, "events"), "ts", "event_id").select("event_id", "ts", "event_type")
