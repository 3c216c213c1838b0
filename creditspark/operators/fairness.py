"""Fair-lending metrics and compliance reports.

Protected attributes are unpivoted to (attribute, group) once; the counts per
group are all that the metrics need. Rows without a group are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.expr import safe_divide
from creditspark.functions.ordering import quantiles
from creditspark.operators.columns import pii_columns


def unpivot_groups(df: DataFrame, attrs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(a).cast("string").alias(a) for a in attrs]).unpivot(
        list(keep), list(attrs), "attribute", "group").where(F.col("group").isNotNull())


def missing_groups(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Rows per attribute whose group is missing."""
    return df.agg(*[F.count_if(F.col(a).isNull()).alias(a) for a in attrs]).unpivot([], list(attrs), "attribute", "missing")


def group_counts(df: DataFrame, attrs: Sequence[str], outcome: str, predicted: str | None = None) -> DataFrame:
    """n, positive outcomes and the four confusion counts per (attribute, group)."""
    predicted = predicted or outcome
    y, p = F.col(outcome) == 1, F.col(predicted) == 1
    return unpivot_groups(df, attrs, list(dict.fromkeys([outcome, predicted]))).groupBy("attribute", "group").agg(
        F.count("*").alias("n"), F.count_if(y).alias("pos"), F.count_if(p).alias("pred"), F.count_if(y & p).alias("tp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))


def parity_from_counts(counts: DataFrame, positive: str = "pos") -> DataFrame:
    """Group rates with the overall rate, their min/max ratio and the 80 % rule."""
    w = W.partitionBy("attribute")
    r = counts.withColumn("rate", F.try_divide(F.col(positive), F.col("n")))
    top = F.max("rate").over(w)
    ratio = F.when(F.count("*").over(w) >= 2, F.when(top > 0, F.min("rate").over(w) / F.when(top > 0, top)).otherwise(0.0))
    return r.select("attribute", "group", "n", "rate", (F.sum(positive).over(w) / F.sum("n").over(w)).alias("overall_rate"),
                    ratio.alias("impact_ratio")).withColumn("passes_80_percent_rule", F.col("impact_ratio") >= 0.8)


def demographic_parity(df: DataFrame, outcome: str, attrs: Sequence[str]) -> DataFrame:
    return parity_from_counts(group_counts(df, attrs, outcome))


def odds_from_counts(counts: DataFrame) -> DataFrame:
    return counts.select("attribute", "group", safe_divide("tp", F.col("tp") + F.col("fn")).alias("true_positive_rate"),
                         safe_divide("fp", F.col("fp") + F.col("tn")).alias("false_positive_rate"), F.col("n").alias("sample_size"))


def equalized_odds(df: DataFrame, outcome: str, predicted: str, attrs: Sequence[str]) -> DataFrame:
    return odds_from_counts(group_counts(df, attrs, outcome, predicted))


def calibration_from_counts(counts: DataFrame) -> DataFrame:
    p, a = F.try_divide("pred", "n"), F.try_divide("pos", "n")
    return counts.select("attribute", "group", p.alias("predicted_rate"), a.alias("actual_rate"), F.abs(p - a).alias("calibration_error"))


def group_calibration(df: DataFrame, outcome: str, predicted: str, attrs: Sequence[str]) -> DataFrame:
    return calibration_from_counts(group_counts(df, attrs, outcome, predicted))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    a, q = (1.0, math.exp(-h)) if dof % 2 == 0 else (0.5, math.erfc(math.sqrt(h)))
    while a < dof / 2:
        q += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        a += 1
    return q


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P-values of an already aggregated table (one row per attribute)."""
    return pd.Series([None if pd.isna(v) or d < 1 else chi2_tail(v, int(d)) for v, d in zip(x, dof)], dtype="float64")


def chi_square(cells: DataFrame, by: Sequence[str], row: str, col: str, n: str = "n") -> DataFrame:
    """Chi-square statistic and degrees of freedom of a long contingency table.

    ``cells`` holds one row per non-empty cell; an empty cell adds its expected
    count, which follows from the total. With one degree of freedom the
    continuity correction applies: all four cells then differ from their
    expectation by the same amount, so the sum needs the margins only.
    """
    def over(*keys):
        return W.partitionBy(*by, *keys) if by or keys else W.partitionBy(F.lit(1))

    o = F.col(n).cast("double")
    m = cells.withColumns({"_t": F.sum(o).over(over()), "_r": F.sum(o).over(over(row)), "_c": F.sum(o).over(over(col)),
                           "_kr": F.count("*").over(over(row)), "_kc": F.count("*").over(over(col))})
    m = m.withColumn("_e", F.col("_r") * F.col("_c") / F.col("_t")).withColumn("_d", F.abs(o - F.col("_e")))
    s = m.groupBy(*by).agg(
        ((F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)).alias("dof"),
        (F.sum(F.col("_d") * F.col("_d") / F.col("_e")) + F.max("_t") - F.sum("_e")).alias("plain"),
        F.max("_t").alias("t"), F.max("_d").alias("d"), F.sum(1 / (F.col("_r") * F.col("_kr"))).alias("ir"), F.sum(1 / (F.col("_c") * F.col("_kc"))).alias("ic"))
    shifted = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    corrected = shifted * shifted * F.col("t") * F.col("ir") * F.col("ic")
    return s.select(*by, F.when(F.col("dof") == 1, corrected).otherwise(F.col("plain")).alias("chi_square"), "dof")


def adverse_impact(df: DataFrame, outcome: str, attrs: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Impact ratio, chi-square test and significance per attribute."""
    counts = group_counts(df, attrs, outcome)
    parity = parity_from_counts(counts).groupBy("attribute").agg(
        F.first("overall_rate").alias("overall_rate"), F.first("impact_ratio").alias("impact_ratio"),
        F.first("passes_80_percent_rule").alias("passes_80_percent_rule"))
    cells = counts.select("attribute", "group", F.explode(F.array(
        F.struct(F.lit(1).alias("y"), F.col("pos").alias("n")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("n")))).alias("x")
    ).select("attribute", "group", "x.y", "x.n").where("n > 0")
    test = chi_square(cells, ["attribute"], "group", "y").withColumn("p_value", chi2_p_value("chi_square", "dof"))
    return parity.join(test, "attribute").withColumn("statistically_significant", F.col("p_value") < alpha)


def contingency_residuals(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed, expected and standardized residual per cell of two columns."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("observed"))
    e = F.sum("observed").over(W.partitionBy(a)) * F.sum("observed").over(W.partitionBy(b)) / F.sum("observed").over(W.partitionBy(F.lit(1)))
    return c.withColumn("expected", e).withColumn("residual", (F.col("observed") - F.col("expected")) / F.sqrt("expected"))


def fairness_report(df: DataFrame, outcome: str, predicted: str, attrs: Sequence[str]) -> DataFrame:
    """Parity of the prediction, equalized odds and calibration per group from one aggregate."""
    c = group_counts(df, attrs, outcome, predicted)
    keys = ["attribute", "group"]
    return (parity_from_counts(c, "pred").join(odds_from_counts(c).drop("sample_size"), keys).join(calibration_from_counts(c), keys))


def hmda_report(df: DataFrame, fields: Sequence[str] = ("race", "ethnicity", "sex", "age_group"), amount: str = "loan_amount",
                approved: str = "loan_approved") -> DataFrame:
    """Totals, group breakdowns, amount statistics and actions as (section, item, value)."""
    fields = [f for f in fields if f in df.columns]
    groups = unpivot_groups(df, fields, []).groupBy("attribute", "group").agg(F.count("*").cast("double").alias("value")).select(
        F.concat("attribute", F.lit("_breakdown")).alias("section"), F.col("group").alias("item"), "value")
    y = F.col(approved).cast("double")
    stats = df.agg(
        F.count("*").cast("double").alias("n"), F.avg(amount).alias("mean"), F.min(amount).cast("double").alias("min"),
        F.max(amount).cast("double").alias("max"), F.sum(y).alias("ok"), F.avg(y).alias("rate"))
    cells = [("summary", "total_applications", F.col("n")), ("loan_amount_stats", "mean", F.col("mean")), ("loan_amount_stats", "min", F.col("min")),
             ("loan_amount_stats", "max", F.col("max")), ("action_taken", "approved", F.col("ok")),
             ("action_taken", "denied", F.col("n") - F.col("ok")), ("action_taken", "approval_rate", F.col("rate"))]
    flat = stats.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.alias("value")) for s, i, v in cells])).alias("c")).select("c.*")
    median = quantiles(df, [amount], [0.5]).select(F.lit("loan_amount_stats").alias("section"), F.lit("median").alias("item"), "value")
    return flat.unionByName(median).unionByName(groups)


def regulatory_check(df: DataFrame, outcome: str = "loan_approved", attrs: Sequence[str] = ("race", "ethnicity")) -> DataFrame:
    """ECOA by the 80 % rule on race and ethnicity; GDPR lists personal columns and stays compliant."""
    attrs = [a for a in attrs if a in df.columns]
    found = pii_columns(df)
    gdpr = f"PII detected in dataset: {found}" if found else ""
    if not attrs or outcome not in df.columns:
        rows = [("ECOA", True, ""), ("GDPR", True, gdpr)]
        return df.sparkSession.createDataFrame(rows, "regulation string, compliant boolean, issues string")
    bad = demographic_parity(df, outcome, attrs).where(~F.col("passes_80_percent_rule"))
    issues = F.concat_ws("; ", F.array_sort(F.collect_set(F.concat(F.lit("Potential disparate impact detected for "), F.col("attribute")))))
    ecoa = bad.agg(issues.alias("issues")).select(F.lit("ECOA").alias("regulation"), (F.col("issues") == "").alias("compliant"), "issues")
    return ecoa.unionByName(df.sparkSession.createDataFrame([("GDPR", True, gdpr)], "regulation string, compliant boolean, issues string"))


def compliance_summary(df: DataFrame, outcome: str, attrs: Sequence[str]) -> DataFrame:
    """Score, disparate-impact count, risk level and recommendations in one row."""
    checks = regulatory_check(df, outcome).agg(
        (F.avg(F.col("compliant").cast("double")) * 100).alias("compliance_score"),
        F.array_sort(F.collect_list(F.when(~F.col("compliant"), F.concat(
            F.lit("Resolve "), F.col("regulation"), F.lit(" compliance issues - review policies and procedures"))))).alias("c"), F.lit(1).alias("k"))
    impact = demographic_parity(df, outcome, attrs).where(~F.col("passes_80_percent_rule")).agg(
        F.count_distinct("attribute").alias("disparate_impact_issues"),
        F.array_sort(F.collect_set(F.concat(F.lit("Address disparate impact in "), F.col("attribute"),
                                            F.lit(" - consider model adjustments or additional review processes")))).alias("d"), F.lit(1).alias("k"))
    both = checks.join(impact, "k")
    general = F.array(F.lit("Continue monitoring model performance and fairness metrics"), F.lit("Conduct regular compliance audits and reviews"),
                      F.lit("Maintain documentation of all compliance activities"))
    advice = F.concat("d", "c")
    return both.select(
        "compliance_score", "disparate_impact_issues",
        F.when((F.col("disparate_impact_issues") > 0) | (F.col("compliance_score") < 80), "High").when(F.col("compliance_score") < 90, "Medium").otherwise("Low").alias("risk_level"),
        F.concat_ws("; ", F.when(F.size(advice) > 0, advice).otherwise(general)).alias("recommendations"))


def audit_summary(log: DataFrame, time: str) -> DataFrame:
    """First and last time and the number of entries of an activity log."""
    return log.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("total_activities"))


def latest_activities(log: DataFrame, time: str, key: str, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc(time), F.desc(key)).limit(n)
