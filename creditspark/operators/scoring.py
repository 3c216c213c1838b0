"""Rule-based scores and the reports on scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.expr import banded, clip, confidence_label, offered_rate, recommendation, risk_band, safe_divide

# Composite risk weights.
COMPOSITE_WEIGHTS = {
    "credit_score": 0.35,
    "debt_to_income": 0.25,
    "income": 0.20,
    "employment_length": 0.10,
    "age": 0.05,
    "loan_amount": 0.05,
}


def _at_least(c: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """Value of the first step whose bound ``c`` reaches."""
    out = None
    for bound, value in steps:
        out = F.when(c >= bound, value) if out is None else out.when(c >= bound, value)
    return F.when(c.isNotNull(), out.otherwise(rest))


def _at_most(c: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    return banded(c, [b for b, _ in steps], [v for _, v in steps] + [rest], side="lower")


def composite_parts(score="credit_score", dti="debt_to_income", income="income", tenure="employment_length",
                    age="age", loan="loan_amount") -> dict[str, Column]:
    """Risk of each part on 0..1, null where its input is missing."""
    inc, a = F.col(income), F.col(age)
    per_income = F.when(inc > 0, F.col(loan) / F.when(inc > 0, inc))
    return {
        "credit_score": _at_least(F.col(score), [(740, 0.1), (670, 0.3), (580, 0.6)], 0.9),
        "debt_to_income": _at_most(F.col(dti), [(0.2, 0.1), (0.36, 0.4), (0.5, 0.7)], 0.9),
        "income": _at_least(inc, [(80000, 0.1), (50000, 0.3), (30000, 0.6)], 0.8),
        "employment_length": _at_least(F.col(tenure), [(10, 0.1), (5, 0.3), (2, 0.6)], 0.8),
        "age": F.when(a.between(30, 55), 0.2).when(a.between(25, 65), 0.4).when(a.isNotNull(), 0.6),
        "loan_amount": F.when(F.col(loan).isNotNull() & (inc <= 0), 0.9).otherwise(
            _at_most(per_income, [(2, 0.2), (4, 0.5), (6, 0.7)], 0.9)),
    }


def composite_risk(df: DataFrame, **columns: str) -> DataFrame:
    """Weighted mean of the part risks, renormalized over the parts a row has."""
    parts = composite_parts(**columns)
    named = df.withColumns({f"risk_{k}": v for k, v in parts.items()})
    weight = sum((F.when(F.col(f"risk_{k}").isNotNull(), w).otherwise(0.0) for k, w in COMPOSITE_WEIGHTS.items()),
                 F.lit(0.0))
    total = sum((F.coalesce(F.col(f"risk_{k}") * w, F.lit(0.0)) for k, w in COMPOSITE_WEIGHTS.items()), F.lit(0.0))
    scored = named.withColumn("composite_score", safe_divide(total, weight))
    return scored.withColumns({
        "risk_level": risk_band("composite_score", "composite"),
        "recommended_rate": offered_rate("composite_score"),
    })


def applicant_points() -> Column:
    """Additive risk points on 0..100 for the batch-applicant schema."""
    income, expenses = F.col("annual_income"), F.col("monthly_expenses")
    ratio = F.when(income > 0, expenses / F.when(income > 0, income / 12))
    age, history, used = F.col("age"), F.col("credit_history_length"), F.col("credit_utilization")
    points = (
        F.lit(50)
        + F.when(age < 25, 10).when(age > 60, 5).otherwise(-5)
        + F.when(income < 30000, 15).when(income > 80000, -10).otherwise(0)
        + F.when(ratio > 0.5, 20).when(ratio < 0.3, -10).otherwise(0)
        + F.when(history < 2, 15).when(history > 10, -10).otherwise(0)
        + 10 * F.col("previous_defaults")
        + F.when(used > 80, 15).when(used < 30, -5).otherwise(0)
        + F.when(F.col("existing_debt") > 0.5 * income, 10).otherwise(0)
    )
    return clip(points, 0, 100).cast("int")


def applicant_score(df: DataFrame, processed_at: bool = False) -> DataFrame:
    """Score, level and recommendation per applicant."""
    out = df.withColumn("risk_score", applicant_points()).withColumns({
        "risk_level": risk_band("risk_score", "score"),
        "recommendation": recommendation("risk_score", "score"),
    })
    return out.withColumn("processed_at", F.current_timestamp()) if processed_at else out


def result_filter(df: DataFrame, levels: Sequence[str] = (), low: float = 0, high: float = 100) -> DataFrame:
    """Scored rows of the given levels inside a score interval."""
    out = df.where(F.col("risk_score").between(low, high))
    return out.where(F.col("risk_level").isin(list(levels))) if levels else out


def score_distribution(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Counts of right-closed score bins (0,40], (40,70], (70,100]; a score of 0 is in none."""
    s = F.col(score)
    level = F.when((s > 0) & (s <= 40), "Low").when((s > 40) & (s <= 70), "Medium").when((s > 70) & (s <= 100), "High")
    return df.select(level.alias("band")).where(F.col("band").isNotNull()).groupBy("band").agg(F.count("*").alias("n"))


def batch_summary(df: DataFrame, score: str = "risk_score", level: str = "risk_level") -> DataFrame:
    """Totals, mean score and class counts of a scored batch in one row."""
    n = F.count("*")
    return df.agg(
        n.alias("total"),
        F.avg(score).alias("mean_score"),
        *[F.count_if(F.col(level) == lv).alias(f"{lv.lower()}_count") for lv in ("High", "Medium", "Low")],
        F.try_divide(F.count_if(F.col(level) == "High"), n).alias("high_share"),
    )


def probability_summary(df: DataFrame, probability: str, predicted: str) -> DataFrame:
    """Summary of model predictions: predicted default rate, mean probability, class counts."""
    band = risk_band(probability)
    return df.select(F.col(probability).alias("p"), F.col(predicted).alias("y"), band.alias("b")).agg(
        F.count("*").alias("total"),
        F.sum(F.col("y").cast("long")).alias("predicted_defaults"),
        F.avg(F.col("y").cast("double")).alias("default_rate"),
        F.avg("p").alias("mean_probability"),
        *[F.count_if(F.col("b") == lv).alias(lv.lower().replace(" ", "_")) for lv in ("Low Risk", "Medium Risk", "High Risk")],
    )


def decide(df: DataFrame, probability: str) -> DataFrame:
    """Probability based label, confidence and recommendation text."""
    return df.withColumns({
        "risk_category": risk_band(probability),
        "confidence": confidence_label(probability),
        "recommendation": recommendation(probability),
    })


# Loan limits of the decision rules.
LOAN_LIMITS = {"max_loan_amount": 500000, "min_credit_score": 600, "max_debt_to_income": 0.4, "min_employment_length": 2}


def auto_decision(df: DataFrame, probability: str, amount="loan_amount", score="credit_score", dti="debt_to_income",
                  tenure="employment_length", limits: dict | None = None, manual_from: float = 0.4,
                  auto_reject: bool = False) -> DataFrame:
    """Automatic decision and the list of loan limits a row breaks.

    Low risk is approved, anything from ``manual_from`` up or with a broken
    limit goes to manual review; high risk is rejected only when asked for.
    """
    lim = {**LOAN_LIMITS, **(limits or {})}
    p = F.col(probability)
    failed = F.array_compact(F.array(
        F.when(F.col(amount) > lim["max_loan_amount"], "loan_amount"),
        F.when(F.col(score) < lim["min_credit_score"], "credit_score"),
        F.when(F.col(dti) > lim["max_debt_to_income"], "debt_to_income"),
        F.when(F.col(tenure) < lim["min_employment_length"], "employment_length")))
    out = df.withColumn("failed_limits", failed)
    high = F.when(F.lit(auto_reject) & (p >= 0.7), "auto_reject")
    return out.withColumn(
        "decision",
        high.when((F.size("failed_limits") > 0) | (p >= manual_from), "manual_review")
        .when(p < 0.3, "auto_approve").otherwise("standard_review"))
