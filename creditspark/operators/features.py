"""Feature engineering on the card-client panel."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.functions.expr import bin_by_edges, bin_fixed, row_count_if, row_max, row_mean, row_min, row_std, row_sum
from creditspark.functions.ordering import quantile_dict
from creditspark.operators.clean import fill, fit_fill_values
from creditspark.operators.profiling import numeric_columns
from creditspark.operators.validation import require_columns
from creditspark.schemas import BILLS, PAY_STATUS, PAYMENTS

PANEL_COLUMNS = ["LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", *PAY_STATUS, *BILLS, *PAYMENTS]


def _over(a, b):
    """a / (b + 1); null where b is -1."""
    x = F.col(a) if isinstance(a, str) else a
    y = F.col(b) if isinstance(b, str) else b
    return F.try_divide(x, y + 1)


def features_basic(df: DataFrame) -> DataFrame:
    """Utilization and payment ratio per month, mean amounts, delays."""
    out = {}
    for i in range(1, 7):
        out[f"credit_util_{i}"] = _over(f"BILL_AMT{i}", "LIMIT_BAL")
        out[f"payment_ratio_{i}"] = _over(f"PAY_AMT{i}", f"BILL_AMT{i}")
    out["avg_bill_amt"] = row_mean(BILLS)
    out["avg_pay_amt"] = row_mean(PAYMENTS)
    out["delay_count"] = row_count_if(PAY_STATUS, "> 0")
    out["max_delay"] = row_max(PAY_STATUS)
    return df.withColumns(out)


def features_utilization(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "avg_bill_amt": row_mean(BILLS), "max_bill_amt": row_max(BILLS), "min_bill_amt": row_min(BILLS), "std_bill_amt": row_std(BILLS),
    }).withColumns({
        "avg_utilization_ratio": _over("avg_bill_amt", "LIMIT_BAL"),
        "max_utilization_ratio": _over("max_bill_amt", "LIMIT_BAL"),
        "bill_amt_trend": _over(F.col("BILL_AMT1") - F.col("BILL_AMT6"), "BILL_AMT6"),
        "bill_amt_volatility": _over("std_bill_amt", "avg_bill_amt"),
    })


def features_payment(df: DataFrame) -> DataFrame:
    ratios = [f"pay_ratio_{i}" for i in range(1, 7)]
    return df.withColumns({
        "avg_pay_status": row_mean(PAY_STATUS), "max_pay_delay": row_max(PAY_STATUS),
        "pay_delay_frequency": row_count_if(PAY_STATUS, "> 0"),
        "severe_delay_count": row_count_if(PAY_STATUS, ">= 2"),
        "avg_pay_amt": row_mean(PAYMENTS), "total_pay_amt": row_sum(PAYMENTS),
        **{r: _over(p, b) for r, p, b in zip(ratios, PAYMENTS, BILLS)},
    }).withColumns({
        "pay_amt_consistency": 1 - _over(row_std(PAYMENTS), "avg_pay_amt"),
        "avg_pay_ratio": row_mean(ratios),
    })


def features_health(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "limit_per_age": _over("LIMIT_BAL", "AGE"),
        "debt_burden": _over("avg_bill_amt", "LIMIT_BAL"),
        "payment_burden": _over("avg_pay_amt", "avg_bill_amt"),
        "financial_trend": _over(F.col("PAY_AMT1") - F.col("PAY_AMT6"), "PAY_AMT6"),
        "balance_trend": _over(F.col("BILL_AMT6") - F.col("BILL_AMT1"), "BILL_AMT1"),
    })


def features_risk_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "payment_risk_score": F.col("max_pay_delay") * 0.3 + F.col("pay_delay_frequency") * 0.2 + F.col("severe_delay_count") * 0.5,
        "credit_risk_score": F.col("max_utilization_ratio") * 0.4 + F.col("debt_burden") * 0.3 + (1 - F.col("payment_burden")) * 0.3,
    }).withColumn("overall_risk_score", F.col("payment_risk_score") * 0.6 + F.col("credit_risk_score") * 0.4)


def features_temporal(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "payment_improving": F.coalesce(F.col("PAY_6") > F.col("PAY_0"), F.lit(False)).cast("int"),
        "payment_deteriorating": F.coalesce(F.col("PAY_0") > F.col("PAY_6"), F.lit(False)).cast("int"),
        "recent_pay_avg": row_mean(PAY_STATUS[:3]), "historical_pay_avg": row_mean(PAY_STATUS[3:]),
    }).withColumn("behavior_change", F.col("recent_pay_avg") - F.col("historical_pay_avg"))


def features_interaction(df: DataFrame) -> DataFrame:
    limit, risk = F.col("LIMIT_BAL") / 1000000, F.col("overall_risk_score")
    return df.withColumns({
        "age_limit_interaction": F.col("AGE") * limit, "age_risk_interaction": F.col("AGE") * risk,
        "gender_limit_interaction": F.col("SEX") * limit, "gender_risk_interaction": F.col("SEX") * risk,
        "education_limit_interaction": F.col("EDUCATION") * limit,
    })


def features_demographic(df: DataFrame) -> DataFrame:
    """Age group, limit quintile (linear quantile edges, right-closed) and a high-risk flag."""
    q = quantile_dict(df, ["LIMIT_BAL"], [i / 5 for i in range(6)])["LIMIT_BAL"]
    edges = [q[i / 5] for i in range(6)]
    age, edu, mar = F.col("AGE"), F.col("EDUCATION"), F.col("MARRIAGE")
    return df.withColumns({
        "age_group": bin_fixed("AGE", [0, 30, 40, 50, 100]).cast("double"),
        "limit_group": bin_by_edges("LIMIT_BAL", edges).cast("double"),
        "high_risk_demo": F.coalesce((age < 25) | (age > 65) | (edu > 3) | (mar == 3), F.lit(False)).cast("int"),
    })


def feature_pipeline(df: DataFrame, check: bool = True) -> DataFrame:
    """All feature groups in order, then infinities to medians and constant columns out."""
    require_columns(df, PANEL_COLUMNS)
    for step in (features_utilization, features_payment, features_health, features_risk_scores, features_temporal,
                 features_interaction, features_demographic):
        df = step(df)
    if not check:
        return df
    return finish_features(df)


def finish_features(df: DataFrame) -> DataFrame:
    """Infinite and missing numbers to the median, zero-variance columns out.

    Filling with a median cannot make a column constant or stop it from being
    so, hence one pass finds both the gaps and the constant columns.
    """
    cols = numeric_columns(df)

    def finite(c):
        x = f"CAST(`{c}` AS DOUBLE)"
        return f"CASE WHEN NOT isnan({x}) AND abs({x}) < DOUBLE('infinity') THEN `{c}` END"

    r = df.agg(F.count("*").alias("n"), *[F.expr(f"{fn}({finite(c)}) AS {a}{i}") for i, c in enumerate(cols) for fn, a in (("count", "n"), ("var_samp", "v"))]).first()
    gaps = [c for i, c in enumerate(cols) if r[f"n{i}"] < r["n"]]
    flat = [c for i, c in enumerate(cols) if r[f"v{i}"] == 0]
    df = df.withColumns({c: F.expr(finite(c)) for c in gaps})
    return fill(df, fit_fill_values(df, [c for c in gaps if c not in flat], "median")).drop(*flat)


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """Products of the columns up to ``degree`` named ``a b`` and ``a^2``; no bias column."""
    cols = [c for c in cols if c in df.columns]
    pick = combinations if interaction_only else combinations_with_replacement
    out = {}
    for d in range(2, degree + 1):
        for combo in pick(cols, d):
            powers = [(c, combo.count(c)) for c in dict.fromkeys(combo)]
            x = F.lit(1.0)
            for c in combo:
                x = x * F.col(f"`{c}`").cast("double")
            out[" ".join(c if p == 1 else f"{c}^{p}" for c, p in powers)] = x
    return df.withColumns(out) if out else df
