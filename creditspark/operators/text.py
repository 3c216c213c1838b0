"""Reason lists and explanation texts built from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from creditspark.functions.expr import risk_band, row_count_if, texts
from creditspark.operators.scoring import COMPOSITE_WEIGHTS
from creditspark.schemas import PAY_STATUS

# Advice lines per composite risk level.
LEVEL_ADVICE = {
    "Low": ["Approve loan with standard terms", "Consider offering premium rates"],
    "Medium": ["Approve with careful monitoring", "Consider additional documentation", "Apply moderate risk premium"],
    "High": ["High risk - consider rejection", "If approved, require significant risk premium", "Implement strict monitoring"],
}


def reason_codes() -> Column:
    """Risk reasons of an applicant row; a fixed text when there are none."""
    income = F.col("annual_income")
    ratio = F.when(income > 0, F.col("monthly_expenses") / F.when(income > 0, income / 12))
    return texts(
        (income < 30000, "Low annual income"),
        (F.col("previous_defaults") > 0, F.concat(F.col("previous_defaults").cast("string"), F.lit(" previous defaults"))),
        (F.col("credit_utilization") > 80, "High credit utilization"),
        (F.col("credit_history_length") < 2, "Limited credit history"),
        (ratio > 0.5, "High debt-to-income ratio"),
        (F.col("existing_debt") > income * 0.5, "High existing debt burden"),
        default="No significant risk factors identified",
    )


def factor_lists(df: DataFrame) -> DataFrame:
    """Risk and protective factor texts of a card-client row; whole-number limits have no decimals."""
    limit, age = F.col("LIMIT_BAL"), F.col("AGE")
    late = row_count_if([c for c in PAY_STATUS if c in df.columns], "> 0")
    money = F.concat(F.lit("($"), F.format_number(limit, 0 if isinstance(df.schema["LIMIT_BAL"].dataType, IntegralType) else 2), F.lit(")"))
    years = F.concat(F.lit("("), age.cast("string"), F.lit(")"))
    return df.withColumns({
        "risk_factors": texts(
            (limit < 50000, F.concat_ws(" ", F.lit("Low credit limit"), money, F.lit("may indicate limited creditworthiness"))),
            (age < 25, F.concat_ws(" ", F.lit("Young age"), years, F.lit("associated with higher default risk"))),
            (late > 3, F.format_string("Multiple late payments (%d/6 months) indicate payment difficulties", late))),
        "protective_factors": texts(
            (limit > 500000, F.concat_ws(" ", F.lit("High credit limit"), money, F.lit("indicates financial stability"))),
            (age > 50, F.concat_ws(" ", F.lit("Mature age"), years, F.lit("associated with lower default risk"))),
            (late == 0, "No late payments in recent history")),
    })


def risk_explanation(score: str = "composite_score", places: int = 2) -> Column:
    """Markdown text of a composite score: level, parts and advice lines."""
    level = risk_band(score, "composite")
    head = F.format_string(f"**Risk Level: %s** (Score: %.{places}f)\n\n**Risk Factors:**\n", level, F.col(score))
    parts = [
        F.when(F.col(f"risk_{k}").isNotNull(),
               F.format_string(f"- {k.replace('_', ' ').title()}: %s (%.2f)\n",
                               risk_band(f"risk_{k}", "composite"), F.col(f"risk_{k}")))
        for k in COMPOSITE_WEIGHTS]
    advice = F.lit(None).cast("string")
    for name, lines in LEVEL_ADVICE.items():
        advice = F.when(level == name, "".join(f"- {x}\n" for x in lines)).otherwise(advice)
    return F.concat_ws("", head, *parts, F.lit("\n**Recommendations:**\n"), advice)
