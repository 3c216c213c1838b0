"""Validation reports as rows (severity, check, detail / count)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.profiling import frame_counts, numeric_columns
from creditspark.schemas import BILLS, PAY_STATUS, PAYMENTS, VALUE_RANGES

# E-mail and phone patterns of the row rules.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?\d{9,15}$"

# Required columns and rules of a batch upload.
BATCH_REQUIRED = ["age", "gender", "education", "marital_status", "employment_status", "annual_income", "monthly_expenses",
                  "existing_debt", "credit_history_length", "previous_defaults", "credit_utilization"]
BATCH_CRITICAL = ["age", "annual_income", "monthly_expenses"]


def _rows(row: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into (severity, check, n) rows."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"))
        for sev, name, n in checks])).alias("c")).select("c.*")


def validate_frame(df: DataFrame, required: Sequence[str] = (), min_rows: int = 1, max_rows: int | None = None) -> DataFrame:
    """Row bounds, required columns, nulls and duplicates; ``n`` is what was counted."""
    counts = frame_counts(df)
    nulls = sum((F.col(f"_null{i}") for i in range(1, len(df.columns))), F.col("_null0"))
    checks = [("info", "rows", F.col("_rows")),
              ("error", "too_few_rows", (F.col("_rows") < min_rows).cast("int")),
              ("warning", "null_values", nulls), ("warning", "duplicate_rows", F.col("_dups"))]
    if max_rows is not None:
        checks.append(("error", "too_many_rows", (F.col("_rows") > max_rows).cast("int")))
    checks += [("error", f"missing_column:{c}", F.lit(1)) for c in required if c not in df.columns]
    checks += [("info", f"nulls:{c}", F.col(f"_null{i}")) for i, c in enumerate(df.columns)]
    return _rows(counts, checks)


def count_rules(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Rows for which each violation holds, all in one pass."""
    row = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, _, cond) in enumerate(rules)])
    return _rows(row, [(sev, name, F.col(f"r{i}")) for i, (sev, name, _) in enumerate(rules)])


def _outside(c: str, allowed: Sequence) -> Column:
    return ~F.col(c).isin(list(allowed))


def validate_card_clients(df: DataFrame, target: str) -> DataFrame:
    """Domain checks of the card-client table and the bounds of its default rate."""
    rules: list[tuple[str, str, Column]] = [
        ("error", "target_domain", _outside(target, [0, 1])),
        ("warning", "sex_domain", _outside("SEX", [1, 2])),
        ("warning", "education_domain", _outside("EDUCATION", range(0, 7))),
        ("warning", "marriage_domain", _outside("MARRIAGE", range(0, 4))),
        ("warning", "age_range", ~F.col("AGE").between(18, 100)),
        ("error", "negative_limit", F.col("LIMIT_BAL") < 0),
    ]
    rules += [("warning", f"{c}_range", ~F.col(c).between(-2, 8)) for c in PAY_STATUS]
    rules += [("warning", f"{c}_negative", F.col(c) < 0) for c in [*BILLS, *PAYMENTS]]
    aggs = [F.count_if(cond).alias(f"r{i}") for i, (_, _, cond) in enumerate(rules)]
    row = df.agg(*aggs, F.avg(target).alias("rate"))
    checks = [(sev, name, F.col(f"r{i}")) for i, (sev, name, _) in enumerate(rules)]
    checks.append(("warning", "default_rate_bounds", (~F.col("rate").between(0.1, 0.5)).cast("int")))
    return _rows(row, checks)


def validate_ranges(df: DataFrame, ranges: Mapping[str, tuple] = VALUE_RANGES) -> DataFrame:
    """Rows below and above the allowed range and rows that are no number, per column."""
    rules = []
    for c, (lo, hi) in ranges.items():
        if c not in df.columns:
            continue
        x = F.col(c).try_cast("double")
        rules += [("error", f"{c}:below", x < lo), ("error", f"{c}:above", x > hi),
                  ("error", f"{c}:not_numeric", F.col(c).isNotNull() & x.isNull())]
    return count_rules(df, rules)


def validate_batch(df: DataFrame) -> DataFrame:
    """Upload checks: required columns, plausible age and income, no nulls in the critical columns."""
    rules: list[tuple[str, str, Column]] = []
    if "age" in df.columns:
        rules.append(("error", "age_range", ~F.col("age").between(0, 120)))
    if "annual_income" in df.columns:
        rules.append(("error", "negative_income", F.col("annual_income") < 0))
    rules += [("error", f"null:{c}", F.col(c).isNull()) for c in BATCH_CRITICAL if c in df.columns]
    missing = [(c, F.lit(True)) for c in BATCH_REQUIRED if c not in df.columns]
    rules += [("error", f"missing_column:{c}", cond) for c, cond in missing]
    return count_rules(df, rules)


def validate_model_input(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add ``errors``: a text per required feature that is absent, null or not castable."""
    parts = []
    for c, t in types.items():
        if c not in df.columns:
            parts.append(F.lit(f"Missing required feature: {c}"))
            continue
        x = F.col(c)
        parts.append(F.when(x.isNull(), f"Feature '{c}' cannot be None")
                     .when(x.try_cast(t).isNull(), f"Feature '{c}' type error"))
    return df.withColumn("errors", F.array_compact(F.array(*parts)))


def split_valid(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with cast features, rejected rows with their errors)."""
    checked = validate_model_input(df, types)
    good = checked.where(F.size("errors") == 0).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()}).drop("errors")
    return good, checked.where(F.size("errors") > 0)


def validate_processed(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Infinities, values beyond +-1000 per column, and a minority class under 5 %."""
    cols = list(cols or numeric_columns(df, [target]))
    aggs, checks = [], []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        inf = F.abs(x) == F.lit(float("inf"))
        aggs += [F.count_if(inf).alias(f"i{i}"), F.max(F.abs(x)).alias(f"m{i}")]
        checks += [("error", f"{c}:infinite", F.col(f"i{i}")), ("warning", f"{c}:extreme", (F.col(f"m{i}") > 1000).cast("int"))]
    aggs.append(F.avg(F.col(target).cast("double")).alias("rate"))
    low = F.least(F.col("rate"), 1 - F.col("rate"))
    checks.append(("warning", "minority_below_5pct", (low < 0.05).cast("int")))
    return _rows(df.agg(*aggs), checks)


def row_rules(df: DataFrame, email: str | None = None, phone: str | None = None, score: str | None = None,
              age: str | None = None) -> DataFrame:
    """Add a 0/1 column per rule; text that holds a number is accepted for the numeric ones."""
    out = {}
    if email:
        out["valid_email"] = F.coalesce(F.col(email).rlike(EMAIL), F.lit(False))
    if phone:
        out["valid_phone"] = F.coalesce(F.col(phone).rlike(PHONE), F.lit(False))
    if score:
        out["valid_score"] = F.coalesce(F.col(score).try_cast("double").between(300, 850), F.lit(False))
    if age:
        out["valid_age"] = F.coalesce(F.col(age).try_cast("double").between(18, 100), F.lit(False))
    return df.withColumns(out)


def schema_match(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing and extra columns against an expected list, with the values an extra column holds."""
    rows = [("missing", c, F.lit(0)) for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    counts = df.agg(F.count("*").alias("_n"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(extra)])
    rows += [("extra", c, F.col(f"n{i}")) for i, c in enumerate(extra)]
    cells = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), n.cast("long").alias("values")) for k, c, n in rows]
    if not cells:
        return df.sparkSession.createDataFrame([], "kind string, column string, values long")
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
