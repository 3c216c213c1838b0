"""Projections: renaming, typing, decoding, masking, ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.expr import lookup
from creditspark.schemas import CODE_LABELS, MISSING_MARKERS, PII_COLUMNS, TARGET


def normalize_column_names(df: DataFrame, method: str = "snake_case", collapse: bool = False) -> DataFrame:
    """Rename all columns to one style; two columns must not end up with the same name."""
    if method == "snake_case":
        names = [re.sub(r"[^a-zA-Z0-9]", "_", c).lower().strip("_") for c in df.columns]
        if collapse:
            names = [re.sub(r"_+", "_", n) for n in names]
    elif method in ("lower", "upper"):
        names = [getattr(c, method)() for c in df.columns]
    else:
        raise ValueError(f"unknown method: {method}")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"names collide: {twice}")
    return df.toDF(*names)


def clean_column_names(df: DataFrame) -> DataFrame:
    """Card-client names: PAY_0 becomes PAY_1, the dotted target a plain name, all in snake case."""
    return normalize_column_names(df.withColumnsRenamed({"PAY_0": "PAY_1", TARGET: "default_payment_next_month"}))


def coerce_types(df: DataFrame, numeric: Sequence[str] = (), ids: Sequence[str] = (), integers: Sequence[str] = ()) -> DataFrame:
    """Ids to text, numbers by a cast that turns bad text into null."""
    out = {c: F.col(f"`{c}`").cast("string") for c in ids}
    out |= {c: F.col(f"`{c}`").try_cast("double") for c in numeric}
    out |= {c: F.col(f"`{c}`").try_cast("double").try_cast("int") for c in integers}
    return df.withColumns({k: v for k, v in out.items() if k in df.columns})


def decode_categories(df: DataFrame, suffix: str = "_label") -> DataFrame:
    """Code labels next to the coded card-client columns."""
    out = {}
    for c in df.columns:
        table = CODE_LABELS.get("PAY" if re.fullmatch(r"PAY_\d", c) else c)
        if table:
            out[c + suffix] = lookup(c, table)
    return df.withColumns(out)


def decode_by_dimension(df: DataFrame, column: str, dimension: DataFrame, code: str, label: str) -> DataFrame:
    """Left join to a code table; codes without an entry get null."""
    dim = dimension.select(F.col(code).alias("_code"), F.col(label).alias(f"{column}_label"))
    return df.join(dim, F.col(column) == F.col("_code"), "left").drop("_code")


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns in training order; absent ones and nulls become 0."""
    return df.select(*keep, *[
        (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in features])


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as columns named by their path."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select([F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())])


def pii_columns(df: DataFrame) -> list[str]:
    """Columns whose name is a personal-data name."""
    return [c for c in df.columns if c.lower() in PII_COLUMNS]


def mask_pii(df: DataFrame, columns: Sequence[str] | None = None, method: str = "hash") -> DataFrame:
    """Personal columns hashed, or letters and digits masked."""
    cols = list(columns) if columns is not None else pii_columns(df)
    make = (lambda c: F.sha2(F.col(c).cast("string"), 256)) if method == "hash" else (lambda c: F.mask(F.col(c).cast("string")))
    return df.withColumns({c: make(c) for c in cols})


def unique_id(prefix: str = "", length: int = 8, keys: Sequence[str] = ()) -> Column:
    """Prefixed hexadecimal id: random, or repeatable from ``keys``."""
    raw = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])) if keys else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.lit(prefix), F.substring(raw, 1, length))


def missing_markers(df: DataFrame, markers: Sequence = MISSING_MARKERS) -> DataFrame:
    """Sentinel values to null, and NaN to null."""
    words = [m for m in markers if isinstance(m, str)]
    numbers = [m for m in markers if not isinstance(m, str)]
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(words + [str(n) for n in numbers]), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~(F.isnan(c) | c.isin([float(n) for n in numbers])), c)
        elif isinstance(f.dataType, T.NumericType):
            c = F.when(~c.isin(numbers), c)
        out.append(c.alias(f.name))
    return df.select(out)


# Keywords that assign a feature to a group, first group wins.
FEATURE_GROUPS = {
    "financial": ["income", "debt_to_income", "credit_utilization", "payment_history"],
    "demographic": ["age", "employment_length", "home_ownership"],
    "credit_history": ["credit_length", "num_accounts", "recent_inquiries"],
    "loan_specific": ["loan_amount", "loan_purpose", "interest_rate"],
}


def feature_category(feature: Column | str) -> Column:
    """Group of a feature name by keyword."""
    name = F.lower(F.col(feature) if isinstance(feature, str) else feature)
    out = F.lit("other")
    for group, words in reversed(FEATURE_GROUPS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        out = F.when(hit, group).otherwise(out)
    return out
