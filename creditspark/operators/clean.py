"""Imputation, outliers, infinities, constant columns.

Fitted statistics are one number per column; they come to the driver and go
back into the plan as literals, so the transformation is a plain projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.neighbors import nearest
from creditspark.functions.ordering import modes, quantile_dict
from creditspark.operators.profiling import numeric_columns


def null_shares(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Share of nulls per column."""
    if not cols:
        return {}
    r = df.agg(*[F.avg(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: r[i] or 0.0 for i, c in enumerate(cols)}


def fit_fill_values(df: DataFrame, cols: Sequence[str], strategy: str) -> dict:
    """Fill value per column for ``mean``, ``median`` or ``mode``; columns without values are left out."""
    if not cols:
        return {}
    if strategy == "mean":
        r = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        out = {c: r[i] for i, c in enumerate(cols)}
    elif strategy == "median":
        out = {c: q[0.5] for c, q in quantile_dict(df, cols, [0.5]).items()}
    elif strategy == "mode":
        out = {r["feature"]: r["value"] for r in modes(df, cols).collect()}
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return {c: v for c, v in out.items() if v is not None}


def fill(df: DataFrame, values: Mapping) -> DataFrame:
    """Fill nulls with fitted values. Whole-number columns become doubles when the value is fractional."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c, v in values.items():
        x, t = F.col(f"`{c}`"), types[c]
        if isinstance(t, T.IntegralType) and not isinstance(v, str) and v != int(v):
            out[c] = F.coalesce(x.cast("double"), F.lit(v))
        else:
            out[c] = F.coalesce(x, F.lit(v).cast("double").cast(t) if isinstance(t, T.IntegralType) else F.lit(v).cast(t))
    return df.withColumns(out)


def impute(df: DataFrame, strategy: str = "mean", cols: Sequence[str] | None = None) -> DataFrame:
    """mean / median (numbers only), mode, drop or keep."""
    cols = [c for c in (cols or df.columns) if c in df.columns]
    if strategy == "keep":
        return df
    if strategy == "drop":
        return df.dropna(subset=list(cols))
    if strategy in ("mean", "median"):
        cols = [c for c in cols if c in numeric_columns(df)]
    return fill(df, fit_fill_values(df, cols, strategy))


def impute_auto(df: DataFrame, drop_above: float = 0.5) -> DataFrame:
    """Drop columns that are mostly null, then median for numbers and mode for the rest."""
    share = null_shares(df, df.columns)
    df = df.drop(*[c for c in df.columns if share[c] > drop_above])
    gaps = [c for c in df.columns if share[c] > 0]
    nums = numeric_columns(df)
    values = fit_fill_values(df, [c for c in gaps if c in nums], "median")
    values |= fit_fill_values(df, [c for c in gaps if c not in nums], "mode")
    return fill(df, values)


def impute_knn(df: DataFrame, key: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Fill each column with the mean of its k nearest rows that have it.

    Distances skip missing coordinates. A row without any common coordinate gets
    the column mean. ``key`` is a unique whole number. Exact; with few columns a row meets
    few of the others, with many it meets most of them, and ``impute`` is the linear choice.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x"), *[F.col(c).cast("double").alias(c) for c in cols])
    share = null_shares(df, cols)
    out = df.withColumns({c: F.col(c).cast("double") for c in cols})
    means = fit_fill_values(df, [c for c in cols if share[c] > 0], "mean")
    for c in means:
        near = nearest(rows.where(F.col(c).isNull()), rows.where(F.col(c).isNotNull()), k)
        donors = rows.select(F.col("id").alias("neighbor"), F.col(c).alias("_v"))
        got = near.join(donors, "neighbor").groupBy(F.col("query").alias("_q")).agg(F.avg("_v").alias("_f"))
        out = out.join(got, F.col(key) == F.col("_q"), "left").withColumn(
            c, F.coalesce(F.col(c), F.col("_f"), F.lit(means[c]))).drop("_q", "_f")
    return out


def fit_fences(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper outlier bound per column."""
    if method == "iqr":
        q = quantile_dict(df, cols, [0.25, 0.75])
        return {c: (v[0.25] - threshold * (v[0.75] - v[0.25]), v[0.75] + threshold * (v[0.75] - v[0.25]))
                for c, v in q.items() if v.get(0.25) is not None}
    if method == "zscore":
        r = df.agg(*[a for i, c in enumerate(cols) for a in (
            F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))]).first()
        return {c: (r[f"m{i}"] - threshold * r[f"s{i}"], r[f"m{i}"] + threshold * r[f"s{i}"])
                for i, c in enumerate(cols) if r[f"m{i}"] is not None}
    raise ValueError(f"unknown method: {method}")


def outlier_flags(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5,
                  suffix: str = "_outlier") -> DataFrame:
    """0/1 flag per column for values outside the fences."""
    fences = fit_fences(df, cols, method, threshold)
    return df.withColumns({c + suffix: F.when((F.col(c) < lo) | (F.col(c) > hi), 1).otherwise(0) for c, (lo, hi) in fences.items()})


def outlier_report(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Count and percent of outliers per column with the fences used."""
    fences = fit_fences(df, cols, method, threshold)
    aggs = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"n{i}") for i, (c, (lo, hi)) in enumerate(fences.items())]
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.col(f"n{i}").alias("outliers"),
                 F.try_divide(F.col(f"n{i}") * 100.0, F.col("_n")).alias("outlier_pct"))
        for i, (c, (lo, hi)) in enumerate(fences.items())])
    return df.agg(F.count("*").alias("_n"), *aggs).select(F.explode(cells).alias("c")).select("c.*")


def handle_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", action: str = "cap", threshold: float = 1.5,
                    sequential: bool = False) -> DataFrame:
    """cap / remove / flag outliers. ``sequential`` removes column by column, each time with new fences."""
    if action == "flag":
        return outlier_flags(df, cols, method, threshold)
    if action == "remove" and sequential:
        for c in cols:
            df = handle_outliers(df, [c], method, "remove", threshold)
        return df
    fences = fit_fences(df, cols, method, threshold)
    if action == "cap":
        return df.withColumns({
            c: F.when(F.col(c) < lo, lo).when(F.col(c) > hi, hi).otherwise(F.col(c).cast("double")) for c, (lo, hi) in fences.items()})
    if action == "remove":
        for c, (lo, hi) in fences.items():
            df = df.where(F.col(c).isNull() | F.col(c).between(lo, hi))
        return df
    raise ValueError(f"unknown action: {action}")


def infinity_cleanup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite and NaN values to null, then nulls to the median."""
    inf = float("inf")
    finite = df.withColumns({
        c: F.when(~F.col(c).cast("double").isin(inf, -inf) & ~F.isnan(F.col(c).cast("double")), F.col(c)) for c in cols})
    share = null_shares(finite, cols)
    return fill(finite, fit_fill_values(finite, [c for c in cols if share[c] > 0], "median"))


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    r = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[i] == 0]


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop zero-variance number columns."""
    return df.drop(*constant_columns(df, cols or numeric_columns(df)))
