"""Scaling and encoding with fitted parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.ordering import quantile_dict
from creditspark.operators.profiling import numeric_columns
from creditspark.sources.io import materialize

MAX_CATEGORIES = 1000  # of the form with a column per category; encode_onehot_sparse has no limit


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(center, scale) per column; a scale of 0 is replaced by 1 as for constant columns."""
    if method == "robust":
        q = quantile_dict(df, cols, [0.25, 0.5, 0.75])
        out = {c: (v.get(0.5), None if v.get(0.75) is None else v[0.75] - v[0.25]) for c, v in q.items()}
    else:
        pairs = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}
        if method not in pairs:
            raise ValueError(f"unknown method: {method}")
        a, b = pairs[method]
        r = df.agg(*[x for i, c in enumerate(cols) for x in (
            a(F.col(f"`{c}`").cast("double")).alias(f"a{i}"), b(F.col(f"`{c}`").cast("double")).alias(f"b{i}"))]).first()
        out = {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}
        if method == "minmax":
            out = {c: (lo, None if lo is None else hi - lo) for c, (lo, hi) in out.items()}
    return {c: (m, s or 1.0) for c, (m, s) in out.items() if m is not None}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def scale(df: DataFrame, method: str = "standard", exclude: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """standard (population std), minmax, robust (median / IQR) or quantile (to a normal shape)."""
    cols = list(cols or numeric_columns(df, exclude))
    if method == "quantile":
        return quantile_to_normal(df, cols)
    return apply_scaler(df, fit_scaler(df, cols, method))


# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of probabilities inside (0, 1), relative error about 1e-9."""
    p = np.asarray(p, dtype=float)
    tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    outer = np.polyval(_C, tail) / np.polyval([*_D, 1.0], tail)
    q = p - 0.5
    inner = np.polyval(_A, q * q) * q / np.polyval([*_B, 1.0], q * q)
    low = np.minimum(p, 1 - p) < 0.02425
    return np.where(low, np.where(p < 0.5, outer, -outer), inner)


def quantile_to_normal(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000) -> DataFrame:
    """Map each column through its empirical distribution to a normal one.

    The fitted references are at most ``n_quantiles`` exact quantiles per column,
    at any table size.
    Ties take the middle of their probability range, ends are clipped.
    """
    n = df.count()
    k = max(2, min(n_quantiles, n))
    probs = [i / (k - 1) for i in range(k)]
    refs = {c: [q.get(p) for p in probs] for c, q in quantile_dict(df, cols, probs).items()}
    grid = np.array(probs)
    bound = float(inverse_normal(np.array([1e-7]))[0])

    def mapper(values: list[float]):
        edges = np.array(values, dtype=float)

        @F.pandas_udf(T.DoubleType())
        def to_normal(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            up = np.interp(v, edges, grid)
            down = 1 - np.interp(-v, -edges[::-1], grid)
            p = np.clip((up + down) / 2, 1e-7, 1 - 1e-7)
            return pd.Series(np.where(np.isnan(v), np.nan, np.clip(inverse_normal(p), bound, -bound)))

        return to_normal

    out = {}
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        if refs[c] and refs[c][0] is not None:
            out[c] = F.when(x.isNotNull(), mapper(refs[c])(x))
    return df.withColumns(out)


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct values of a low-cardinality column."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories; use encode_onehot_sparse")
    return sorted(r[0] for r in rows)


def encode_onehot(df: DataFrame, cols: Sequence[str], fitted: dict[str, list] | None = None, drop_first: bool = True) -> DataFrame:
    """0/1 columns per category, nulls as the category ``missing``, unknown values all zero."""
    out = {}
    for c in cols:
        filled = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        levels = (fitted or {}).get(c) or categories(df.select(filled.alias(c)), c)
        for v in levels[1:] if drop_first else levels:
            out[f"{c}_{v}"] = F.when(filled == F.lit(v), 1.0).otherwise(0.0)
    return df.withColumns(out).drop(*cols)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes 0.. in sorted order, as longs; nulls have none.

    The distinct values are cut into ranges, written once, and numbered inside their
    range behind the counts of the ranges before; only one count per range meets in one task.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranged = materialize(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "labels")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(W.partitionBy("_part").orderBy("value")) - 1
    return ranged.withColumn("_number", number).join(before, "_part").select("value", (F.col("_number") + F.col("_before")).alias("code"))


def onehot_levels(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """(name, level, position) of every category of every column, nulls as ``missing``; the first of a column has no position.

    Any number of categories: they are numbered in ranges by ``label_codes`` and stay a table;
    the driver sees one count per column.
    """
    tables, offset = [], 0
    for c in cols:
        codes = materialize(label_codes(df.select(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")).alias(c)), c), "levels")
        code = F.col("code") - int(drop_first)
        tables.append(codes.select(F.lit(c).alias("name"), F.col("value").alias("level"), F.when(code >= 0, code + offset).alias("position")))
        offset += max(codes.count() - int(drop_first), 0)
    return reduce(DataFrame.unionByName, tables)


def encode_onehot_sparse(df: DataFrame, cols: Sequence[str], levels: DataFrame | None = None, name: str = "onehot", drop_first: bool = True) -> DataFrame:
    """The columns as one array of the positions that are 1, ascending; first and unknown categories have none.

    The same encoding as ``encode_onehot`` without a column per category, for columns of any number of categories.
    """
    levels = onehot_levels(df, cols, drop_first) if levels is None else levels
    places = [f"_at{i}" for i in range(len(cols))]
    for c, at in zip(cols, places):
        own = levels.where((F.col("name") == c) & F.col("position").isNotNull()).select(F.col("level").alias("_level"), F.col("position").alias(at))
        df = df.join(own, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")) == F.col("_level"), "left").drop("_level")
    return df.withColumn(name, F.array_compact(F.array(*places))).drop(*cols, *places)


def onehot_vector(df: DataFrame, cols: Sequence[str], levels: DataFrame, name: str = "onehot") -> DataFrame:
    """The sparse ``pyspark.ml`` vector of the same positions, a stretch per column, for use in an estimator."""
    parts = []
    for i, c in enumerate(cols):
        own = levels.where((F.col("name") == c) & F.col("position").isNotNull())
        low, high = own.agg(F.min("position"), F.max("position")).first()
        if low is None:
            continue
        at, part = f"_at{i}", f"_part{i}"
        coded = own.select(F.col("level").alias("_level"), (F.col("position") - low).cast("double").alias(at))
        df = df.join(coded, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")) == F.col("_level"), "left").drop("_level")
        df = df.withColumn(at, F.coalesce(at, F.lit(float(high - low + 1))))  # beyond the last category: all zero
        df = OneHotEncoder(inputCol=at, outputCol=part, handleInvalid="keep", dropLast=True).fit(coded).transform(df).drop(at)
        parts.append(part)
    if not parts:
        raise ValueError("no column has a second category")
    return VectorAssembler(inputCols=parts, outputCol=name).transform(df).drop(*cols, *parts)


def encode_label(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    codes = label_codes(df, column).select(F.col("value").alias("_label"), F.col("code").alias(name or f"{column}_code"))
    return df.join(codes, F.col(column) == F.col("_label"), "left").drop("_label")


def fit_preparation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scaling: str = "standard") -> dict:
    """Column-wise preparation state: medians, scaling of the filled columns, sorted category levels."""
    from creditspark.operators.clean import fill, fit_fill_values

    medians = fit_fill_values(df, numeric, "median")
    doubles = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    levels = {c: categories(df.select(F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c)), c) for c in categorical}
    return {"median": medians, "scale": fit_scaler(fill(doubles, medians), numeric, scaling), "levels": levels}


def apply_preparation(df: DataFrame, fitted: dict) -> DataFrame:
    """Fill and scale the numbers, one-hot the text; rows unseen in the fit are handled alike."""
    from creditspark.operators.clean import fill

    doubles = df.withColumns({c: F.col(c).cast("double") for c in fitted["scale"]})
    scaled = apply_scaler(fill(doubles, fitted["median"]), fitted["scale"])
    return encode_onehot(scaled, list(fitted["levels"]), fitted["levels"])


def prep_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """The preparation as ``pyspark.ml`` stages, for use in front of an estimator.

    Differs from ``fit_preparation`` in what the stages offer: the median is an
    approximate quantile, the scale the sample deviation, and no category is dropped.
    """
    numeric, categorical = list(numeric), list(categorical)
    stages, inputs = [], []
    if numeric:
        stages += [
            Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric], relativeError=1e-5),
            VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="numeric_vector"),
            StandardScaler(inputCol="numeric_vector", outputCol="numeric_scaled", withMean=True, withStd=True)]
        inputs.append("numeric_scaled")
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True)]
        inputs += [f"{c}_hot" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


def full_preparation(df: DataFrame, target: str, keys: Sequence[str], fit_on_train: bool = False) -> DataFrame:
    """Impute, cap outliers, add features, scale and split in one call.

    By default the statistics come from all rows; ``fit_on_train`` takes the
    scaling from the training rows only.
    """
    from creditspark.operators.clean import handle_outliers, impute_auto
    from creditspark.operators.features import features_basic
    from creditspark.operators.rows import stratified_split

    keep = [*keys, target]
    df = impute_auto(df)
    df = handle_outliers(df, [c for c in numeric_columns(df, keep) if c.startswith(("BILL", "PAY_AMT", "LIMIT"))])
    df = stratified_split(features_basic(df), keys, target)
    cols = numeric_columns(df, keep)
    base = df.where(F.col("split") == "train") if fit_on_train else df
    return apply_scaler(df, fit_scaler(base, cols))

