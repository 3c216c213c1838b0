"""Profiles of a table: statistics, correlations, duplicates, quality."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.ordering import average_ranks, modes, quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[Column], Column]],
               name: str = "feature") -> DataFrame:
    """One row per column with the given statistics, all computed in a single aggregate."""
    aggs = [fn(F.col(f"`{c}`")).alias(f"s{i}_{s}") for i, c in enumerate(cols) for s, fn in stats.items()]
    cells = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"s{i}_{s}").alias(s) for s in stats]) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


def _d(fn):
    return lambda c: fn(c.cast("double"))


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c).cast("double")
    ok = n > 3
    return F.when(ok, F.when(ok, (n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * F.kurtosis(c) + 6))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column; quartiles are exact."""
    cols = list(cols or numeric_columns(df))
    stats = {"count": F.count, "mean": _d(F.avg), "std": _d(F.stddev_samp), "min": _d(F.min), "max": _d(F.max)}
    wide = quantiles(df, cols, list(QUARTILES.values())).groupBy("feature").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in QUARTILES.items()])
    return per_column(df, cols, stats).join(wide, "feature", "left")


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Center, spread and shape per column, with the mode and median."""
    base = per_column(df, cols, {
        "mean": _d(F.avg), "std": _d(F.stddev_samp), "variance": _d(F.var_samp), "skewness": _d(sample_skew),
        "kurtosis": _d(sample_kurtosis), "min": _d(F.min), "max": _d(F.max)})
    med = quantiles(df, cols, [0.5]).select("feature", F.col("value").alias("median"))
    mode = modes(df, cols).select("feature", F.col("value").cast("double").alias("mode"))
    return base.withColumn("range", F.col("max") - F.col("min")).join(med, "feature", "left").join(mode, "feature", "left")


def duplicate_groups(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Key columns that occur more than once with their number of copies; nulls compare equal."""
    cols = [f"`{c}`" for c in (subset or df.columns)]
    return df.groupBy(*cols).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one (all copies but the first), in one row."""
    cols = [f"`{c}`" for c in (subset or df.columns)]
    return df.groupBy(*cols).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Keep one row per key: the first by ``order``. An aggregate, so hot keys combine map-side."""
    if not subset:
        return df.distinct()
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.select(*subset).distinct()
    pick = F.min_by(F.struct(*rest), F.struct(*(order or rest)))
    return df.groupBy(*subset).agg(pick.alias("_r")).select(
        *[F.col(c) if c in subset else F.col(f"_r.{c}") for c in df.columns])


def frame_counts(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and null count per column in one row, from one shuffle."""
    g = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("_n"))
    return g.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_dups"),
        *[F.coalesce(F.sum(F.when(F.col(f"`{c}`").isNull(), F.col("_n"))), F.lit(0)).alias(f"_null{i}")
          for i, c in enumerate(df.columns)])


def dataset_info(df: DataFrame, target: str | None = None) -> DataFrame:
    """Shape, missing cells, duplicates and column kinds as (item, value) rows."""
    k = len(df.columns)
    counts = frame_counts(df)
    nulls = sum((F.col(f"_null{i}") for i in range(1, k)), F.col("_null0"))
    items = [("rows", F.col("_rows")), ("columns", F.lit(k)), ("missing_cells", nulls), ("duplicate_rows", F.col("_dups")),
             ("numeric_columns", F.lit(len(numeric_columns(df)))), ("text_columns", F.lit(len(text_columns(df))))]
    out = counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("item"), v.cast("double").alias("value")) for n, v in items])).alias("c")).select("c.*")
    if target:
        dist = df.groupBy(target).agg(F.count("*").cast("double").alias("value")).select(
            F.concat(F.lit(f"{target}="), F.coalesce(F.col(target).cast("string"), F.lit("null"))).alias("item"), "value")
        out = out.unionByName(dist)
    return out


def feature_metadata(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, nulls, distinct count and, for numbers, moments per column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    null = F.lit(None).cast("double")
    numeric = set(numeric_columns(df))
    types = dict(df.dtypes)
    aggs, cells = [F.count("*").alias("_n")], []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), distinct(x).alias(f"d{i}")]
        stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skewness": sample_skew}
        if c in numeric:
            aggs += [fn(x.cast("double")).alias(f"{s}{i}") for s, fn in stats.items()]
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"), F.col(f"n{i}").alias("nulls"),
            F.try_divide(F.col(f"n{i}") * 100.0, F.col("_n")).alias("null_pct"), F.col(f"d{i}").alias("distinct"),
            *[(F.col(f"{s}{i}") if c in numeric else null).alias(s) for s in stats]))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def feature_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shape before and after feature engineering: columns kept, added and removed, rows and cells."""
    a, b = before.columns, after.columns
    new, gone = [c for c in b if c not in a], [c for c in a if c not in b]
    rows = [("original", ",".join(a), len(a)), ("final", ",".join(b), len(b)), ("new", ",".join(new), len(new)),
            ("removed", ",".join(gone), len(gone))]
    return after.sparkSession.createDataFrame(rows, "item string, columns string, n int").withColumn(
        "ratio", F.col("n") / F.lit(float(len(a)))).withColumn("rows", after.agg(F.count("*")).scalar()).withColumn("cells", F.col("n") * F.col("rows"))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percent, most first."""
    n = F.count("*")
    r = per_column(df, df.columns, {"missing": lambda c: F.count_if(c.isNull()),
                                    "missing_pct": lambda c: F.try_divide(F.count_if(c.isNull()) * 100.0, n)})
    return r.where("missing > 0").orderBy(F.desc("missing"), "feature")


def missing_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0/1 null flags per row."""
    return df.select(*[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in cols])


def missing_pattern(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency of each combination of null flags."""
    return missing_matrix(df, cols).groupBy(*cols).agg(F.count("*").alias("n"))


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and consistency in percent and their mean.

    A text column that holds anything but numbers counts as inconsistent.
    """
    k = len(df.columns)
    texts = text_columns(df)
    counts = frame_counts(df)
    g = df.agg(*([F.max(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull(), 1).otherwise(0)).alias(f"t{i}")
                  for i, c in enumerate(texts)] or [F.lit(0).alias("t0")]))
    nulls = sum((F.col(f"_null{i}") for i in range(1, k)), F.col("_null0"))
    issues = sum((F.col(f"t{i}") for i in range(1, max(len(texts), 1))), F.coalesce(F.col("t0"), F.lit(0)))
    flags = g.select(issues.alias("_issues"), F.lit(1).alias("_one"))
    row = counts.withColumn("_one", F.lit(1)).join(flags, "_one")
    cells = F.col("_rows") * k
    out = row.select(
        F.try_divide((cells - nulls) * 100.0, cells).alias("completeness"),
        F.try_divide((F.col("_rows") - F.col("_dups")) * 100.0, F.col("_rows")).alias("uniqueness"),
        (F.greatest(F.lit(0), k - F.col("_issues")) * 100.0 / k).alias("consistency"),
        nulls.alias("missing_cells"), F.col("_dups").alias("duplicate_rows"), cells.alias("total_cells"),
        F.try_divide(nulls * 100.0, cells).alias("missing_percentage"),
        F.try_divide(F.col("_dups") * 100.0, F.col("_rows")).alias("duplicate_percentage"))
    return out.withColumn("overall", (F.col("completeness") + F.col("uniqueness") + F.col("consistency")) / 3)


def infer_feature_types(df: DataFrame, exclude: Sequence[str] = (), max_distinct: int = 10, max_ratio: float = 0.05) -> DataFrame:
    """numeric / categorical per column.

    A sketch first rules out columns with clearly many values, so exact distinct
    counts run only where at most a few dozen values are possible.
    """
    cols = [c for c in df.columns if c not in exclude]
    nums = [c for c in numeric_columns(df) if c in cols]
    few: dict[str, int] = {}
    n = 0
    if nums:
        rough = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(f"`{c}`").alias(c) for c in nums]).first()
        n = rough["n"]
        low = [c for c in nums if rough[c] < 5 * max_distinct]
        if low:
            few = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in low]).first().asDict()
    rows = []
    for c in cols:
        cat = c not in nums or (c in few and few[c] < max_distinct and n and few[c] / n < max_ratio)
        rows.append((c, "categorical" if cat else "numeric"))
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def correlation_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of every column pair over the rows where both are present."""
    pairs = list(combinations(cols, 2))
    if method == "pearson":
        aggs = [F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"r{i}")
                for i, (a, b) in enumerate(pairs)]
        cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                          for i, (a, b) in enumerate(pairs)])
        return df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    if method == "spearman":
        out = [spearman(df, a, b) for a, b in pairs]
    elif method == "kendall":
        from creditspark.operators.kendall import kendall_tau
        out = [kendall_tau(df, a, b) for a, b in pairs]
    else:
        raise ValueError(f"unknown method: {method}")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with averaged ties.

    Distinct value pairs are counted first, ranks come from the value counts,
    and the weighted sums of the correlation are taken over the pairs.
    """
    both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    pairs = both.groupBy("x", "y").agg(F.count("*").alias("w"))
    r = pairs.join(average_ranks(both, "x", "rx"), "x").join(average_ranks(both, "y", "ry"), "y")
    n = F.sum("w")
    mean = (n + 1) / 2  # averaged ranks keep the mean of 1..n
    sxy = F.sum(F.col("w") * F.col("rx") * F.col("ry")) - n * mean * mean
    sxx = F.sum(F.col("w") * F.col("rx") * F.col("rx")) - n * mean * mean
    syy = F.sum(F.col("w") * F.col("ry") * F.col("ry")) - n * mean * mean
    return r.agg(F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)).alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r")


def high_correlations(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.where(F.abs("r") > threshold).orderBy(F.abs(F.col("r")).desc(), "a", "b")


def correlation_matrix(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Symmetric wide form of ``correlation_pairs`` with a diagonal of ones."""
    both = pairs.selectExpr("a AS feature", "b AS _other", "r").unionByName(pairs.selectExpr("b AS feature", "a AS _other", "r"))
    return both.groupBy("feature").agg(*[
        F.max(F.when(F.col("feature") == c, 1.0).when(F.col("_other") == c, F.col("r"))).alias(c) for c in cols])


def target_correlation(df: DataFrame, target: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Columns with the largest absolute correlation to the target."""
    r = per_column(df, cols, {"r": lambda c: F.corr(c.cast("double"), F.col(target).cast("double"))})
    return r.withColumn("abs_r", F.abs("r")).where("abs_r is not null").orderBy(F.desc("abs_r"), "feature").limit(k)


def percentiles(df: DataFrame, column: str, ps: Sequence[float] = (5, 10, 25, 50, 75, 90, 95), by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, [column], [p / 100 for p in ps], by)


def box_stats(df: DataFrame, column: str, by: str, k: float = 1.5) -> DataFrame:
    """Five-number summary and outlier fences per group."""
    ends = [F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n")]
    parts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    iqr = F.col("q3") - F.col("q1")
    q = quantiles(df, [column], list(parts.values()), [by]).groupBy(F.col(by).alias("_g")).agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in parts.items()])
    five = df.groupBy(by).agg(*ends).join(q, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
    return five.withColumns({"lower_fence": F.col("q1") - k * iqr, "upper_fence": F.col("q3") + k * iqr})


def target_balance(df: DataFrame, target: str) -> DataFrame:
    from pyspark.sql import Window as W
    return df.groupBy(target).agg(F.count("*").alias("n")).withColumn(
        "share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))
