"""Feature ranking, selection and drift between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.functions.expr import bin_by_edges
from creditspark.functions.ordering import quantile_dict
from creditspark.operators.profiling import correlation_pairs, numeric_columns


def correlated_columns(pairs: Sequence, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns with |r| above the threshold to any earlier column."""
    at = {c: i for i, c in enumerate(cols)}
    return sorted({max(r["a"], r["b"], key=at.get) for r in pairs if r["r"] is not None and abs(r["r"]) > threshold}, key=at.get)


def drop_correlated(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Drop columns nearly collinear with an earlier one (one value per column pair reaches the driver)."""
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return df
    return df.drop(*correlated_columns(correlation_pairs(df, cols).collect(), cols, threshold))


def class_moments(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(feature, class, n, s, ss) from one grouped aggregate; ``ss`` is centered in the class."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), (F.var_pop(x) * F.count(x)).alias(f"v{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"v{i}").alias("ss"))
                      for i, c in enumerate(cols)])
    return df.groupBy(F.col(target).alias("class")).agg(*aggs).select("class", F.explode(cells).alias("c")).select("class", "c.*")


def anova_rank(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """One-way ANOVA F statistic per feature, best first."""
    m = class_moments(df, target, cols).where("n > 0")
    total = F.sum("s").over(W.partitionBy("feature")) / F.sum("n").over(W.partitionBy("feature"))
    g = m.withColumn("between", F.col("n") * F.pow(F.col("s") / F.col("n") - total, F.lit(2.0)))
    r = g.groupBy("feature").agg(F.sum("between").alias("b"), F.sum("ss").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return r.select("feature", F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("score")
                    ).orderBy(F.desc_nulls_last("score"), "feature")


def chi2_rank(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Chi-square of per-class sums of x - min(x) + 1 against the class shares, best first."""
    m = class_moments(df, target, cols)
    lows = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    low = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        low = F.when(F.col("feature") == c, F.lit(lows[i])).otherwise(low)
    w = W.partitionBy("feature")
    obs = m.withColumn("o", F.col("s") - F.col("n") * low + F.col("n"))
    exp = obs.withColumn("e", F.sum("o").over(w) * F.col("n") / F.sum("n").over(w))
    return exp.groupBy("feature").agg(F.sum(F.try_divide(F.pow(F.col("o") - F.col("e"), F.lit(2.0)), F.col("e"))).alias("score")).orderBy(
        F.desc("score"), "feature")


def mutual_info_rank(df: DataFrame, target: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information of the quantile-binned feature and the class, best first.

    The binned estimator replaces the nearest-neighbor one; it keeps the ranking
    purpose and needs only joint counts.
    """
    q = quantile_dict(df, cols, [i / bins for i in range(bins + 1)])
    binned = df.select(F.col(target).cast("string").alias("class"), *[
        bin_by_edges(F.col(f"`{c}`").cast("double"), sorted(set(q[c].values()))).alias(c) if len(set(q[c].values())) > 1
        else F.lit(1).alias(c) for c in cols])
    joint = binned.unpivot(["class"], list(cols), "feature", "bin").where("bin is not null").groupBy("feature", "class", "bin").agg(F.count("*").alias("n"))
    f = ["feature"]
    p = joint.withColumns({
        "t": F.sum("n").over(W.partitionBy(*f)), "a": F.sum("n").over(W.partitionBy(*f, "class")), "b": F.sum("n").over(W.partitionBy(*f, "bin"))})
    return p.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("score")).orderBy(
        F.desc("score"), "feature")


def rfe_rank(df: DataFrame, target: str, cols: Sequence[str], k: int = 10, trees: int = 50, depth: int = 5, seed: int = 42,
             step: int = 1) -> list[str]:
    """Names left after dropping the ``step`` least important features of a forest again and again."""
    from creditspark.operators.models import features_vector, forest

    cols = list(cols)
    data = df.select(target, *cols).persist()
    try:
        while len(cols) > k:
            fitted = forest(label=target, trees=trees, depth=depth, seed=seed).fit(features_vector(data, cols))
            order = sorted(range(len(cols)), key=lambda i: (fitted.featureImportances[i], -i))
            out = {cols[i] for i in order[:min(step, len(cols) - k)]}
            cols = [c for c in cols if c not in out]
    finally:
        data.unpersist()
    return cols


def select_features(df: DataFrame, target: str, method: str = "f_classif", k: int = 50, cols: Sequence[str] | None = None, **options) -> list[str]:
    """Names of the best k features by the method, in table order."""
    cols = list(cols or numeric_columns(df, [target]))
    if method == "rfe":
        return rfe_rank(df, target, cols, min(k, len(cols)), **options)
    rank = {"f_classif": anova_rank, "chi2": chi2_rank, "mutual_info": mutual_info_rank}
    if method not in rank:
        raise ValueError(f"unknown method: {method}")
    best = {r["feature"] for r in rank[method](df, target, cols, **options).limit(k).collect()}
    return [c for c in cols if c in best]


def psi_edges(expected: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Range of each feature in the expected table; a one-value range is widened by half on both sides."""
    r = expected.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(F.col(f"`{c}`").cast("double")).alias(f"a{i}"), F.max(F.col(f"`{c}`").cast("double")).alias(f"b{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = r[f"a{i}"], r[f"b{i}"]
        if lo is not None:
            out[c] = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    return out


def bucket_counts(df: DataFrame, edges: dict[str, tuple[float, float]], buckets: int) -> DataFrame:
    """Rows per (feature, bucket); values outside the range are in bucket -1, nulls in none."""
    out = []
    for c, (lo, hi) in edges.items():
        x = F.col(f"`{c}`").cast("double")
        b = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / buckets)), F.lit(buckets - 1)).cast("int")
        out.append(F.when(x.between(lo, hi), b).when(x.isNotNull(), -1).alias(c))
    return df.select(out).unpivot([], list(edges), "feature", "bucket").where("bucket is not null").groupBy("feature", "bucket").agg(F.count("*").alias("n"))


def psi(expected: DataFrame, actual: DataFrame, cols: Sequence[str] | None = None, buckets: int = 10,
        unstable_above: float = 0.1) -> DataFrame:
    """Population stability index per common feature over equal-width buckets of the expected table.

    Rows outside the expected range count in the denominator only. A bucket that
    is empty on both sides adds nothing, so only occupied ones are formed.
    """
    cols = list(cols or [c for c in numeric_columns(expected) if c in actual.columns])
    edges = psi_edges(expected, cols)
    return psi_from_counts(bucket_counts(expected, edges, buckets), bucket_counts(actual, edges, buckets), unstable_above)


def psi_from_counts(expected: DataFrame, actual: DataFrame, unstable_above: float = 0.1) -> DataFrame:
    """PSI from two ``bucket_counts`` tables."""
    zero = F.lit(0).cast("long")
    both = expected.select("feature", "bucket", F.col("n").alias("e"), zero.alias("a")).unionByName(
        actual.select("feature", "bucket", zero.alias("e"), F.col("n").alias("a"))).groupBy("feature", "bucket").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    w = W.partitionBy("feature")

    def share(c):
        return F.when(F.col(c) == 0, 0.0001).otherwise(F.try_divide(F.col(c), F.sum(c).over(w)))

    shares = both.select("feature", "bucket", share("e").alias("e"), share("a").alias("a")).where("bucket >= 0")
    return shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi")).withColumn(
        "unstable", F.col("psi") > unstable_above)
