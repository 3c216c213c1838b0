"""Contributions, surrogates and importances for scored rows.

All methods score ordinary tables: perturbed rows are exploded, the model is
applied once by ``score`` and the results are averaged by map-side combining
aggregates. Random draws are hashes of the row key, so results do not depend
on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.neighbors import nearest
from creditspark.functions.ordering import hash_rank
from creditspark.functions.trees import Node, ensemble_paths, interaction_values, shapley_values
from creditspark.operators.columns import feature_category
from creditspark.operators.evaluation import roc_auc
from creditspark.operators.models import add_scores
from creditspark.operators.rows import sample_rows, top_k_per_group
from creditspark.sources.io import materialize, scratch_path

Score = Callable[[DataFrame], DataFrame]  # adds a column ``p`` to a table with the feature columns


def scorer(model, cols: Sequence[str]) -> Score:
    """Score by a fitted model; unlike a batch prediction it does not fill columns that are absent."""

    def score(df: DataFrame) -> DataFrame:
        absent = [c for c in cols if c not in df.columns]
        if absent:
            raise ValueError(f"the model needs the columns {', '.join(absent)}")
        return add_scores(df, {"m": model}, cols).withColumnRenamed("p_m", "p")

    return score


def uniform(*parts: Column) -> Column:
    """Repeatable uniform number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(2 ** 53)


def gaussian(*parts: Column) -> Column:
    """Repeatable standard normal number."""
    return F.sqrt(-2 * F.ln(uniform(F.lit(17), *parts))) * F.cos(uniform(F.lit(29), *parts) * (2 * math.pi))


def background(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Reference rows with a number 0.. : at most ``n``, so they are broadcast."""
    rows = sample_rows(df.select(*keys, *cols), keys, n, seed)
    return rows.select((F.row_number().over(W.orderBy(*keys)) - 1).alias("bg"), *[F.col(c).cast("double").alias(f"b_{c}") for c in cols])


def linear_shap(df: DataFrame, key: str, cols: Sequence[str], coefficients: Sequence[float], intercept: float = 0.0,
                means: Sequence[float] | None = None) -> DataFrame:
    """coef * (x - mean) per feature on the margin scale, as (key, feature, contribution, base_value)."""
    if means is None:
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        means = [r[i] for i in range(len(cols))]
    base = intercept + sum(w * m for w, m in zip(coefficients, means))
    wide = df.select(key, *[((F.col(c).cast("double") - F.lit(m)) * F.lit(w)).alias(c) for c, w, m in zip(cols, coefficients, means)])
    return wide.unpivot([key], list(cols), "feature", "contribution").withColumn("base_value", F.lit(base))


def sampled_shap(df: DataFrame, key: str, cols: Sequence[str], score: Score, reference: DataFrame, permutations: int = 10,
                 seed: int = 42) -> DataFrame:
    """Shapley values by random feature orders against random reference rows.

    Each (row, order) walks from the reference row to the explained row one
    feature at a time; a feature's value is the mean score change at its step.
    The contributions of a row and its base value add up to its score.
    """
    d = len(cols)
    n_ref = reference.count()  # bounded by construction of ``background``
    draws = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    draws = draws.withColumn("bg", F.pmod(F.xxhash64(F.lit(seed), key, "perm"), F.lit(n_ref)).cast("int"))
    walk = draws.join(F.broadcast(reference), "bg")
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("perm"), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(d)]))
    walk = walk.withColumn("order", F.transform(order, lambda s: s["i"])).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    rows = walk.select(key, "perm", "step", F.get("order", F.col("step") - 1).alias("moved"), *[
        F.when(F.array_position("order", i) <= F.col("step"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for i, c in enumerate(cols)])
    scored = score(rows).select(key, "perm", "step", "moved", "p")
    w = W.partitionBy(key, "perm").orderBy("step")
    delta = scored.withColumn("d", F.col("p") - F.lag("p").over(w))
    per = delta.groupBy(key, "moved").agg(F.avg(F.coalesce("d", F.col("p"))).alias("v"))
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("moved"))
    base = F.max(F.when(F.col("moved").isNull(), F.col("v"))).over(W.partitionBy(key))
    return per.select(key, "moved", name.alias("feature"), F.col("v").alias("contribution"), base.alias("base_value")).where("moved is not null").drop("moved")


def tree_nodes(spark: SparkSession, model: Transformer) -> list[list[Node]]:
    """Nodes of a forest's or boosted model's trees, values scaled so that the trees add up to the score.

    The score of a forest is the probability, that of boosted trees the log-odds. A saved
    model is a table of nodes, which is read in one job; the driver holds the model anyway.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, RandomForestClassificationModel):
        if last.numClasses != 2:
            raise ValueError(f"tree contributions need two classes, not {last.numClasses}")
        value = F.get("n.impurityStats", F.lit(1)) / F.aggregate("n.impurityStats", F.lit(0.0), lambda a, b: a + b) / last.getNumTrees
        weights = [1.0] * last.getNumTrees
    elif isinstance(last, GBTClassificationModel):
        value, weights = 2 * F.col("n.prediction"), [float(w) for w in last.treeWeights]  # p = 1 / (1 + exp(-2 * margin))
    else:
        raise TypeError(f"no tree contributions for {type(last).__name__}")
    path = scratch_path(spark, "trees")
    last.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", F.col("nodeData").alias("n")).select(
        "treeID", "n.id", "n.split.featureIndex", F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        "n.leftChild", "n.rightChild", "n.rawCount", value.alias("value"), "n.split.numCategories").collect()
    trees: list[list[Node]] = [[] for _ in weights]
    for tree, i, feature, threshold, left, right, count, v, categories in rows:
        if feature >= 0 and categories >= 0:
            raise ValueError("tree contributions need numeric splits; encode categories as columns first")
        trees[tree].append(Node(i, feature, threshold, left, right, count, v * weights[tree]))
    return trees


def _tree_values(df: DataFrame, cols: Sequence[str], values: Callable, groups: list) -> Column:
    """Flat array of ``values`` per row; nulls count as 0, as in scoring."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"the model needs the columns {', '.join(absent)}")

    @F.pandas_udf("array<double>")
    def run(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in xs])
        return pd.Series(list(values(x, groups).reshape(len(x), -1)))

    return run(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])


def tree_shap(df: DataFrame, key: str, cols: Sequence[str], trees: Sequence[Sequence[Node]]) -> DataFrame:
    """Exact path-dependent Shapley values as (key, feature, contribution, base_value).

    A narrow projection: nothing is shuffled, and the work is a lookup per row and leaf. The contributions
    of a row and the base value add up to its score.
    """
    groups, base = ensemble_paths(trees)
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("_at"))
    found = df.select(key, _tree_values(df, cols, shapley_values, groups).alias("_values"))
    return found.select(key, F.posexplode("_values").alias("_at", "contribution")).select(
        key, name.alias("feature"), "contribution", F.lit(base).alias("base_value"))


def tree_interactions(df: DataFrame, key: str, cols: Sequence[str], trees: Sequence[Sequence[Node]]) -> DataFrame:
    """Shapley interaction values as (key, feature1, feature2, value), both orders of a pair and the main effects.

    The values of a row and a ``feature1`` add up to the Shapley value of that feature.
    """
    groups, _ = ensemble_paths(trees)
    d = len(cols)
    names = F.array(*[F.lit(c) for c in cols])
    found = df.select(key, _tree_values(df, cols, interaction_values, groups).alias("_values"))
    return found.select(key, F.posexplode("_values").alias("_at", "value")).select(
        key, F.get(names, F.floor(F.col("_at") / d).cast("int")).alias("feature1"), F.get(names, F.col("_at") % d).alias("feature2"), "value")


def interaction_strength(values: DataFrame, cols: Sequence[str], top: int | None = 10) -> DataFrame:
    """Mean absolute interaction value per pair of features, strongest first; all pairs for ``top=None``."""
    names = F.array(*[F.lit(c) for c in cols])
    pairs = values.where(F.array_position(names, F.col("feature1")) < F.array_position(names, F.col("feature2")))
    out = pairs.groupBy("feature1", "feature2").agg(F.avg(F.abs("value")).alias("interaction_strength"))
    return out if top is None else out.orderBy(F.desc("interaction_strength"), "feature1", "feature2").limit(top)


def lime(df: DataFrame, key: str, cols: Sequence[str], score: Score, samples: int = 5000, top: int = 10, alpha: float = 1.0,
         seed: int = 42) -> DataFrame:
    """Local linear surrogate per row: weighted ridge on standardized normal perturbations.

    The normal equations of a row are sums, so the perturbed rows are combined
    map-side and only one small matrix per row is shuffled and solved.
    """
    d = len(cols)
    stats = df.agg(*[a for i, c in enumerate(cols) for a in (F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]).first()
    mean = [stats[f"m{i}"] for i in range(d)]
    std = [stats[f"s{i}"] or 1.0 for i in range(d)]
    base = df.select(key, *[((F.col(c).cast("double") - mean[i]) / std[i]).alias(f"x{i}") for i, c in enumerate(cols)])
    draws = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    z = {f"z{j}": F.when(F.col("i") == 0, F.col(f"x{j}")).otherwise(gaussian(F.lit(seed), F.col(key), F.col("i"), F.lit(j))) for j in range(d)}
    draws = draws.withColumns(z)
    dist = sum((F.pow(F.col(f"z{j}") - F.col(f"x{j}"), F.lit(2.0)) for j in range(d)), F.lit(0.0))
    width2 = (0.75 * math.sqrt(d)) ** 2
    rows = draws.select(key, F.exp(-dist / (2 * width2)).alias("w"), *[f"z{j}" for j in range(d)],
                        *[(F.col(f"z{j}") * std[j] + mean[j]).alias(c) for j, c in enumerate(cols)])
    s = score(rows)
    w, p = F.col("w"), F.col("p")
    zs = [F.col(f"z{j}") for j in range(d)]
    tri = [(a, b) for a in range(d) for b in range(a, d)]
    sums = s.groupBy(key).agg(
        F.sum(w).alias("sw"), F.sum(w * p).alias("sp"), F.array(*[F.sum(w * x) for x in zs]).alias("sz"),
        F.array(*[F.sum(w * x * p) for x in zs]).alias("szp"), F.array(*[F.sum(w * zs[a] * zs[b]) for a, b in tri]).alias("szz"))
    names = list(cols)
    schema = T.StructType([sums.schema[key], T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType()),
                           T.StructField("intercept", T.DoubleType())])

    def solve(batches):
        at = np.array(tri).T
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            sw = pdf["sw"].to_numpy()[:, None]
            sz, szp = np.stack(pdf["sz"]), np.stack(pdf["szp"])
            m = np.zeros((n, d, d))
            m[:, at[0], at[1]] = np.stack(pdf["szz"])
            m[:, at[1], at[0]] = np.stack(pdf["szz"])
            sp = pdf["sp"].to_numpy()[:, None]
            a = m - sz[:, :, None] * sz[:, None, :] / sw[:, :, None] + alpha * np.eye(d)
            coef = np.linalg.solve(a, (szp - sz * sp / sw)[:, :, None])[:, :, 0]
            inter = (sp[:, 0] - (sz * coef).sum(axis=1)) / sw[:, 0]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d), "feature": np.tile(names, n), "weight": coef.ravel(),
                                "intercept": np.repeat(inter, d)})

    return top_k_per_group(sums.mapInPandas(solve, schema), [key], "weight", top, absolute=True, tie=["feature"])


def global_importance(contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature and its share."""
    g = contributions.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean_contribution"))
    return g.withColumn("share", F.try_divide(F.col("importance"), F.sum("importance").over(W.partitionBy(*(by or [F.lit(1)])))))


def cohort_importance(contributions: DataFrame, cohort: str) -> DataFrame:
    """Importance within each cohort value; join the cohort column to the contributions first."""
    return global_importance(contributions, [cohort])


def permutation_importance(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str, score: Score, repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean loss of AUC when one feature's values are permuted.

    A permutation is a join of two repeatable rank orders of the rows. The rank
    is unique, so the join has no hot key.
    """
    xs = df.select(*keys, label, *[F.col(c).cast("double").alias(c) for c in cols])
    base = roc_auc(score(xs), label, "p").first()["roc_auc"]
    left = hash_rank(xs, keys, seed=seed, rank="_pos")
    parts = []
    for r in range(repeats):
        right = hash_rank(xs, keys, seed=seed + 1000 + r, rank="_pos").select("_pos", *[F.col(c).alias(f"o_{c}") for c in cols])
        parts.append(left.join(right, "_pos").withColumn("rep", F.lit(r)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    mixed = both.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1)))).select(
        "rep", "j", label, *[F.when(F.col("j") == j, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for j, c in enumerate(cols)])
    aucs = roc_auc(score(mixed), label, "p", ["rep", "j"])
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("j"))
    return aucs.groupBy(name.alias("feature")).agg(F.avg(F.lit(base) - F.col("roc_auc")).alias("importance"),
                                                   F.stddev_pop(F.lit(base) - F.col("roc_auc")).alias("std"))


def category_contribution(contributions: DataFrame, key: str) -> DataFrame:
    """Total contribution per row and feature group; ``primary`` marks the largest in absolute value."""
    g = contributions.groupBy(key, feature_category("feature").alias("category")).agg(F.sum("contribution").alias("total"))
    return g.withColumn("primary", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs(F.col("total"))), "category")) == 1)


def risk_drivers(contributions: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k features that raise a row's risk most."""
    return top_k_per_group(contributions.where("contribution > 0"), [key], "contribution", k, tie=["feature"]).withColumn("impact", F.lit("Increases Risk"))


def explanation_summary(contributions: DataFrame, key: str, probability: DataFrame) -> DataFrame:
    """One sentence per row: level, primary driver group and strongest factor. ``probability`` holds (key, p)."""
    from creditspark.functions.expr import risk_band

    cat = category_contribution(contributions, key).where("primary").select(key, "category")
    top = risk_drivers(contributions, key, 1).select(key, F.col("feature").alias("factor"))
    return probability.join(cat, key, "left").join(top, key, "left").select(
        key, F.concat(F.concat_ws(". ", F.concat(F.lit("Risk Assessment: "), risk_band("p")),
                                  F.concat(F.lit("Primary risk driver: "), F.initcap(F.replace("category", F.lit("_"), F.lit(" "))), F.lit(" factors")),
                                  F.concat(F.lit("Most significant factor: "), F.col("factor"), F.lit(" (Increases Risk)"))), F.lit(".")).alias("summary"))


def stability(df: DataFrame, key: str, cols: Sequence[str], contribute: Callable[[DataFrame, str], DataFrame], draws: int = 100,
              noise: float = 0.1, seed: int = 42) -> DataFrame:
    """1 - mean(std / |mean|) of the contributions under normal noise on the features.

    ``contribute(df, key)`` returns (key, feature, contribution).
    """
    noisy = df.select(key, *cols).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    noisy = noisy.select(F.struct(key, "draw").alias("id"), *[
        (F.col(c).cast("double") + noise * gaussian(F.lit(seed), F.col(key), F.col("draw"), F.lit(j))).alias(c) for j, c in enumerate(cols)])
    c = contribute(noisy, "id")
    per = c.groupBy(F.col(f"id.{key}").alias(key), "feature").agg(F.avg("contribution").alias("m"), F.stddev_pop("contribution").alias("s"))
    return per.groupBy(key).agg((1 - F.avg(F.col("s") / (F.abs(F.col("m")) + 1e-8))).alias("stability_score"))


def interactions(df: DataFrame, key: str, cols: Sequence[str], score: Score, top: int = 10) -> DataFrame:
    """Mean absolute second difference of the score per feature pair against the column means.

    Only ``cols`` are varied; all other columns reach ``score`` as they are.
    """
    kept = [c for c in df.columns if c != key and c not in cols]
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    pairs = list(combinations(range(len(cols)), 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("mask")) for a, b in pairs for m in range(4)])
    rows = df.select(key, *kept, *[F.col(c).cast("double").alias(c) for c in cols], F.explode(cells).alias("_cell")).select(
        key, *kept, F.col("_cell.a").alias("_a"), F.col("_cell.b").alias("_b"), F.col("_cell.mask").alias("_mask"), *[
            F.when(((F.col("_cell.a") == i) & (F.col("_cell.mask").bitwiseAND(1) > 0)) | ((F.col("_cell.b") == i) & (F.col("_cell.mask").bitwiseAND(2) > 0)), F.lit(r[i]))
            .otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)])
    sign = F.when(F.col("_mask").isin(0, 3), F.col("p")).otherwise(-F.col("p"))
    per = score(rows).groupBy(key, "_a", "_b").agg(F.sum(sign).alias("v"))
    names = F.array(*[F.lit(c) for c in cols])
    return per.groupBy(F.get(names, F.col("_a")).alias("feature1"), F.get(names, F.col("_b")).alias("feature2")).agg(
        F.avg(F.abs("v")).alias("interaction_strength")).orderBy(F.desc("interaction_strength"), "feature1", "feature2").limit(top)


def counterfactual(df: DataFrame, key: str, cols: Sequence[str], prediction: str, wanted: int = 1) -> DataFrame:
    """Nearest row with another prediction for every row predicted ``wanted``.

    Euclidean distance on std-scaled features, exact.
    """
    df = materialize(df.select(key, prediction, *cols), "scored")
    st = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    xs = df.select(F.col(key).cast("long").alias("id"), F.col(prediction).cast("int").alias("y"),
                   F.array(*[F.col(c).cast("double") / (st[i] or 1.0) for i, c in enumerate(cols)]).alias("x"))
    near = nearest(xs.where(F.col("y") == wanted), xs.where(F.col("y") != wanted))
    return near.select(F.col("query").alias(key), "neighbor", F.sqrt("d2").alias("distance"))
