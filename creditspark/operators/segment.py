"""Customer segmentation: clustering, choice of k, profiles, projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.functions.ordering import quantiles
from creditspark.operators.clean import impute
from creditspark.operators.encode import apply_scaler, fit_scaler
from creditspark.session import ensure_checkpoint_dir

VEC = "features"


def prepare(df: DataFrame, cols: Sequence[str], missing: str = "median", scaling: str = "standard", prefix: str = "z_") -> DataFrame:
    """Scaled copies of the features and their vector, after filling gaps by the chosen method."""
    filled = impute(df, missing, cols)
    z = [f"{prefix}{c}" for c in cols]
    copies = filled.withColumns({a: F.col(c).cast("double") for a, c in zip(z, cols)})
    scaled = apply_scaler(copies, fit_scaler(copies, z, scaling))
    return VectorAssembler(inputCols=z, outputCol=VEC).transform(scaled)


def kmeans(df: DataFrame, k: int = 5, restarts: int = 10, seed: int = 42):
    """Best of several seeded runs by training cost."""
    data = df.select(VEC).persist()
    try:
        fits = [KMeans(k=k, seed=seed + i, featuresCol=VEC, predictionCol="cluster").fit(data) for i in range(restarts)]
        return min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def gaussian_mixture(df: DataFrame, k: int = 5, seed: int = 42):
    return GaussianMixture(k=k, seed=seed, featuresCol=VEC, predictionCol="cluster").fit(df)


def bisecting(df: DataFrame, k: int = 5, seed: int = 42):
    return BisectingKMeans(k=k, seed=seed, featuresCol=VEC, predictionCol="cluster").fit(df)


def ward_merge(centers: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Label per center after merging, at each step, the two groups with the least Ward increase."""
    groups = [[i] for i in range(len(centers))]
    c, n = [np.array(v, dtype=float) for v in centers], [float(s) for s in sizes]
    while len(groups) > k:
        a = np.stack(c)
        w = np.array(n)
        cost = ((a[:, None, :] - a[None, :, :]) ** 2).sum(axis=2) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(divmod(int(cost.argmin()), len(groups)))
        c[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        groups[i] += groups[j]
        del c[j], n[j], groups[j]
    out = np.zeros(len(centers), dtype=int)
    for label, g in enumerate(sorted(groups, key=min)):
        out[g] = label
    return out


def hierarchical(df: DataFrame, k: int = 5, micro: int = 200, seed: int = 42) -> DataFrame:
    """Ward agglomeration of micro-clusters.

    Spark forms at most ``micro`` groups; only their centers and sizes come to
    the driver. A table with at most ``micro`` distinct points is merged exactly.
    """
    fit = KMeans(k=micro, seed=seed, featuresCol=VEC, predictionCol="micro", initSteps=5).fit(df)
    sized = fit.transform(df)
    n = {r["micro"]: r["count"] for r in sized.groupBy("micro").count().collect()}
    used = sorted(n)
    centers = np.stack([fit.clusterCenters()[i] for i in used])
    labels = ward_merge(centers, np.array([n[i] for i in used]), k)
    table = F.create_map(*[x for i, lab in zip(used, labels) for x in (F.lit(i), F.lit(int(lab)))])
    return sized.withColumn("cluster", F.element_at(table, F.col("micro"))).drop("micro")


def cluster_sums(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Size and mean per cluster and the spread around it."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                                   sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0])).alias("v"))


def cluster_indices(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin from cluster sums and one distance pass.

    One row per cluster reaches the driver.
    """
    rows = cluster_sums(df, cols, cluster).collect()
    n = np.array([r["n"] for r in rows], dtype=float)
    m = np.array([[r[f"m_{c}"] for c in cols] for r in rows])
    within = float((n * np.array([r["v"] for r in rows])).sum())
    center = (n[:, None] * m).sum(axis=0) / n.sum()
    between = float((n * ((m - center) ** 2).sum(axis=1)).sum())
    k = len(rows)
    ch = between / (k - 1) / (within / (n.sum() - k)) if k > 1 and within > 0 else float("nan")
    mean_of = {r[cluster]: [r[f"m_{c}"] for c in cols] for r in rows}
    d = F.lit(0.0)
    for j, c in enumerate(cols):
        at = F.lit(None).cast("double")
        for lab, mv in mean_of.items():
            at = F.when(F.col(cluster) == lab, F.lit(mv[j])).otherwise(at)
        d = d + F.pow(F.col(c) - at, F.lit(2.0))
    spread = {r[cluster]: r["s"] for r in df.groupBy(cluster).agg(F.avg(F.sqrt(d)).alias("s")).collect()}
    s = np.array([spread[r[cluster]] for r in rows])
    gap = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        db = float(((s[:, None] + s[None, :]) / gap).max(axis=1).mean())
    return {"calinski_harabasz": ch, "davies_bouldin": db}


def choose_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11), restarts: int = 10, seed: int = 42) -> DataFrame:
    """Inertia, silhouette, Calinski-Harabasz and Davies-Bouldin per k; ``cols`` are the scaled columns."""
    data = df.persist()
    try:
        rows = []
        for k in ks:
            model = kmeans(data, k, restarts, seed)
            got = model.transform(data)
            sil = ClusteringEvaluator(predictionCol="cluster", featuresCol=VEC).evaluate(got)
            idx = cluster_indices(got, cols)
            rows.append((int(k), float(model.summary.trainingCost), float(sil), float(idx["calinski_harabasz"]), float(idx["davies_bouldin"])))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")


def best_k(metrics: DataFrame) -> DataFrame:
    """k by the best value of each index."""
    return metrics.agg(F.max_by("k", "silhouette").alias("by_silhouette"), F.max_by("k", "calinski_harabasz").alias("by_calinski_harabasz"),
                       F.min_by("k", "davies_bouldin").alias("by_davies_bouldin"))


def cluster_profiles(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Size, share and per-feature statistics per cluster; noise (-1) counts in the total only."""
    total = df.agg(F.count("*").alias("t")).first()["t"]
    rows = df.where(F.col(cluster) != -1)
    aggs = [F.count("*").alias("size")]
    cells = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        cells.append(F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")))
    flat = rows.groupBy(cluster).agg(*aggs).select(cluster, "size", (F.col("size") * 100.0 / F.lit(total)).alias("percentage"), F.explode(F.array(*cells)).alias("c"))
    med = quantiles(rows, cols, [0.5], [cluster]).select(cluster, "feature", F.col("value").alias("median"))
    return flat.select(cluster, "size", "percentage", "c.*").join(med, [cluster, "feature"])


# Insight texts by the mean of a feature, highest bound first.
INSIGHTS = {
    "credit_score": [(750, "Excellent credit profile - Premium customers"), (650, "Good credit profile - Standard customers"),
                     (None, "Poor credit profile - High-risk customers")],
    "income": [(100000, "High-income segment"), (50000, "Middle-income segment"), (None, "Low-income segment")],
    "age": [(55, "Senior customers - Stable income"), (35, "Mid-career professionals"), (None, "Young professionals - Growth potential")],
}


def cluster_insights(profiles: DataFrame, cluster: str = "cluster", names: dict[str, str] | None = None) -> DataFrame:
    """Texts per cluster from the means; ``names`` maps a rule to the feature that plays it."""
    names = names or {k: k for k in INSIGHTS}
    mean = {k: F.max(F.when(F.col("feature") == f, F.col("mean"))) for k, f in names.items()}
    wide = profiles.groupBy(cluster).agg(*[m.alias(k) for k, m in mean.items()])
    parts = []
    for rule in names:
        c: Column | None = None
        for bound, text in INSIGHTS[rule]:
            hit = F.col(rule).isNotNull() if bound is None else F.col(rule) >= bound
            c = F.when(hit, text) if c is None else c.when(hit, text)
        parts.append(c)
    return wide.select(cluster, F.array_compact(F.array(*parts)).alias("insights"))


def pca_2d(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """(keys, pc1, pc2) on centered columns with the share of variance explained.

    The sign is fixed: the largest loading of a component is positive.
    """
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centered = df.select(*keys, *[(F.col(c).cast("double") - F.lit(r[i])).alias(f"c{i}") for i, c in enumerate(cols)])
    vec = VectorAssembler(inputCols=[f"c{i}" for i in range(len(cols))], outputCol="v")
    fit = PCA(k=2, inputCol="v", outputCol="o").fit(vec.transform(centered))
    load = fit.pc.toArray()
    sign = np.where(np.abs(load).max(axis=0) == load.max(axis=0), 1.0, -1.0)
    load = load * sign
    pcs = [sum((F.col(f"c{i}") * float(load[i, j]) for i in range(len(cols))), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(2)]
    return centered.select(*keys, *pcs), [float(v) for v in fit.explainedVariance.toArray()]


# --- density clustering ---------------------------------------------------------

def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Exact DBSCAN labels as (key, cluster); noise is -1, a border row joins its smallest cluster.

    Rows with the same position are one weighted point, and points live in grid
    cells of diagonal ``eps``: all points of a cell are neighbors, so a cell with
    ``min_samples`` rows is dense without comparing anything and a hot cell costs
    nothing. Sparse cells hold fewer than ``min_samples`` rows each. Two core
    cells are linked when any two of their core points are close; this is decided
    on sub-cells first and on points only for sub-cells that leave it open.
    """
    d = len(cols)
    side = eps / math.sqrt(d)
    xs = [f"x{i}" for i in range(d)]
    cs = [f"c{i}" for i in range(d)]
    located = df.select(F.col(key), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)])
    points = located.groupBy(*xs).agg(F.count("*").alias("w")).withColumns({c: F.floor(F.col(x) / side) for c, x in zip(cs, xs)})
    ensure_checkpoint_dir(df.sparkSession)
    weights = points.groupBy(*cs).agg(F.sum("w").alias("cell_w"))
    points = points.join(weights, cs).checkpoint()
    near = _offsets(d)
    close = eps * eps

    def dist2(a: str, b: str) -> Column:
        return sum((F.pow(F.col(f"{a}.{x}") - F.col(f"{b}.{x}"), F.lit(2.0)) for x in xs), F.lit(0.0))

    def neighbors_of(left: DataFrame, right: DataFrame) -> DataFrame:
        """left points with the right points of the cells around them, within eps."""
        moved = left.withColumn("_o", F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in near])))
        for i, c in enumerate(cs):
            moved = moved.withColumn(f"n{i}", F.col(c) + F.col("_o")[i])
        cond = [F.col(f"a.n{i}") == F.col(f"b.{c}") for i, c in enumerate(cs)]
        return moved.alias("a").join(right.alias("b"), cond).where(dist2("a", "b") <= close)

    dense = points.where(F.col("cell_w") >= min_samples)
    sparse = points.where(F.col("cell_w") < min_samples)
    reach = neighbors_of(sparse, points).groupBy(*[F.col(f"a.{x}").alias(x) for x in xs]).agg(F.sum("b.w").alias("near_w"))
    core_sparse = sparse.join(reach.where(F.col("near_w") >= min_samples).select(*xs), xs, "left_semi")
    core = dense.select(*xs, *cs).unionByName(core_sparse.select(*xs, *cs)).checkpoint()

    cells = core.select(*cs).distinct().withColumn("cell", F.xxhash64(*cs))
    links = _cell_links(core, cells, xs, cs, near, side, eps)
    labels = _components(cells.select("cell"), links)
    core_labelled = core.withColumn("cell", F.xxhash64(*cs)).join(labels, "cell").select(*xs, *cs, "label")
    rest = points.join(core.select(*xs), xs, "left_anti")
    border = neighbors_of(rest, core_labelled).groupBy(*[F.col(f"a.{x}").alias(x) for x in xs]).agg(F.min("b.label").alias("label"))
    found = core_labelled.select(*xs, "label").unionByName(border)
    # clusters are numbered by their label, which does not depend on partitioning
    numbers = found.select("label").distinct().withColumn("cluster", (F.row_number().over(W.orderBy("label")) - 1).cast("int"))
    flat = found.join(numbers, "label").select(*xs, "cluster")
    return located.join(flat, xs, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cell offsets that can hold a point within the cell diagonal."""
    r = math.ceil(math.sqrt(d))
    out = [()]
    for _ in range(d):
        out = [o + (v,) for o in out for v in range(-r, r + 1)]
    return [o for o in out if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d]


def _cell_links(core: DataFrame, cells: DataFrame, xs, cs, near, side: float, eps: float, parts: int = 8) -> DataFrame:
    """Pairs of neighboring core cells with two core points within eps."""
    d = len(xs)
    sub = side / parts
    ss = [f"s{i}" for i in range(d)]
    small = core.withColumns({s: F.floor(F.col(x) / sub) for s, x in zip(ss, xs)})
    boxes = small.groupBy(*cs, *ss).agg(*[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs]).withColumn("cell", F.xxhash64(*cs))
    half = [o for o in near if o > (0,) * d]  # each unordered pair of cells once
    moved = boxes.withColumn("_o", F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in half])))
    for i, c in enumerate(cs):
        moved = moved.withColumn(f"n{i}", F.col(c) + F.col("_o")[i])
    cond = [F.col(f"a.n{i}") == F.col(f"b.{c}") for i, c in enumerate(cs)]
    far = sum((F.pow(F.greatest(F.col(f"a.hi_{x}") - F.col(f"b.lo_{x}"), F.col(f"b.hi_{x}") - F.col(f"a.lo_{x}")), F.lit(2.0)) for x in xs), F.lit(0.0))
    gap = sum((F.pow(F.greatest(F.col(f"a.lo_{x}") - F.col(f"b.hi_{x}"), F.col(f"b.lo_{x}") - F.col(f"a.hi_{x}"), F.lit(0.0)), F.lit(2.0)) for x in xs), F.lit(0.0))
    met = moved.alias("a").join(boxes.alias("b"), cond).where(gap <= eps * eps).select(
        F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), (far <= eps * eps).alias("sure"),
        F.struct(*[F.col(f"a.{s}") for s in cs + ss]).alias("sa"), F.struct(*[F.col(f"b.{s}") for s in cs + ss]).alias("sb"))
    sure = met.where("sure").select("a", "b").distinct()
    open_pairs = met.where(~F.col("sure")).join(sure, ["a", "b"], "left_anti")
    pts = small.select(F.struct(*cs, *ss).alias("s"), *xs)
    pa = pts.select(F.col("s").alias("sa"), *[F.col(x).alias(f"a_{x}") for x in xs])
    pb = pts.select(F.col("s").alias("sb"), *[F.col(x).alias(f"b_{x}") for x in xs])
    d2 = sum((F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), F.lit(2.0)) for x in xs), F.lit(0.0))
    tested = open_pairs.join(pa, "sa").join(pb, "sb").where(d2 <= eps * eps).select("a", "b").distinct()
    return sure.unionByName(tested)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable node per node, by label spreading with pointer jumping and checkpoints."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).checkpoint()
    labels = nodes.select("cell", F.col("cell").alias("label")).checkpoint()
    while True:
        spread = edges.join(labels, F.col("v") == F.col("cell")).groupBy(F.col("u").alias("cell")).agg(F.min("label").alias("m"))
        step = labels.join(spread, "cell", "left").select("cell", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        roots = labels.select(F.col("cell").alias("new"), F.col("label").alias("root"))
        jumped = step.join(roots, "new").select("cell", "label", F.least("new", "root").alias("new")).checkpoint()
        changed = jumped.where(F.col("new") != F.col("label")).limit(1).count()
        labels = jumped.select("cell", F.col("new").alias("label"))
        if not changed:
            return labels

