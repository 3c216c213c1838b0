"""Kendall's tau-b without comparing all row pairs.

Rows collapse to weighted distinct (x, y) pairs. Both columns are cut into
ordered buckets. Two pairs in different x and different y buckets compare like
their buckets, which counts per bucket cell settle. Pairs that share a bucket
are compared inside it by a merge count, and a bucket is bounded in size: every
edge value has a bucket of its own, and pairs with an equal coordinate add 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.functions.ordering import TASK_ROWS, value_splits


def merge_score(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j * sign(x_i - x_j) * sign(y_i - y_j) over unordered pairs of distinct points."""
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(float)
    rank = np.unique(y[order], return_inverse=True)[1]
    n, width = len(x), int(rank.max()) + 2 if len(x) else 1
    at = np.arange(n)
    score, half = 0.0, 1
    while half < n:
        block = at // (2 * half)
        left = (at // half) % 2 == 0
        key = block * width + rank
        lo = np.sort(key[left])
        cum = np.concatenate([[0.0], np.cumsum(w[left][np.argsort(key[left], kind="stable")])])
        r = ~left
        start, end = cum[np.searchsorted(lo, block[r] * width)], cum[np.searchsorted(lo, (block[r] + 1) * width)]
        less = cum[np.searchsorted(lo, key[r], "left")] - start
        more = end - cum[np.searchsorted(lo, key[r], "right")]
        score += float((w[r] * (less - more)).sum())
        half *= 2
    # equal x sorted by y was counted as agreeing
    g = pd.DataFrame({"x": x, "w": w, "q": w * w}).groupby("x").sum()
    return score - float(((g["w"] ** 2 - g["q"]) / 2).sum())


def _singled(edges: list[float]) -> list[float]:
    """Edges that give every edge value a bucket of its own."""
    return [float("-inf"), *sorted({e for v in edges for e in (v, math.nextafter(v, math.inf))}), float("inf")]


def _grouped_score(pairs: DataFrame, *by: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["x"].nunique() < 2 or pdf["y"].nunique() < 2:
            return pd.DataFrame({"s": [0.0]})
        return pd.DataFrame({"s": [merge_score(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})

    return pairs.groupBy(*by).applyInPandas(one, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))


def _spread(pairs: DataFrame, by: str, value: str) -> DataFrame:
    """Drop buckets with one value of their own column: they add 0, and only they can be hot."""
    live = pairs.groupBy(by).agg((F.min(value) < F.max(value)).alias("ok")).where("ok").select(by)
    return pairs.join(live, by, "left_semi")


def cell_score(cells: list[tuple[int, int, float]]) -> float:
    """Score of all pairs whose x and y buckets both differ, from counts per cell."""
    nx, ny = 1 + max(c[0] for c in cells), 1 + max(c[1] for c in cells)
    g = np.zeros((nx, ny))
    for i, j, w in cells:
        g[i, j] += w
    before = np.vstack([np.zeros((1, ny)), np.cumsum(g, axis=0)[:-1]])  # smaller x buckets
    low = np.hstack([np.zeros((nx, 1)), np.cumsum(before, axis=1)[:, :-1]])
    high = before.sum(axis=1, keepdims=True) - np.cumsum(before, axis=1)
    return float((g * (low - high)).sum())


def kendall_tau(df: DataFrame, a: str, b: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """tau-b of two columns over the rows where both are present, as (a, b, r)."""
    both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    pairs = both.groupBy("x", "y").agg(F.count("*").alias("w"))
    ex, ey = value_splits(pairs, "x", task_rows), value_splits(pairs, "y", task_rows)
    if not ex and not ey:
        score = _grouped_score(pairs.withColumn("bx", F.lit(0)), "bx").first()["s"] if pairs.limit(1).count() else 0.0
    else:
        cut = pairs
        for c, edges in (("x", ex), ("y", ey)):
            cut = Bucketizer(splits=_singled(edges), inputCol=c, outputCol=f"b{c}").transform(cut)
        cells = [(int(r["bx"]), int(r["by"]), float(r["w"])) for r in cut.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect()]
        by_x, by_y = _spread(cut, "bx", "x"), _spread(cut, "by", "y")
        same_x = _grouped_score(by_x, "bx").first()["s"]
        same_y = _grouped_score(by_y, "by").first()["s"]
        same_cell = _grouped_score(_spread(by_x, "by", "y"), "bx", "by").first()["s"]
        score = cell_score(cells) + same_x + same_y - same_cell
    half = F.col("n") * (F.col("n") - 1) / 2

    def ties(c):
        return both.groupBy(c).agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(half), F.lit(0.0)).alias("t")).first()["t"]

    n = both.count()
    n0, n1, n2 = n * (n - 1) / 2, ties("x"), ties("y")
    bottom = math.sqrt((n0 - n1) * (n0 - n2))
    return df.sparkSession.createDataFrame([(a, b, float(score) / bottom if bottom > 0 else None)], "a string, b string, r double")
