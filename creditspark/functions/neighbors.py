"""Exact k nearest rows between two tables.

The candidates are cut into blocks of bounded size along cuts that a bounded sample
places; the boxes around the blocks are those of all their rows, so the sample decides
only about speed. Each query is answered in its nearest block first. The distance to its
k-th neighbor there leaves out all blocks whose box is farther; the query visits the
others. Inside a block the same tree of boxes leads to the near rows. Of candidates with
equal coordinates the k with the smallest ids are enough, so copies fill no block, and
the queries of a block are dealt over as many groups as their number asks for.

The driver holds the sample and the boxes, no other rows. A box is as far as its nearest
point can be with the coordinates that may be missing left out, so missing numbers never
hide a neighbor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.sources.io import materialize

QUERY_BLOCK = 16384  # queries that meet a block in one group, about
CANDIDATE_BLOCK = 16384  # candidates of a block, about
SAMPLE = 65536  # candidates that place the cuts
LEAF = 256  # candidates compared without looking at boxes
CELLS = 1 << 17  # distances at a time


class Boxes:
    """Binary tree over rows with a box around the rows of every node; a missing number is NaN."""

    def __init__(self, x: np.ndarray, leaf: int, dims: np.ndarray):
        self.d = x.shape[1]
        self.dim, self.cut, self.child, self.leaf = [], [], [], []
        self.rows: list[np.ndarray] = []  # of each leaf
        self._grow(x, np.arange(len(x)), leaf, dims)
        self.low, self.high = np.full((len(self.dim), self.d), np.inf), np.full((len(self.dim), self.d), -np.inf)
        self.sure = np.ones((len(self.dim), self.d), bool)  # no row of the node misses the number

    def _grow(self, x: np.ndarray, root: np.ndarray, leaf: int, dims: np.ndarray) -> None:
        todo = [(root, -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.dim)
            if parent >= 0:
                self.child[parent][side] = at
            found = self._split(x[rows], dims) if len(rows) > leaf else None
            self.dim.append(found[0] if found else -1)
            self.cut.append(found[1] if found else 0.0)
            self.child.append([-1, -1])
            self.leaf.append(-1 if found else len(self.rows))
            if found:
                left = self._left(x[rows, found[0]], found[1])
                todo += [(rows[~left], at, 1), (rows[left], at, 0)]
            else:
                self.rows.append(rows)

    @staticmethod
    def _left(v: np.ndarray, cut: float) -> np.ndarray:
        return np.isnan(v) if np.isnan(cut) else v <= cut

    @staticmethod
    def _split(x: np.ndarray, dims: np.ndarray) -> tuple[int, float] | None:
        """(column, cut): rows without the number apart from the others (cut NaN), then the widest column in the middle."""
        lost = np.isnan(x).mean(axis=0)
        mixed = dims[(lost[dims] > 0) & (lost[dims] < 1)]
        if len(mixed):
            return int(mixed[np.argmin(np.abs(lost[mixed] - 0.5))]), np.nan
        full = dims[lost[dims] == 0]
        if not len(full):
            return None
        wide = [np.std(x[:, j]) if x[:, j].min() < x[:, j].max() else -1.0 for j in full]
        if max(wide) < 0:
            return None
        j = int(full[int(np.argmax(wide))])
        v = x[:, j]
        cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        return j, float(cut if cut < v.max() else v[v < cut].max())

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row by the cuts."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            left = self._left(x[rows, self.dim[node]], self.cut[node])
            todo += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out

    def fit(self, low: np.ndarray, high: np.ndarray, sure: np.ndarray) -> Boxes:
        """Set the boxes from those of the leaves."""
        for node in range(len(self.dim) - 1, -1, -1):  # children come after their parent
            if self.leaf[node] >= 0:
                self.low[node], self.high[node], self.sure[node] = low[self.leaf[node]], high[self.leaf[node]], sure[self.leaf[node]]
            else:
                a, b = self.child[node]
                self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
                self.sure[node] = self.sure[a] & self.sure[b]
        return self

    def fit_rows(self, x: np.ndarray) -> Boxes:
        parts = [x[rows] for rows in self.rows]
        gaps = [np.isnan(p) for p in parts]
        return self.fit(np.array([np.where(g, np.inf, p).min(axis=0, initial=np.inf) for p, g in zip(parts, gaps)]),
                        np.array([np.where(g, -np.inf, p).max(axis=0, initial=-np.inf) for p, g in zip(parts, gaps)]),
                        np.array([~g.any(axis=0) for g in gaps]))

    def least(self, q: np.ndarray, node: int) -> np.ndarray:
        """No row of the node is nearer; summed as the distances are, so that rounding cannot turn it around."""
        there = ~np.isnan(q) & (self.low[node] <= self.high[node])
        gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
        gap = np.where(there & self.sure[node], gap, 0.0) ** 2
        used, total = there.sum(axis=1), np.zeros(len(q))
        for j in range(self.d):
            total += gap[:, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(used > 0, total * (self.d / used), np.inf)

    def home(self, q: np.ndarray) -> np.ndarray:
        """A near leaf of every query."""
        out = np.zeros(len(q), np.int32)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            a, b = self.child[node]
            left = self.least(q[rows], a) <= self.least(q[rows], b)
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def visits(self, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that it may hold a neighbor for); ``bound`` may fall meanwhile."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            least = self.least(q[rows], node)
            rows = rows[(least <= bound[rows]) & (least < np.inf)]
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
            else:
                todo += [(self.child[node][1], rows), (self.child[node][0], rows)]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Missing coordinates are skipped, the sum is scaled up by the share of coordinates used; infinite without a common one."""
    out, used = np.zeros((len(a), len(b))), 0.0
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    for j in range(a.shape[1]):
        if not has_a[:, j].any() or not has_b[:, j].any():
            continue
        part = (a[:, j, None] - b[None, :, j]) ** 2
        if has_a[:, j].all() and has_b[:, j].all():
            used = used + 1.0
        else:
            ok = has_a[:, j, None] & has_b[None, :, j]
            part = np.where(ok, part, 0.0)
            used = used + ok
        out += part
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(used > 0, out * (a.shape[1] / np.asarray(used, float)), np.inf)


def search(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) ids and squared distances of the nearest rows not farther than ``bound``, by distance and id; infinite where there are fewer."""
    near, far = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
    if not len(q) or not len(x):
        return near, far
    bound = bound.copy()
    tree = Boxes(x, LEAF, np.flatnonzero((~np.isnan(q)).mean(axis=0) >= 0.5)).fit_rows(x)

    def compare(rows: np.ndarray, some: np.ndarray) -> None:
        step = max(1, CELLS // len(some))
        for s in range(0, len(rows), step):
            at = rows[s:s + step]
            d2 = squared_distances(q[at], x[some])
            top = bound[at]
            if len(some) > k and np.isinf(top).any():
                top = np.minimum(top, np.partition(d2, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((d2 <= top[:, None]) & (d2 < np.inf))
            if not len(i):
                continue
            hit = np.unique(i)
            who = np.concatenate([at[i], np.repeat(at[hit], k)])
            dist = np.concatenate([d2[i, j], far[at[hit]].ravel()])
            name = np.concatenate([ids[some[j]], near[at[hit]].ravel()])
            order = np.lexsort((name, dist, who))
            who, dist, name = who[order], dist[order], name[order]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            keep = rank < k
            far[who[keep], rank[keep]], near[who[keep], rank[keep]] = dist[keep], name[keep]
            bound[at[hit]] = np.minimum(bound[at[hit]], far[at[hit], k - 1])

    home = np.where(np.isinf(bound), tree.home(q), -1)
    order = np.argsort(home, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(rows) and home[rows[0]] >= 0 and len(tree.rows[home[rows[0]]]):
            compare(rows, tree.rows[home[rows[0]]])
    for leaf, rows in tree.visits(q, bound):
        rows = rows[home[rows] != leaf]
        if len(rows) and len(tree.rows[leaf]):
            compare(rows, tree.rows[leaf])
    return near, far


def _per_row(fn: Callable[..., np.ndarray], kind: str, d: int, *more: str) -> Column:
    """``fn(coordinates, more columns)`` as a column."""

    @F.pandas_udf(kind)
    def run(*s: pd.Series) -> pd.Series:
        out = fn(np.column_stack([v.to_numpy(float) for v in s[:d]]), *[v.to_numpy() for v in s[d:]])
        return pd.Series(out, dtype=object if isinstance(out, list) else None)

    return run(*[F.col(f"x{j}") for j in range(d)], *more)


def _groups_per_block(blocks: DataFrame, n: int) -> np.ndarray:
    """Groups that the queries of every block are dealt over."""
    out = np.ones(n, np.int64)
    for b, m in blocks.groupBy("block").count().collect():  # one row per block
        out[b] = max(1, -(-m // QUERY_BLOCK))
    return out


def _meet(q: DataFrame, c: DataFrame, groups: np.ndarray, k: int, d: int) -> DataFrame:
    """(id, x0.., home, near, far): queries with a column ``bound`` against the candidates of their ``block``."""
    many = F.pandas_udf(lambda b: pd.Series(groups[b.to_numpy()]), "long")
    xs = [f"x{j}" for j in range(d)]
    q = q.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), many("block")))
    c = c.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many("block") - 1)))
    schema = f"id long, {', '.join(f'{x} double' for x in xs)}, home int, near array<long>, far array<double>"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near, far = search(left[xs].to_numpy(float), left["bound"].to_numpy(float), right[xs].to_numpy(float), right["id"].to_numpy(np.int64), k)
        found = np.isfinite(far)
        lists = [pd.Series([v[f] for v, f in zip(a, found)], left.index, object) for a in (near, far)]
        return left[["id", *xs]].assign(home=left["block"].astype("int32"), near=lists[0], far=lists[1])

    return q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(run, schema)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 1) -> DataFrame:
    """(query, neighbor, d2, rank) from two tables of ``id long, x array<double>``.

    Missing coordinates are skipped and the squared distance is scaled up by the
    share of coordinates used; pairs without a common one are no neighbors. Equal
    distances go to the smaller id.
    """
    spark = queries.sparkSession
    one = queries.select(F.size("x").alias("d")).first()
    if one is None:
        return spark.createDataFrame([], "query long, neighbor long, d2 double, rank int")
    d = one["d"]
    cols = ["id", *[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(d)]]
    q = materialize(queries.select(*cols), "queries")
    same = W.partitionBy("x").orderBy("id")
    c = materialize(candidates.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).select(*cols), "candidates")
    n = c.count()
    part = c if n <= SAMPLE else c.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    sample = part.drop("id").toPandas().to_numpy(float)
    share = q.agg(*[F.avg(F.when(F.col(f"x{j}").isNull() | F.isnan(f"x{j}"), 0.0).otherwise(1.0)) for j in range(d)]).first()
    tree = Boxes(sample, max(1, len(sample) * CANDIDATE_BLOCK // max(n, 1)), np.flatnonzero(np.array(share) >= 0.5))
    blocks = len(tree.rows)
    c = c.withColumn("block", _per_row(tree.place, "int", d))
    low, high, sure = np.full((blocks, d), np.inf), np.full((blocks, d), -np.inf), np.ones((blocks, d), bool)
    known = [F.nanvl(f"x{j}", F.lit(None).cast("double")) for j in range(d)]
    for r in c.groupBy("block").agg(*[F.min(v) for v in known], *[F.max(v) for v in known], *[F.count(v) == F.count("*") for v in known]).collect():  # one row per block
        some = np.array([v is not None for v in r[1:1 + d]])
        low[r[0], some], high[r[0], some] = [v for v in r[1:1 + d] if v is not None], [v for v in r[1 + d:1 + 2 * d] if v is not None]
        sure[r[0]] = r[1 + 2 * d:]
    tree.fit(low, high, sure)

    def others(x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in x]
        for leaf, rows in tree.visits(x, bound):
            for i in rows[home[rows] != leaf]:
                out[i].append(leaf)
        return out

    q = q.withColumns({"block": _per_row(tree.home, "int", d), "bound": F.lit(float("inf"))})
    first = materialize(_meet(q, c, _groups_per_block(q, blocks), k, d), "near")
    found = first.select("id", "near", "far")
    if blocks > 1:
        bound = F.when(F.size("far") == k, F.element_at("far", -1)).otherwise(F.lit(float("inf")))
        again = first.withColumn("bound", bound)
        again = materialize(again.select("id", *[f"x{j}" for j in range(d)], "bound", F.explode(_per_row(others, "array<int>", d, "home", "bound")).alias("block")), "visits")
        found = found.unionByName(_meet(again, c, _groups_per_block(again, blocks), k, d).select("id", "near", "far"))
    pairs = found.select(F.col("id").alias("query"), F.explode(F.arrays_zip("near", "far")).alias("p")).select(
        "query", F.col("p.near").alias("neighbor"), F.col("p.far").alias("d2"))
    w = W.partitionBy("query").orderBy("d2", "neighbor")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
