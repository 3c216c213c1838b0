"""Exact ranks, running totals and quantiles without a one-task sort.

An un-partitioned window, a window over a hot key, or an exact ``percentile``
buffer puts an unbounded group into one task. The functions here bound that:

* hash order: the leading bits of the hash are an order-preserving, evenly
  filled bucket. Totals per bucket give the offset, the window runs per bucket.
* value order: buckets come from approximate quantiles, found first.
* quantiles: counts per value range, then finer counts inside the ranges that hold
  a wanted rank, until each range holds one value.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.sources.io import materialize

TASK_ROWS = 1_000_000  # rows one ordered window may hold
HASH_BITS = 16


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def hash_rank(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), seed: int = 42,
              rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in a repeatable pseudo-random order within ``by``.

    ``keys`` must identify a row. ``total`` names an optional column with the
    group size. A group of any size is spread over 2**16 buckets.
    """
    by = list(by)
    rows = df.withColumn("_hr_h", hash_order(keys, seed)).withColumn("_hr_b", F.shiftright("_hr_h", 64 - HASH_BITS))
    sizes = rows.groupBy(*by, "_hr_b").agg(F.count("*").alias("_hr_n"))
    ordered = W.partitionBy(*by).orderBy("_hr_b")
    sizes = sizes.select(
        *[F.col(c).alias(f"_hr_k{i}") for i, c in enumerate(by)], F.col("_hr_b").alias("_hr_kb"),
        (F.sum("_hr_n").over(ordered) - F.col("_hr_n")).alias("_hr_off"),
        F.sum("_hr_n").over(W.partitionBy(*by)).alias("_hr_all"))
    on = [F.col(c).eqNullSafe(F.col(f"_hr_k{i}")) for i, c in enumerate(by)] + [F.col("_hr_b") == F.col("_hr_kb")]
    inside = W.partitionBy(*by, "_hr_b").orderBy("_hr_h", *keys)
    out = (rows.withColumn("_hr_r", F.row_number().over(inside) - 1)
           .join(sizes, on)
           .withColumn(rank, F.col("_hr_r") + F.col("_hr_off")))
    if total:
        out = out.withColumn(total, F.col("_hr_all"))
    return out.drop("_hr_h", "_hr_b", "_hr_r", "_hr_off", "_hr_all", "_hr_kb", *[f"_hr_k{i}" for i in range(len(by))])


def value_splits(df: DataFrame, column: str, task_rows: int = TASK_ROWS, bound: DataFrame | None = None) -> list[float]:
    """Inner bucket edges that leave about ``task_rows`` rows per bucket; empty when one suffices.

    ``bound`` is a table with at least as many rows that is cheaper to count.
    """
    if bound is not None and bound.count() <= task_rows:
        return []
    n = df.where(F.col(column).isNotNull()).count()
    if n <= task_rows:
        return []
    parts = -(-n // task_rows)
    probs = [i / parts for i in range(1, parts)]
    edges = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 20 * parts)).first()[0]
    return sorted(set(edges))


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, prefix: str = "cum_", task_rows: int = TASK_ROWS,
                   bound: DataFrame | None = None) -> DataFrame:
    """Running sums of ``sums`` along a numeric column with distinct values per ``by``.

    Pre-aggregate to one row per (by, order) first. Above ``task_rows`` rows the
    order column is cut into buckets, so no task orders the whole table.
    """
    by = list(by)
    edges = value_splits(df, order, task_rows, bound)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if not edges:
        w = W.partitionBy(*by).orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({f"{prefix}{c}": F.sum(c).over(w) for c in sums})
    rows = (Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_v", outputCol="_b", handleInvalid="keep")
            .transform(df.withColumn("_v", F.col(order).cast("double"))).drop("_v"))
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    bdir = F.col("_b").desc() if descending else F.col("_b").asc()
    before = W.partitionBy(*by).orderBy(bdir).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_kb"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_b") == F.col("_kb")]
    inside = W.partitionBy(*by, "_b").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({f"_w_{c}": F.sum(c).over(inside) for c in sums}).join(totals, on)
    return out.select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in sums])


def average_ranks(df: DataFrame, column: str, rank: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct values of ``column`` with their tie-averaged 1-based rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return running_totals(counts, column, ["_n"], task_rows=task_rows, bound=df).select(
        F.col(column), (F.col("cum__n") - (F.col("_n") - 1) / F.lit(2.0)).alias(rank))


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (by..., name, value) as doubles."""
    return df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), name, value)


def double_array(values: Sequence[float]) -> Column:
    """Constant array of doubles, parsed as one expression."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


OCTAVE = 4096  # first buckets per doubling of |value| + 1
FINE = 4096  # most buckets of a later round between a bucket's smallest and largest value
ROUND = 1 << 18  # about so many buckets are counted in a later round, but 16 per refined bucket at least
FEW_CELLS = 100_000  # refined buckets that are broadcast; more are joined


def _coarse(v: Column) -> Column:
    """Order-preserving bucket number of any double; NaN comes last, null stays null. There are about 130 * OCTAVE buckets at most."""
    size = F.log2(1 + F.abs(v))
    size = F.when(size <= 64, size * OCTAVE).otherwise(64 * OCTAVE + F.least(size - 64, F.lit(1000.0)))
    signed = F.when(v < 0, -F.ceil(size)).otherwise(F.floor(size))
    return F.when(F.isnan(v), F.lit(64 * OCTAVE + 1001)).when(v.isNotNull(), signed).cast("long")


def _fine(v: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Order-preserving bucket number between two different values, which get different numbers; halves keep the range finite."""
    return F.when(F.isnan(hi) | (F.abs(hi) == float("inf")) | (F.abs(lo) == float("inf")), F.when(v == lo, 0).when(v == hi, 2).otherwise(1)).otherwise(
        F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * parts)).cast("long")


def _bucketed(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return long_values(df, cols, by).withColumns({"path": F.lit(""), "base": F.lit(0).cast("long"), "bucket": _coarse(F.col("value"))})


def _histogram(rows: DataFrame, place: Sequence[str]) -> DataFrame:
    return rows.where(F.col("bucket").isNotNull()).groupBy(*place, "bucket").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _refined(rows: DataFrame, keys: Sequence[str], cells: DataFrame, n: int) -> DataFrame:
    """The rows of the given ``n`` buckets, in finer buckets."""
    parts = max(min(FINE, 16), min(FINE, ROUND // n))
    cells = cells.select(*[F.col(c).alias(f"_c{j}") for j, c in enumerate([*keys, "path", "bucket"])], "lo", "hi", "first")
    on = [F.col(c).eqNullSafe(F.col(f"_c{j}")) for j, c in enumerate([*keys, "path"])] + [F.col("bucket") == F.col(f"_c{len(keys) + 1}")]
    return rows.join(F.broadcast(cells) if n <= FEW_CELLS else cells, on).select(
        *keys, "value", F.concat_ws("/", "path", "bucket").alias("path"), F.col("first").alias("base"), _fine(F.col("value"), F.col("lo"), F.col("hi"), parts).alias("bucket"))


def quantile_dict(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, dict[float, float]]:
    """Quantiles of whole columns on the driver, as ``quantiles`` finds them; None for a column without values.

    The driver sees the counts of buckets: a bounded number per column, then per wanted rank.
    """
    probs = [float(p) for p in probs]
    rows, wanted, parts, found = _bucketed(df, cols, []), None, {}, {}
    while True:
        table = _histogram(rows, ["feature", "path", "base"]).toPandas().sort_values(["feature", "path", "bucket"])
        deeper, cells = defaultdict(list), {}
        for (feature, path), g in table.groupby(["feature", "path"], sort=False):
            n, lo, hi, bucket = (g[c].to_numpy() for c in ("n", "lo", "hi", "bucket"))
            first = int(g["base"].iloc[0]) + np.cumsum(n) - n
            if wanted is None:
                pos = [p * (int(n.sum()) - 1) for p in probs]
                parts[feature] = [x - math.floor(x) for x in pos]
                asked = [(f(x), i, side) for i, x in enumerate(pos) for side, f in enumerate((math.floor, math.ceil))]
            else:
                asked = wanted[feature, path]
            at = np.searchsorted(first, [a[0] for a in asked], "right") - 1
            for j, (rank, i, side) in zip(at.tolist(), asked):
                if not lo[j] < hi[j] or rank == first[j]:
                    found[feature, i, side] = float(lo[j])
                elif rank == first[j] + n[j] - 1:
                    found[feature, i, side] = float(hi[j])
                else:
                    deeper[feature, f"{path}/{bucket[j]}"].append((rank, i, side))
                    cells[feature, path, bucket[j]] = (feature, path, int(bucket[j]), float(lo[j]), float(hi[j]), int(first[j]))
        if not deeper:
            break
        wanted = deeper
        schema = "feature string, path string, bucket long, lo double, hi double, first long"
        rows = _refined(rows, ["feature"], df.sparkSession.createDataFrame(list(cells.values()), schema), len(cells))
    out: dict[str, dict[float, float]] = {c: dict.fromkeys(probs) for c in cols}
    for c in parts:
        for i, (p, part) in enumerate(zip(probs, parts[c])):
            a, b = found[c, i, 0], found[c, i, 1]
            out[c][p] = a if part == 0 or a == b else a * (1 - part) + b * part
    return out


def _ranks_in_buckets(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], wanted: DataFrame | None) -> DataFrame:
    """For each wanted rank the bucket that holds it: its number, smallest and largest value, first rank and size."""
    place = [*keys, "path", "base"]
    hist = _histogram(rows, place)
    before = W.partitionBy(*place).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = hist.withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    if wanted is None:
        totals = hist.groupBy(*place).agg(F.sum("n").alias("total"))
        pos = F.col("p") * (F.col("total") - 1)
        sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(pos).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(pos).alias("rank")))
        wanted = totals.select(*place, "total", F.posexplode(double_array(probs)).alias("i", "p")).select(
            *place, "i", (pos - F.floor(pos)).alias("part"), F.explode(sides).alias("s")).select(*place, "i", "part", "s.side", "s.rank")
    bucket = F.struct("bucket", "n", "lo", "hi", "first")
    events = cells.select(*place, F.col("first").alias("at"), bucket.alias("b"), *[F.lit(None).cast(t).alias(c) for c, t in (("i", "int"), ("part", "double"), ("side", "int"))]
                          ).unionByName(wanted.select(*place, F.col("rank").alias("at"), F.lit(None).cast("struct<bucket:bigint,n:bigint,lo:double,hi:double,first:bigint>").alias("b"),
                                                      "i", "part", "side"))
    upto = W.partitionBy(*place).orderBy("at", F.col("i").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("b", F.last("b", ignorenulls=True).over(upto)).where(F.col("i").isNotNull()).select(
        *place, "i", "part", "side", F.col("at").alias("rank"), "b.*")


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles as rows (by..., feature, p, value), by histogram refinement.

    A first aggregate counts the values per bucket of an order-preserving scale. A rank whose bucket holds
    one value, or that is the first or last of its bucket, is answered there. Only the buckets of the other ranks are
    counted again in ``FINE`` parts, until all are answered. Every round is one aggregate with a bounded number of
    buckets per wanted rank, whatever the size of the table; nothing is sorted, sampled or estimated.
    A group without values has null quantiles; NaN counts as the largest value.
    """
    by, probs = list(by), [float(p) for p in probs]
    if not by:
        got = quantile_dict(df, cols, probs)
        return df.sparkSession.createDataFrame([(c, p, v) for c, q in got.items() for p, v in q.items()], "feature string, p double, value double")
    keys = [*by, "feature"]
    rows, answers, wanted = _bucketed(df, cols, by), None, None
    while True:
        value = F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == F.col("first")), F.col("lo")).when(F.col("rank") == F.col("first") + F.col("n") - 1, F.col("hi"))
        got = materialize(_ranks_in_buckets(rows, keys, probs, wanted).withColumn("value", value), "ranks")
        known = got.where(F.col("value").isNotNull()).select(*keys, "i", "part", "side", "value")
        answers = known if answers is None else answers.unionByName(known)
        still = got.where(F.col("value").isNull())
        cells = still.select(*keys, "path", "bucket", "lo", "hi", "first").distinct()
        n = cells.limit(FEW_CELLS + 1).count()
        if not n:
            break
        wanted = still.select(*keys, F.concat_ws("/", "path", "bucket").alias("path"), F.col("first").alias("base"), "i", "part", "side", "rank")
        rows = _refined(rows, keys, cells, n)

    def side(s: int) -> Column:
        return F.max(F.when(F.col("side") == s, F.col("value")))

    out = answers.groupBy(*keys, "i").agg(side(0).alias("a"), side(1).alias("b"), F.max("part").alias("part"))
    between = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    out = out.select(*keys, F.get(double_array(probs), F.col("i")).alias("p"), between.alias("value"))
    every = df.select(*by).distinct().select(
        *by, F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature")).select(*keys, F.explode(double_array(probs)).alias("p"))
    found = out.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "p"])], "value")
    return every.join(found, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "p"])], "left").select(*keys, "p", "value")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column, smallest on ties, as (feature, value string, n).

    Counts are combined map-side, so a hot value costs one row per task.
    """
    parts = []
    for c in cols:
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"))
        parts.append(counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).cast("string").alias("value"),
                                F.max("n").alias("n")).select(F.lit(c).alias("feature"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
