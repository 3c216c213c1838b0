"""Filters, sorting, sampling, splitting and set operations on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.functions.ordering import hash_order, hash_rank


def in_filter(df: DataFrame, choices: Mapping) -> DataFrame:
    """List = membership, scalar = equality; columns the table lacks and empty lists are skipped."""
    for c, v in choices.items():
        if c not in df.columns or v is None:
            continue
        if isinstance(v, (list, tuple, set)):
            if v:
                df = df.where(F.col(c).isin(list(v)))
        else:
            df = df.where(F.col(c) == F.lit(v))
    return df


def range_filter(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Inclusive ranges; a None end is open."""
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            df = df.where(F.col(c) >= F.lit(lo))
        if hi is not None:
            df = df.where(F.col(c) <= F.lit(hi))
    return df


def search_filter(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring match."""
    return df.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(text))))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def paginate(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """Page (1-based) of an ordered table. For deep pages use ``page_after``."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, order: str, last, size: int) -> DataFrame:
    """Next page by key: no skipped row is sorted or moved."""
    return (df if last is None else df.where(F.col(order) > F.lit(last))).orderBy(order).limit(size)


def top_k(df: DataFrame, by: str, k: int, absolute: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    c = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(c.desc(), *tie).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], by: str, k: int, absolute: bool = False,
                    tie: Sequence[str] = ()) -> DataFrame:
    """Largest k rows per group; the rank filter becomes a map-side group limit."""
    c = F.abs(F.col(by)) if absolute else F.col(by)
    w = W.partitionBy(*group).orderBy(c.desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sort_by_abs(df: DataFrame, column: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), *tie)


def best_by(df: DataFrame, name: str, metric: str, largest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Name with the best metric; ties go to the smallest name."""
    key = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), F.col(name).alias("n"))
    rows = df.where(F.col(metric).isNotNull())
    best = F.min(key)
    return rows.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.n").alias(name), (-F.col("b.m") if largest else F.col("b.m")).alias(metric))


def best_by_mean(df: DataFrame, name: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Name with the highest mean of all metrics, each row's nulls left out of its mean; ties go to the smallest name."""
    values = F.filter(F.array(*[F.col(m).cast("double") for m in metrics]), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))
    return best_by(df.withColumn("mean_metric", mean), name, "mean_metric", by=by)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for any partitioning."""
    return df.orderBy(hash_order(keys, seed), *keys).limit(n)


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, test: float = 0.2, validation: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` (train / validation / test) with exact class shares.

    The validation share is of the whole; it is taken from what the test set leaves.
    """
    ranked = hash_rank(df, keys, [label], seed, rank="_r", total="_t")
    n_test = F.round(F.col("_t") * test)
    n_val = F.round((F.col("_t") - n_test) * (validation / (1 - test)))
    return ranked.withColumn(
        "split", F.when(F.col("_r") < n_test, "test").when(F.col("_r") < n_test + n_val, "validation").otherwise("train")
    ).drop("_r", "_t")


def class_balance(df: DataFrame, keys: Sequence[str], label: str, method: str = "under", seed: int = 42) -> DataFrame:
    """Equal class sizes by dropping (under) or repeating (over) rows, or weights that balance them."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    small, large = min(sizes.values()), max(sizes.values())
    size = F.lit(None).cast("long")
    for k, n in sizes.items():
        size = F.when(F.col(label) == F.lit(k), F.lit(n)).otherwise(size)
    if method == "weight":
        return df.withColumn("weight", F.lit(float(sum(sizes.values()))) / (len(sizes) * size))
    ranked = hash_rank(df, keys, [label], seed, rank="_r")
    if method == "under":
        return ranked.where(F.col("_r") < small).drop("_r")
    copies = F.floor(F.lit(large) / size) + F.when(F.col("_r") < F.lit(large) % size, 1).otherwise(0)
    return (ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_r"))


def set_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is absent in ``right``."""
    return left.join(right.select(*on), list(on), "left_anti")


def append_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
