"""Query registry: each entry pairs a Spark plan with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL counterpart."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round floating columns so that the order of additions cannot show.

    The reports are small; the operators themselves never round.
    """
    return df.select([
        (F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def rounded_sql(sql: str, plain: str, doubles: str, digits: int = 4) -> str:
    """The same rounding for SQL: ``plain`` and ``doubles`` are column lists."""
    cols = [f'"{c}"' for c in plain.split()]
    cols += [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in doubles.split()]
    return f"SELECT {', '.join(cols)} FROM ({sql}) q"
