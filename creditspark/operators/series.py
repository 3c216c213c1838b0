"""Window functions over short ordered series.

The inputs hold one row per period (per ``by`` group), as ``period_series``
makes them, so an un-partitioned window orders months, not raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def period_series(df: DataFrame, date: str, value: Column, unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Aggregate raw rows to one ``value`` per period."""
    return df.groupBy(*by, F.date_trunc(unit, F.col(date)).alias("period")).agg(value.alias("value"))


def _frame(by: Sequence[str], order: str, lo: int, hi: int):
    return W.partitionBy(*by).orderBy(order).rowsBetween(lo, hi)


def moving_average(df: DataFrame, value: str = "value", order: str = "period", window: int = 7,
                   by: Sequence[str] = (), name: str = "moving_avg") -> DataFrame:
    """Trailing mean, null until the window is full."""
    w = _frame(by, order, -(window - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def centered_trend(df: DataFrame, value: str = "value", order: str = "period", window: int = 12,
                   by: Sequence[str] = (), name: str = "trend") -> DataFrame:
    """Centered mean over ``window`` rows; an even window reaches one row further back."""
    w = _frame(by, order, -(window // 2), window - window // 2 - 1)
    return df.withColumn(name, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def decompose(df: DataFrame, value: str = "value", order: str = "period", window: int = 12,
              by: Sequence[str] = (), seasonal_means: bool = False) -> DataFrame:
    """Trend, seasonal and residual parts.

    By default seasonal is value - trend and the residual 0. With
    ``seasonal_means`` the seasonal part is the mean deviation of the calendar
    month and the residual is what remains.
    """
    out = centered_trend(df, value, order, window, by)
    dev = F.col(value) - F.col("trend")
    if not seasonal_means:
        return out.withColumn("seasonal", dev).withColumn("residual", dev - F.col("seasonal"))
    month = W.partitionBy(*by, F.month(order))
    out = out.withColumn("seasonal", F.avg(dev).over(month))
    return out.withColumn("residual", dev - F.col("seasonal"))


def growth(df: DataFrame, value: str = "value", order: str = "period", by: Sequence[str] = (),
           name: str = "growth_rate") -> DataFrame:
    """Percent change to the previous row; nulls are padded with the last value first."""
    past = _frame(by, order, W.unboundedPreceding, 0)
    before = _frame(by, order, W.unboundedPreceding, -1)
    cur = F.last(value, ignorenulls=True).over(past)
    prev = F.last(value, ignorenulls=True).over(before)
    return df.withColumn(name, F.try_divide((cur - prev) * 100, prev))


def trend_direction(df: DataFrame, value: str = "value", order: str = "period", by: Sequence[str] = (),
                    span: int = 3, tolerance: float = 0.05) -> DataFrame:
    """increasing / decreasing / stable from the mean of the last and first ``span`` rows."""
    up = F.row_number().over(W.partitionBy(*by).orderBy(order))
    down = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))
    ranked = df.withColumns({"_u": up, "_d": down})
    out = ranked.groupBy(*by).agg(
        F.avg(F.when(F.col("_u") <= span, F.col(value))).alias("first_mean"),
        F.avg(F.when(F.col("_d") <= span, F.col(value))).alias("last_mean"), F.count("*").alias("n"))
    return out.withColumn("direction", F.when(F.col("n") < 2, "stable")
                          .when(F.col("last_mean") > F.col("first_mean") * (1 + tolerance), "increasing")
                          .when(F.col("last_mean") < F.col("first_mean") * (1 - tolerance), "decreasing")
                          .otherwise("stable"))


def linear_trend(df: DataFrame, value: str = "value", order: str = "period", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line over the 0-based row position, added to every row."""
    pos = df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    w = W.partitionBy(*by)
    return pos.withColumns({
        "slope": F.regr_slope(value, "position").over(w),
        "intercept": F.regr_intercept(value, "position").over(w)}).withColumn(
        "fitted", F.col("intercept") + F.col("slope") * F.col("position"))


def linear_forecast(df: DataFrame, value: str = "value", order: str = "period", horizon: int = 6,
                    by: Sequence[str] = (), min_points: int = 12) -> DataFrame:
    """Project the line ``horizon`` month ends ahead; groups under ``min_points`` rows give none."""
    pos = df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    fit = pos.groupBy(*by).agg(
        F.regr_slope(value, "position").alias("slope"), F.regr_intercept(value, "position").alias("intercept"),
        F.count("*").alias("n"), F.max(order).alias("last")).where(F.col("n") >= min_points)
    return (fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
            .select(*by, (F.col("h") + 1).alias("step"),
                    F.last_day(F.add_months("last", F.col("h") + 1)).alias("date"),
                    (F.col("intercept") + F.col("slope") * (F.col("n") + F.col("h"))).alias("forecast")))


def waterfall(df: DataFrame, row: str, feature: str = "feature", contribution: str = "contribution",
              base: str = "base_value") -> DataFrame:
    """Running total of contributions from the base value, largest first."""
    w = W.partitionBy(row).orderBy(F.desc(F.abs(F.col(contribution))), feature)
    return df.withColumn("step", F.row_number().over(w)).withColumn(
        "running_total", F.col(base) + F.sum(contribution).over(w.rowsBetween(W.unboundedPreceding, 0)))
