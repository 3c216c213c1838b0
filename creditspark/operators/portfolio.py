"""Portfolio KPIs, breakdowns, vintages and cohorts over a loan book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.functions.expr import (bin_by_edges, col, equal_width_edges, histogram_bin, month_difference,
                                        monthly_payment, month_of, safe_divide)

# Names of the four lifetime-value bins.
VALUE_SEGMENTS = ["Low Value", "Medium Value", "High Value", "Premium"]


def loan_math(df: DataFrame) -> DataFrame:
    """Payment, interest, expected loss, profit and return per loan."""
    amount = F.col("loan_amount")
    return (
        df.withColumn("monthly_payment", monthly_payment("loan_amount", "interest_rate", "loan_term"))
        .withColumn("total_interest", F.col("monthly_payment") * F.col("loan_term") - amount)
        .withColumn("expected_loss", amount * F.col("default_probability"))
        .withColumn("net_profit", F.col("total_interest") - F.col("expected_loss") - F.col("acquisition_cost"))
        .withColumn("roi", F.try_divide(F.col("net_profit"), amount))
    )


def share_of(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def portfolio_kpis(df: DataFrame) -> DataFrame:
    """Ten portfolio KPIs in one pass."""
    return df.agg(
        F.sum("loan_amount").alias("total_portfolio_value"),
        F.count("*").alias("total_customers"),
        F.avg("loan_amount").alias("average_loan_amount"),
        F.avg("default_probability").alias("portfolio_default_rate"),
        F.sum("net_profit").alias("total_expected_profit"),
        F.avg("credit_score").alias("average_credit_score"),
        F.avg("roi").alias("portfolio_roi"),
        (share_of(F.col("risk_category") == "High") * 100).alias("high_risk_percentage"),
        F.avg("acquisition_cost").alias("customer_acquisition_cost"),
        F.avg("customer_lifetime_value").alias("customer_lifetime_value"),
    )


def by_group(df: DataFrame, group: str | Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates per group; keyword name = output column."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def by_product(df):
    return by_group(df, "product_type", total_amount=F.sum("loan_amount"))


def by_risk(df):
    return by_group(df, "risk_category", total_amount=F.sum("loan_amount"), n=F.count("*"))


def by_region(df):
    return by_group(df, "region", total_amount=F.sum("loan_amount"), mean_pd=F.avg("default_probability"), n=F.count("*"))


def channel_roi(df: DataFrame) -> DataFrame:
    return by_group(df, "acquisition_channel", mean_ltv=F.avg("customer_lifetime_value"),
                    mean_cost=F.avg("acquisition_cost"), n=F.count("*")).withColumn(
        "ltv_cac_ratio", F.try_divide("mean_ltv", "mean_cost"))


def profit_by_product(df):
    return by_group(df, "product_type", total_profit=F.sum("net_profit"), mean_profit=F.avg("net_profit"), n=F.count("*"))


def risk_mix_by_month(df: DataFrame, levels: Sequence[str] = ("High", "Low", "Medium")) -> DataFrame:
    """Month by risk counts and their share of the month in percent."""
    counts = df.groupBy(month_of("origination_date").alias("month")).agg(*[F.count_if(F.col("risk_category") == lv).alias(lv) for lv in levels])
    total = sum((F.col(lv) for lv in levels[1:]), F.col(levels[0]))
    return counts.withColumns({f"{lv}_pct": F.try_divide(F.col(lv) * 100.0, total) for lv in levels})


def monthly_margin(df: DataFrame) -> DataFrame:
    return by_group(df.withColumn("month", month_of("origination_date")), "month",
                    profit=F.sum("net_profit"), amount=F.sum("loan_amount")).withColumn(
        "profit_margin", F.try_divide(F.col("profit") * 100, F.col("amount")))


def value_range(df: DataFrame, column: str | Column) -> tuple[float | None, float | None]:
    """Smallest and largest value: one row on the driver."""
    c = col(column).cast("double")
    r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    return r["lo"], r["hi"]


def value_segments(df: DataFrame, column: str = "customer_lifetime_value") -> DataFrame:
    """Mean profit, value and cost in four equal-width value bins."""
    lo, hi = value_range(df, column)
    if lo is None:  # no value to bin: all rows are without a segment
        lo, hi = 0.0, 1.0
    edges = equal_width_edges(lo, hi, len(VALUE_SEGMENTS))
    return by_group(df.withColumn("value_segment", bin_by_edges(column, edges, VALUE_SEGMENTS)), "value_segment",
                    mean_profit=F.avg("net_profit"), mean_ltv=F.avg("customer_lifetime_value"),
                    mean_cost=F.avg("acquisition_cost"))


def vintage_analysis(df: DataFrame, date: str, amount: str, status: str, months: int = 12,
                     bad: str = "default") -> DataFrame:
    """Amount, count and default rate of the last ``months`` origination months."""
    per = df.groupBy(month_of(date).alias("vintage")).agg(
        F.sum(amount).alias("total_amount"), F.count("*").alias("n"), F.count_if(F.col(status) == bad).alias("defaults"))
    return (per.withColumn("default_rate", F.try_divide(F.col("defaults") * 100.0, F.col("n")))
            .orderBy(F.desc("vintage")).limit(months).orderBy("vintage"))


def first_activity(df: DataFrame, user: str, date: str) -> DataFrame:
    """Distinct activity months per user with the user's first one.

    Months are made distinct before the per-user window, so a very active user
    is one short group.
    """
    months = df.select(F.col(user).alias("user"), month_of(date).alias("period")).distinct()
    return months.withColumn("cohort", F.min("period").over(W.partitionBy("user")))


def cohort_retention(df: DataFrame, user: str, date: str) -> DataFrame:
    """Distinct users per first-activity month and month offset, with retention of the cohort."""
    act = first_activity(df, user, date).withColumn("offset", month_difference("period", "cohort"))
    counts = act.groupBy("cohort", "offset").agg(F.count("*").alias("users"))  # (user, period) is distinct
    size = F.max(F.when(F.col("offset") == 0, F.col("users"))).over(W.partitionBy("cohort"))
    return counts.withColumn("cohort_size", size).withColumn("retention", F.col("users") / F.col("cohort_size"))


def retention_matrix(df: DataFrame, user: str, date: str, periods: int) -> DataFrame:
    """Wide form of ``cohort_retention`` for offsets 0..periods-1."""
    wide = cohort_retention(df, user, date).groupBy("cohort").pivot("offset", list(range(periods))).agg(F.first("retention"))
    return wide.toDF("cohort", *[f"m{i}" for i in range(periods)])


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return by_group(df, group, n=F.count(value), mean=F.avg(value), total=F.sum(value))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Long contingency table with row percentages."""
    counts = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows, cols).agg(F.count("*").alias("n"))
    return counts.withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(rows)))


def crosstab_wide(df: DataFrame, rows: str, cols: str, values: Sequence) -> DataFrame:
    return df.where(F.col(rows).isNotNull()).groupBy(rows).agg(*[F.count_if(F.col(cols) == F.lit(v)).alias(str(v)) for v in values])


def rate_by_category(df: DataFrame, category: str, target: str) -> DataFrame:
    return by_group(df, category, rate=F.avg(F.col(target).cast("double")), n=F.count("*"))


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None, density: bool = False) -> DataFrame:
    """Equal-width counts over the column's range, empty bins included (per class when ``by`` is given)."""
    lo, hi = value_range(df, column)
    keys = [by] if by else []
    if lo is None:
        return df.select(*keys).limit(0).select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
                                         F.lit(0).cast("long").alias("n"))
    a, b = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    width = (b - a) / bins
    binned = df.select(*keys, histogram_bin(F.col(column).cast("double"), lo, hi, bins).alias("bin")).where("bin is not null")
    # one row of counts per class leaves each task; empty bins come for free
    counts = binned.groupBy(*keys).agg(F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)]).alias("c")).select(
        *keys, F.posexplode("c").alias("bin", "n"))
    out = counts.select(*keys, "bin", (F.lit(a) + F.col("bin") * F.lit(width)).alias("low"),
                        (F.lit(a) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n")
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n") / F.lit(width), F.sum("n").over(W.partitionBy(*(keys or [F.lit(1)])))))
    return out


def growth_rate(current, previous) -> Column:
    """Percent change, 0 when there is no base."""
    return safe_divide((col(current) - col(previous)) * 100, previous)


def target_variance(actual, target) -> Column:
    return safe_divide((col(actual) - col(target)) * 100, target)


def variance_status(actual, target) -> Column:
    d = col(actual) - col(target)
    return F.when(d > 0, "above").when(d < 0, "below").when(d == 0, "on_target")


def progress(actual, target) -> Column:
    """Share of the target reached, at most 1."""
    return F.least(safe_divide(actual, target), F.lit(1.0))


def period_change(df: DataFrame, period: str, value: str) -> DataFrame:
    """Change to the previous period on a table with one row per period."""
    w = W.orderBy(period)
    prev = F.lag(value).over(w)
    return df.select(period, value, prev.alias("previous")).withColumns({
        "change": F.col(value) - F.col("previous"),
        "change_pct": F.try_divide((F.col(value) - F.col("previous")) * 100, F.col("previous"))})


def credit_ratios(df: DataFrame, amount: Column, defaulted: Column, recovered: Column, at_risk: Column,
                  used: Column, limit: Column) -> DataFrame:
    """Portfolio ratios in percent, each 0 when its denominator is 0.

    ``defaulted`` and ``at_risk`` are 0/1 columns, the others amounts per row.
    """
    lost = F.sum(F.when(defaulted == 1, amount).otherwise(0.0))
    back = F.sum(F.when(defaulted == 1, recovered).otherwise(0.0))
    return df.agg(
        safe_divide(F.sum(defaulted) * 100, F.count("*")).alias("default_rate"),
        safe_divide(back * 100, lost).alias("recovery_rate"),
        safe_divide(F.sum(at_risk * amount) * 100, F.sum(amount)).alias("portfolio_at_risk"),
        safe_divide(F.sum(used) * 100, F.sum(limit)).alias("credit_utilization"),
        safe_divide((lost - back) * 100, lost).alias("loss_given_default"))


def daily_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(date).alias("day")).agg(F.avg(value).alias("mean_value"))


def top_product(df: DataFrame) -> DataFrame:
    """Best product by mean return and the portfolio alerts, in one row."""
    per = df.groupBy("product_type").agg(
        F.avg("roi").alias("mean_roi"), F.sum("roi").alias("s"), F.count("roi").alias("c"),
        F.count_if(F.col("risk_category") == "High").alias("h"), F.count("*").alias("n"))
    out = per.agg(
        F.max_by("product_type", F.struct("mean_roi", "product_type")).alias("best_product"),
        (F.max("mean_roi") * 100).alias("best_roi"),
        (F.sum("h") * 100.0 / F.sum("n")).alias("high_risk_pct"),
        F.try_divide(F.sum("s") * 100, F.sum("c")).alias("portfolio_roi"))
    return out.withColumns({
        "risk_alert": F.when(F.col("high_risk_pct") > 15, "High Risk Alert").otherwise("Risk Management"),
        "strong_performance": F.coalesce(F.col("portfolio_roi") > 15, F.lit(False))})


def operation_stats(df: DataFrame, operation: str, duration: str, error: Column | None = None) -> DataFrame:
    """Time and call statistics per operation of a log table."""
    err = F.count_if(error) if error is not None else F.lit(0).cast("long")
    return df.groupBy(operation).agg(
        F.count("*").alias("calls"), err.alias("errors"), F.sum(duration).alias("total_time"),
        F.avg(duration).alias("avg_time"), F.min(duration).alias("min_time"), F.max(duration).alias("max_time"))


def ols_trendline(df: DataFrame, y: str, x: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                              F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def density_curve(df: DataFrame, column: str, by: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density per class with Scott's bandwidth n**(-1/5) times the sample std.

    One aggregate per grid point and the grid is the same for all classes, so
    the rows are never multiplied; bandwidths are joined, for any number of classes.
    Classes without spread have no curve, and a column without values has none at all.
    """
    lo, hi = value_range(df, column)
    if lo is None:
        return df.select(by, F.lit(0).alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull())
    width = rows.groupBy(by).agg((F.stddev_samp(x) * F.pow(F.count(x), F.lit(-0.2))).alias("h"))
    norm = (2 * 3.141592653589793) ** 0.5
    binned = rows.select(by, x.alias("x")).join(width.where("h > 0"), by)
    curves = binned.groupBy(by).agg(*[
        (F.avg(F.exp(-F.pow((F.lit(g) - F.col("x")) / F.col("h"), F.lit(2.0)) / 2) / F.col("h")) / norm).alias(f"g{i}")
        for i, g in enumerate(grid)])
    cells = F.array(*[F.struct(F.lit(g).alias("x"), F.col(f"g{i}").alias("density")) for i, g in enumerate(grid)])
    return curves.select(by, F.posexplode(cells).alias("point", "c")).select(by, "point", "c.x", "c.density")


def normal_curve(df: DataFrame, column: str, points: int = 50, bins: int = 30) -> DataFrame:
    """Normal density with the column's mean and std, scaled to the counts of a histogram."""
    x = F.col(column).cast("double")
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"),
               F.count(x).alias("n"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    z = (F.col("x") - F.col("m")) / F.col("s")
    return (s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
            .withColumn("x", F.col("lo") + F.col("point") * step)
            .select("point", "x", (F.exp(-z * z / 2) / (F.col("s") * (2 * 3.141592653589793) ** 0.5)
                                   * F.col("n") * (F.col("hi") - F.col("lo")) / bins).alias("y")))
