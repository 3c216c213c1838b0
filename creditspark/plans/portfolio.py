"""Portfolio, vintage, cohort and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions import expr as E
from creditspark.operators import portfolio as P
from creditspark.operators import series as S
from creditspark.plans.registry import query, rounded, rounded_sql
from creditspark.sources.fixtures import APPLICANTS, LOANS, PANEL, applicants, credit_panel, loans, table

BOOK = LOANS + """, l1 AS (SELECT *, loan_amount * (interest_rate / 1200.0::DOUBLE)
  / (1 - pow(1 + interest_rate / 1200.0::DOUBLE, -loan_term)) AS monthly_payment FROM loans),
l2 AS (SELECT *, monthly_payment * loan_term - loan_amount AS total_interest, loan_amount * default_probability AS expected_loss FROM l1),
l3 AS (SELECT *, total_interest - expected_loss - acquisition_cost AS net_profit FROM l2),
book AS (SELECT *, net_profit / loan_amount AS roi FROM l3)"""


def book(spark, sf):
    return P.loan_math(loans(spark, sf))


@query("j05_portfolio_star", f"WITH {LOANS} SELECT * FROM loans")
def j05(spark, sf):
    return loans(spark, sf)


@query("m04_loan_math", rounded_sql(f"WITH {BOOK} SELECT loan_id, monthly_payment, total_interest, expected_loss, net_profit, roi FROM book",
                                    "loan_id", "monthly_payment total_interest expected_loss net_profit roi", 6))
def m04(spark, sf):
    return rounded(book(spark, sf).select("loan_id", "monthly_payment", "total_interest", "expected_loss", "net_profit", "roi"), 6)


@query("a01_portfolio_kpis", rounded_sql(f"""WITH {BOOK} SELECT sum(loan_amount) total_portfolio_value, count(*) total_customers,
 avg(loan_amount) average_loan_amount, avg(default_probability) portfolio_default_rate, sum(net_profit) total_expected_profit,
 avg(credit_score) average_credit_score, avg(roi) portfolio_roi,
 avg(CASE WHEN risk_category = 'High' THEN 1.0 ELSE 0.0 END) * 100 high_risk_percentage,
 avg(acquisition_cost) customer_acquisition_cost, avg(customer_lifetime_value) customer_lifetime_value FROM book""",
    "total_customers", "total_portfolio_value average_loan_amount portfolio_default_rate total_expected_profit average_credit_score "
    "portfolio_roi high_risk_percentage customer_acquisition_cost customer_lifetime_value", 2))
def a01(spark, sf):
    return rounded(P.portfolio_kpis(book(spark, sf)), 2)


@query("a02_by_product", rounded_sql(f"WITH {LOANS} SELECT product_type, sum(loan_amount) total_amount FROM loans GROUP BY 1",
                                     "product_type", "total_amount", 2))
def a02(spark, sf):
    return rounded(P.by_product(loans(spark, sf)), 2)


@query("a03_by_risk", rounded_sql(f"WITH {LOANS} SELECT risk_category, sum(loan_amount) total_amount, count(*) n FROM loans GROUP BY 1",
                                  "risk_category n", "total_amount", 2))
def a03(spark, sf):
    return rounded(P.by_risk(loans(spark, sf)), 2)


@query("a04_by_region", rounded_sql(
    f"WITH {LOANS} SELECT region, sum(loan_amount) total_amount, avg(default_probability) mean_pd, count(*) n FROM loans GROUP BY 1",
    "region n", "total_amount mean_pd", 3))
def a04(spark, sf):
    return rounded(P.by_region(loans(spark, sf)), 3)


@query("a05_channel_roi", rounded_sql(f"""WITH {LOANS} SELECT acquisition_channel, avg(customer_lifetime_value) mean_ltv,
 avg(acquisition_cost) mean_cost, count(*) n, avg(customer_lifetime_value) / avg(acquisition_cost) ltv_cac_ratio FROM loans GROUP BY 1""",
    "acquisition_channel n", "mean_ltv mean_cost ltv_cac_ratio"))
def a05(spark, sf):
    return rounded(P.channel_roi(loans(spark, sf)))


@query("a06_profit_by_product", rounded_sql(
    f"WITH {BOOK} SELECT product_type, sum(net_profit) total_profit, avg(net_profit) mean_profit, count(*) n FROM book GROUP BY 1",
    "product_type n", "total_profit mean_profit", 2))
def a06(spark, sf):
    return rounded(P.profit_by_product(book(spark, sf)), 2)


@query("a07_risk_mix_by_month", rounded_sql(f"""WITH {LOANS}, c AS (SELECT date_trunc('month', origination_date) AS "month",
 count(*) FILTER (WHERE risk_category = 'High') AS "High", count(*) FILTER (WHERE risk_category = 'Low') AS "Low",
 count(*) FILTER (WHERE risk_category = 'Medium') AS "Medium", count(*) AS n FROM loans GROUP BY 1)
SELECT *, "High" * 100.0 / n AS "High_pct", "Low" * 100.0 / n AS "Low_pct", "Medium" * 100.0 / n AS "Medium_pct" FROM c""",
    "month High Low Medium", "High_pct Low_pct Medium_pct"))
def a07(spark, sf):
    return rounded(P.risk_mix_by_month(loans(spark, sf)))


@query("a08_monthly_margin", rounded_sql(f"""WITH {BOOK} SELECT date_trunc('month', origination_date) AS "month", sum(net_profit) profit,
 sum(loan_amount) amount, sum(net_profit) * 100 / sum(loan_amount) profit_margin FROM book GROUP BY 1""",
    "month", "profit amount profit_margin", 3))
def a08(spark, sf):
    return rounded(P.monthly_margin(book(spark, sf)), 3)


@query("a09_value_segments", rounded_sql(f"""WITH {BOOK}, r AS (SELECT min(customer_lifetime_value) lo, max(customer_lifetime_value) hi FROM book)
SELECT CASE WHEN customer_lifetime_value <= lo + (hi - lo) * 1 / 4 THEN 'Low Value' WHEN customer_lifetime_value <= lo + (hi - lo) * 2 / 4 THEN 'Medium Value'
 WHEN customer_lifetime_value <= lo + (hi - lo) * 3 / 4 THEN 'High Value' ELSE 'Premium' END value_segment,
 avg(net_profit) mean_profit, avg(customer_lifetime_value) mean_ltv, avg(acquisition_cost) mean_cost FROM book, r GROUP BY 1""",
    "value_segment", "mean_profit mean_ltv mean_cost"))
def a09(spark, sf):
    return rounded(P.value_segments(book(spark, sf)))


@query("a10_vintage_analysis", rounded_sql(f"""WITH {LOANS}, v AS (SELECT date_trunc('month', origination_date) AS vintage, sum(loan_amount) total_amount,
 count(*) n, count(*) FILTER (WHERE status = 'default') defaults FROM loans GROUP BY 1)
SELECT *, defaults * 100.0 / n AS default_rate FROM v ORDER BY vintage DESC LIMIT 12""",
    "vintage n defaults", "total_amount default_rate", 3))
def a10(spark, sf):
    return rounded(P.vintage_analysis(loans(spark, sf), "origination_date", "loan_amount", "status"), 3)


COHORTS = """act AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS period FROM orders),
f AS (SELECT *, min(period) OVER (PARTITION BY u) AS cohort FROM act),
c AS (SELECT cohort, CAST((year(period) - year(cohort)) * 12 + month(period) - month(cohort) AS INTEGER) AS "offset", count(*) AS users FROM f GROUP BY 1, 2),
r AS (SELECT *, max(CASE WHEN "offset" = 0 THEN users END) OVER (PARTITION BY cohort) AS cohort_size FROM c)"""


@query("a11_cohort_retention", rounded_sql(f"""WITH {COHORTS} SELECT *, users / cohort_size AS retention FROM r""",
                                           "cohort offset users cohort_size", "retention", 6))
def a11(spark, sf):
    return rounded(P.cohort_retention(table(spark, sf, "orders"), "o_custkey", "o_orderdate"), 6)


@query("a11_retention_matrix", rounded_sql(f"""WITH {COHORTS} SELECT cohort, {', '.join(f'max(CASE WHEN "offset" = {i} THEN users / cohort_size END) AS m{i}' for i in range(6))}
FROM r GROUP BY cohort""", "cohort", " ".join(f"m{i}" for i in range(6)), 6))
def a11m(spark, sf):
    return rounded(P.retention_matrix(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 6), 6)


@query("w08_first_activity", """SELECT DISTINCT user_id AS "user", date_trunc('month', ts) AS period,
 min(date_trunc('month', ts)) OVER (PARTITION BY user_id) AS cohort FROM events""")
def w08(spark, sf):
    return P.first_activity(table(spark, sf, "events"), "user_id", "ts")


@query("a12_demographic_summary", rounded_sql(f"""WITH {APPLICANTS} SELECT race, count(annual_income) n, avg(annual_income) mean, sum(annual_income) total
 FROM applicants GROUP BY 1""", "race n", "mean total", 3))
def a12(spark, sf):
    return rounded(P.group_summary(applicants(spark, sf), "race", "annual_income"), 3)


@query("a15_value_counts", f"WITH {LOANS} SELECT acquisition_channel, count(*) n FROM loans GROUP BY 1")
def a15(spark, sf):
    return P.value_counts(loans(spark, sf), "acquisition_channel")


@query("a16_crosstab", rounded_sql(f"""WITH {LOANS} SELECT region, risk_category, count(*) n,
 count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY region) AS row_pct FROM loans GROUP BY 1, 2""", "region risk_category n", "row_pct"))
def a16(spark, sf):
    return rounded(P.crosstab(loans(spark, sf), "region", "risk_category"))


@query("a16_crosstab_wide", f"""WITH {LOANS} SELECT region, count(*) FILTER (WHERE risk_category = 'High') AS "High",
 count(*) FILTER (WHERE risk_category = 'Low') AS "Low", count(*) FILTER (WHERE risk_category = 'Medium') AS "Medium" FROM loans GROUP BY 1""")
def a16w(spark, sf):
    return P.crosstab_wide(loans(spark, sf), "region", "risk_category", ["High", "Low", "Medium"])


@query("a17_rate_by_category", rounded_sql(f"""WITH {PANEL} SELECT "EDUCATION", avg(target) rate, count(*) n FROM panel GROUP BY 1""",
                                           "EDUCATION n", "rate", 6))
def a17(spark, sf):
    return rounded(P.rate_by_category(credit_panel(spark, sf), "EDUCATION", "target"), 6)


_HIST = """, r AS (SELECT min(x) lo, max(x) hi FROM src), w AS (SELECT lo, (hi - lo) / 20 AS width FROM r),
b AS (SELECT grp, CAST(least(floor((x - lo) / width), 19) AS INTEGER) AS bin, count(*) n FROM src, w GROUP BY 1, 2),
g AS (SELECT DISTINCT grp, CAST(i AS INTEGER) AS bin FROM src, range(20) t(i)),
h AS (SELECT g.grp, g.bin, lo + g.bin * width AS low, lo + (g.bin + 1) * width AS high, coalesce(n, 0) AS n, width
 FROM g LEFT JOIN b ON g.grp = b.grp AND g.bin = b.bin, w)"""


@query("a30_histogram", rounded_sql(f"WITH {LOANS}, src AS (SELECT 1 AS grp, loan_amount AS x FROM loans){_HIST} SELECT bin, low, high, n, n / width / sum(n) OVER () AS density FROM h",
                                    "bin n", "low high density", 8))
def a30(spark, sf):
    return rounded(P.histogram(loans(spark, sf), "loan_amount", 20, density=True), 8)


@query("a30_histogram_by_class", rounded_sql(f"WITH {LOANS}, src AS (SELECT risk_category AS grp, loan_amount AS x FROM loans){_HIST} SELECT grp AS risk_category, bin, low, high, n FROM h",
                                             "risk_category bin n", "low high"))
def a30c(spark, sf):
    return rounded(P.histogram(loans(spark, sf), "loan_amount", 20, by="risk_category"))


@query("a33_kpi_variance", rounded_sql(f"""WITH {BOOK}, m AS (SELECT date_trunc('month', origination_date) AS period, sum(net_profit) AS value FROM book GROUP BY 1),
p AS (SELECT *, lag(value) OVER (ORDER BY period) AS previous FROM m)
SELECT period, value, previous, value - previous AS change, (value - previous) * 100 / previous AS change_pct,
 (value - 500000) * 100 / 500000 AS target_variance, CASE WHEN value > 500000 THEN 'above' WHEN value < 500000 THEN 'below' ELSE 'on_target' END AS status,
 least(value / 500000, 1) AS progress FROM p""", "period status", "value previous change change_pct target_variance progress", 2))
def a33(spark, sf):
    m = S.period_series(book(spark, sf), "origination_date", F.sum("net_profit"))
    goal = F.lit(500000.0)
    return rounded(P.period_change(m, "period", "value").withColumns({
        "target_variance": P.target_variance("value", goal), "status": P.variance_status("value", goal),
        "progress": P.progress("value", goal)}), 2)


@query("a34_credit_ratios", rounded_sql(f"""WITH {LOANS}, r AS (SELECT *, CASE WHEN status = 'default' THEN 1 ELSE 0 END AS d,
 loan_amount * debt_to_income AS back, CASE WHEN default_probability > 0.5::DOUBLE THEN 1 ELSE 0 END AS par FROM loans)
SELECT sum(d) * 100.0 / count(*) AS default_rate, sum(CASE WHEN d = 1 THEN back ELSE 0 END) * 100 / sum(CASE WHEN d = 1 THEN loan_amount ELSE 0 END) AS recovery_rate,
 sum(par * loan_amount) * 100 / sum(loan_amount) AS portfolio_at_risk, sum(loan_amount) * 100 / sum(annual_income) AS credit_utilization,
 (sum(CASE WHEN d = 1 THEN loan_amount ELSE 0 END) - sum(CASE WHEN d = 1 THEN back ELSE 0 END)) * 100 / sum(CASE WHEN d = 1 THEN loan_amount ELSE 0 END) AS loss_given_default FROM r""",
    "", "default_rate recovery_rate portfolio_at_risk credit_utilization loss_given_default"))
def a34(spark, sf):
    return rounded(P.credit_ratios(
        loans(spark, sf), F.col("loan_amount"), F.when(F.col("status") == "default", 1).otherwise(0),
        F.col("loan_amount") * F.col("debt_to_income"), F.when(F.col("default_probability") > 0.5, 1).otherwise(0),
        F.col("loan_amount"), F.col("annual_income")))


@query("a35_daily_risk_trend", rounded_sql('SELECT CAST(ts AS DATE) AS "day", avg(value) AS mean_value FROM events GROUP BY 1', "day", "mean_value"))
def a35(spark, sf):
    return rounded(P.daily_trend(table(spark, sf, "events"), "ts", "value"))


@query("a36_top_product", rounded_sql(f"""WITH {BOOK}, p AS (SELECT product_type, avg(roi) mean_roi FROM book GROUP BY 1),
t AS (SELECT avg(CASE WHEN risk_category = 'High' THEN 100.0 ELSE 0 END) AS high_risk_pct, avg(roi) * 100 AS portfolio_roi FROM book)
SELECT product_type AS best_product, mean_roi * 100 AS best_roi, high_risk_pct, portfolio_roi,
 CASE WHEN high_risk_pct > 15 THEN 'High Risk Alert' ELSE 'Risk Management' END AS risk_alert, portfolio_roi > 15 AS strong_performance
FROM p, t ORDER BY mean_roi DESC LIMIT 1""", "best_product risk_alert strong_performance", "best_roi high_risk_pct portfolio_roi"))
def a36(spark, sf):
    return rounded(P.top_product(book(spark, sf)))


@query("a37_operation_stats", rounded_sql("""SELECT event_type, count(*) calls, count(*) FILTER (WHERE value < 5) errors, sum(value) total_time,
 avg(value) avg_time, min(value) min_time, max(value) max_time FROM events GROUP BY 1""",
    "event_type calls errors", "total_time avg_time min_time max_time"))
def a37(spark, sf):
    return rounded(P.operation_stats(table(spark, sf, "events"), "event_type", "value", F.col("value") < 5))


@query("a39_ols_trendline", rounded_sql(f"""WITH {LOANS} SELECT risk_category, regr_slope(loan_amount, credit_score) slope,
 regr_intercept(loan_amount, credit_score) intercept, regr_r2(loan_amount, credit_score) r2, count(*) n FROM loans GROUP BY 1""",
    "risk_category n", "slope intercept r2"))
def a39(spark, sf):
    return rounded(P.ols_trendline(loans(spark, sf), "loan_amount", "credit_score", "risk_category"))


@query("a40_density_curve", rounded_sql(f"""WITH {LOANS}, h AS (SELECT risk_category, stddev_samp(interest_rate) * pow(count(*), -0.2) AS h FROM loans GROUP BY 1),
r AS (SELECT min(interest_rate) lo, max(interest_rate) hi FROM loans), g AS (SELECT CAST(i AS INTEGER) AS point, lo + (hi - lo) * i / 49 AS x FROM r, range(50) t(i))
SELECT l.risk_category, point, x, avg(exp(-pow((x - interest_rate) / h, 2) / 2) / h) / sqrt(2 * pi()) AS density
FROM loans l JOIN h ON l.risk_category = h.risk_category, g GROUP BY 1, 2, 3""", "risk_category point", "x density", 6))
def a40(spark, sf):
    return rounded(P.density_curve(loans(spark, sf), "interest_rate", "risk_category"), 6)


@query("a40_normal_curve", rounded_sql(f"""WITH {LOANS}, s AS (SELECT min(interest_rate) lo, max(interest_rate) hi, avg(interest_rate) m, stddev_samp(interest_rate) s, count(*) n FROM loans),
g AS (SELECT *, CAST(i AS INTEGER) AS point, lo + i * ((hi - lo) / 49) AS x FROM s, range(50) t(i))
SELECT point, x, exp(-((x - m) / s) * ((x - m) / s) / 2) / (s * sqrt(2 * pi())) * n * (hi - lo) / 30 AS y FROM g""", "point", "x y"))
def a40n(spark, sf):
    return rounded(P.normal_curve(loans(spark, sf), "interest_rate"))


@query("j02_divide_by_group_total", rounded_sql(f"""WITH {LOANS} SELECT date_trunc('month', origination_date) AS "month", risk_category, count(*) n,
 count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('month', origination_date)) AS share FROM loans GROUP BY 1, 2""", "month risk_category n", "share", 6))
def j02(spark, sf):
    from pyspark.sql import Window as W
    c = loans(spark, sf).groupBy(E.month_of("origination_date").alias("month"), "risk_category").agg(F.count("*").alias("n"))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("month"))), 6)


# --- series over monthly loan volume ------------------------------------------

MONTHLY = LOANS + """, m AS (SELECT date_trunc('month', origination_date) AS period, sum(loan_amount) AS value FROM loans GROUP BY 1)"""


def monthly(spark, sf):
    return S.period_series(loans(spark, sf), "origination_date", F.sum("loan_amount"))


@query("w01_moving_average", rounded_sql(f"""WITH {MONTHLY} SELECT *, CASE WHEN row_number() OVER (ORDER BY period) >= 7 THEN
 avg(value) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS moving_avg FROM m""", "period", "value moving_avg", 2))
def w01(spark, sf):
    return rounded(S.moving_average(monthly(spark, sf), window=7), 2)


_TREND = """CASE WHEN count(*) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) = 12 THEN
 avg(value) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) END"""


@query("w02_centered_trend", rounded_sql(f"WITH {MONTHLY} SELECT *, {_TREND} AS trend FROM m", "period", "value trend"))
def w02(spark, sf):
    return rounded(S.centered_trend(monthly(spark, sf)))


@query("w03_decomposition", rounded_sql(f"""WITH {MONTHLY}, t AS (SELECT *, {_TREND} AS trend FROM m)
SELECT *, value - trend AS seasonal, (value - trend) - (value - trend) AS residual FROM t""", "period", "value trend seasonal residual"))
def w03(spark, sf):
    return rounded(S.decompose(monthly(spark, sf)))


@query("w03_seasonal_means", rounded_sql(f"""WITH {MONTHLY}, t AS (SELECT *, {_TREND} AS trend FROM m),
s AS (SELECT *, avg(value - trend) OVER (PARTITION BY month(period)) AS seasonal FROM t) SELECT *, value - trend - seasonal AS residual FROM s""",
    "period", "value trend seasonal residual", 5))
def w03s(spark, sf):
    return rounded(S.decompose(monthly(spark, sf), seasonal_means=True), 5)


@query("w04_growth_rate", rounded_sql(f"""WITH {MONTHLY} SELECT *, (value - lag(value) OVER (ORDER BY period)) * 100 / lag(value) OVER (ORDER BY period) AS growth_rate FROM m""",
                                      "period", "value growth_rate", 2))
def w04(spark, sf):
    return rounded(S.growth(monthly(spark, sf)), 2)


@query("w05_trend_direction", rounded_sql(f"""WITH {LOANS}, m AS (SELECT product_type, date_trunc('month', origination_date) AS period, sum(loan_amount) AS value FROM loans GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY period) u, row_number() OVER (PARTITION BY product_type ORDER BY period DESC) d FROM m),
g AS (SELECT product_type, avg(value) FILTER (WHERE u <= 3) first_mean, avg(value) FILTER (WHERE d <= 3) last_mean, count(*) n FROM k GROUP BY 1)
SELECT *, CASE WHEN last_mean > first_mean * 1.05 THEN 'increasing' WHEN last_mean < first_mean * 0.95 THEN 'decreasing' ELSE 'stable' END direction FROM g""",
    "product_type n direction", "first_mean last_mean", 2))
def w05(spark, sf):
    m = S.period_series(loans(spark, sf), "origination_date", F.sum("loan_amount"), by=["product_type"])
    return rounded(S.trend_direction(m, by=["product_type"]), 2)


_LINE = """k AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS "position" FROM m)"""


@query("w06_linear_trend", rounded_sql(f"""WITH {MONTHLY}, {_LINE}, f AS (SELECT regr_slope(value, "position") slope, regr_intercept(value, "position") intercept FROM k)
SELECT k.*, slope, intercept, intercept + slope * "position" AS fitted FROM k, f""", "period position", "value slope intercept fitted", 2))
def w06(spark, sf):
    return rounded(S.linear_trend(monthly(spark, sf)).withColumn("position", F.col("position").cast("long")), 2)


@query("w07_linear_forecast", rounded_sql(f"""WITH {MONTHLY}, {_LINE}, f AS (SELECT regr_slope(value, "position") slope, regr_intercept(value, "position") intercept, count(*) n, max(period) last FROM k)
SELECT CAST(h + 1 AS INTEGER) AS step, last_day(CAST(last AS DATE) + to_months(CAST(h + 1 AS INTEGER))) AS "date", intercept + slope * (n + h) AS forecast FROM f, range(6) t(h)""",
    "step date", "forecast", 2))
def w07(spark, sf):
    return rounded(S.linear_forecast(monthly(spark, sf)), 2)


# --- dates and bins -----------------------------------------------------------

@query("m10_period_math", f"""WITH {LOANS} SELECT loan_id, date_trunc('month', origination_date) AS month_start,
 CAST((2001 - year(origination_date)) * 12 + 8 - month(origination_date) AS INTEGER) AS age_months,
 last_day(CAST(origination_date AS DATE) + to_months(loan_term)) AS maturity, strftime(origination_date, '%Y-%m-%d') AS text_date,
 CAST(strftime(origination_date, '%Y-%m-%d') AS TIMESTAMP) AS parsed FROM loans""")
def m10(spark, sf):
    d = F.col("origination_date")
    return loans(spark, sf).select(
        "loan_id", E.month_of(d).alias("month_start"), E.month_difference(F.lit("2001-08-01").cast("date"), d).alias("age_months"),
        E.month_end(d, F.col("loan_term")).alias("maturity"), E.format_datetime(d, "yyyy-MM-dd").alias("text_date"),
        E.parse_timestamp(E.format_datetime(d, "yyyy-MM-dd"), "yyyy-MM-dd").alias("parsed"))


@query("m06_clip", f"WITH {LOANS} SELECT loan_id, greatest(25, least(60, age)) AS age_clipped, greatest(500, least(750, credit_score)) AS score_clipped FROM loans")
def m06(spark, sf):
    return loans(spark, sf).select("loan_id", E.clip("age", 25, 60).alias("age_clipped"), E.clip("credit_score", 500, 750).alias("score_clipped"))


@query("m07_bin_fixed", f"""WITH {APPLICANTS} SELECT age_group, count(*) n FROM (SELECT CASE WHEN age <= 25 THEN '18-25' WHEN age <= 35 THEN '26-35'
 WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55' WHEN age <= 100 THEN '55+' END age_group FROM applicants) GROUP BY 1""")
def m07(spark, sf):
    g = E.bin_fixed("age", [0, 25, 35, 45, 55, 100], ["18-25", "26-35", "36-45", "46-55", "55+"])
    return applicants(spark, sf).groupBy(g.alias("age_group")).agg(F.count("*").alias("n"))


@query("m08_bin_equal_width", f"""WITH {LOANS}, r AS (SELECT min(loan_amount) lo, max(loan_amount) hi FROM loans)
SELECT loan_id, CAST(greatest(1, ceil((loan_amount - lo) / ((hi - lo) / 6))) AS INTEGER) AS bin FROM loans, r""")
def m08(spark, sf):
    df = loans(spark, sf)
    return df.select("loan_id", E.bin_by_edges("loan_amount", E.equal_width_edges(*P.value_range(df, "loan_amount"), 6)).alias("bin"))
