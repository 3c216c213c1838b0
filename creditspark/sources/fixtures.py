"""Credit-shaped views over the star-schema test tables.

Every view is plain arithmetic on keys, so the SQL texts next to the plans give
the same rows. ``nation`` and ``region`` have a fixed size (25 and 5 rows) and
are broadcast; the other joins are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAY_COLS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILL_COLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAID_COLS = [f"PAY_AMT{i}" for i in range(1, 7)]
PANEL_FEATURES = ["LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", *PAY_COLS, *BILL_COLS, *PAID_COLS]


# Column types of the test tables, so that reading needs no inference job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order in the shape of a loan book."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    return table(spark, sf_dir, "orders").join(customer, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey AS loan_id",
        "o_custkey AS customer_id",
        "o_totalprice AS loan_amount",
        "o_orderdate AS origination_date",
        "c_mktsegment AS product_type",
        "r_name AS region",
        "substr(o_orderpriority, 3) AS acquisition_channel",
        "CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'High' WHEN o_orderpriority LIKE '5%' THEN 'Low' ELSE 'Medium' END AS risk_category",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'default' ELSE 'current' END AS status",
        "CAST(3 + o_orderkey % 16 AS DOUBLE) AS interest_rate",
        "CAST(12 * (1 + o_orderkey % 5) AS INT) AS loan_term",
        "CAST(300 + (o_custkey * 37) % 551 AS INT) AS credit_score",
        "CAST(20000 + (o_custkey * 7919) % 130001 AS DOUBLE) AS annual_income",
        "CAST(20 + o_orderkey % 180 AS DOUBLE) AS acquisition_cost",
        "CAST(500 + (o_custkey * 104729) % 20000 AS DOUBLE) AS customer_lifetime_value",
        "((o_orderkey * 31) % 1000) / 1000.0D AS default_probability",
        "((o_custkey * 13) % 90) / 100.0D AS debt_to_income",
        "CAST(o_custkey % 40 AS INT) AS employment_length",
        "CAST(18 + o_custkey % 63 AS INT) AS age",
    )


LOANS = """loans AS (
SELECT o_orderkey AS loan_id, o_custkey AS customer_id, o_totalprice AS loan_amount,
 o_orderdate AS origination_date, c_mktsegment AS product_type, r_name AS region,
 substr(o_orderpriority, 3) AS acquisition_channel,
 CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'High'
      WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'Low' ELSE 'Medium' END AS risk_category,
 CASE WHEN o_orderkey % 11 = 0 THEN 'default' ELSE 'current' END AS status,
 CAST(3 + o_orderkey % 16 AS DOUBLE) AS interest_rate,
 CAST(12 * (1 + o_orderkey % 5) AS INTEGER) AS loan_term,
 CAST(300 + (o_custkey * 37) % 551 AS INTEGER) AS credit_score,
 CAST(20000 + (o_custkey * 7919) % 130001 AS DOUBLE) AS annual_income,
 CAST(20 + o_orderkey % 180 AS DOUBLE) AS acquisition_cost,
 CAST(500 + (o_custkey * 104729) % 20000 AS DOUBLE) AS customer_lifetime_value,
 ((o_orderkey * 31) % 1000) / 1000.0::DOUBLE AS default_probability,
 ((o_custkey * 13) % 90) / 100.0::DOUBLE AS debt_to_income,
 CAST(o_custkey % 40 AS INTEGER) AS employment_length,
 CAST(18 + o_custkey % 63 AS INTEGER) AS age
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def credit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six latest orders per customer side by side, in the card-client shape.

    ``row_number <= 6`` becomes a map-side group limit, so a customer with very
    many orders sends at most six rows per input task through the shuffle. The
    pivot groups by the window's key and needs no shuffle of its own.
    """
    recent = table(spark, sf_dir, "orders").selectExpr(
        "*", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn").where("rn <= 6").selectExpr(
        "o_custkey", "o_orderkey", "o_totalprice", "rn",
        "CAST(CASE left(o_orderpriority, 1) WHEN '5' THEN -2 WHEN '4' THEN -1 WHEN '3' THEN 0 WHEN '2' THEN 1 + o_orderkey % 2 ELSE 2 + o_orderkey % 7 END AS INT) AS pay")
    paid = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("round(sum(l_extendedprice * (1 - l_discount)), 4) AS amt"))
    rows = recent.join(paid, F.expr("o_orderkey = l_orderkey"), "left")
    sides = [(PAY_COLS, "pay"), (BILL_COLS, "o_totalprice"), (PAID_COLS, "amt")]
    at = [f"max(CASE WHEN rn = {i + 1} THEN {c} END) AS {cols[i]}" for cols, c in sides for i in range(6)]
    wide = rows.groupBy("o_custkey").agg(F.expr("count(1) AS n"), *[F.expr(a) for a in at]).where("n = 6")
    late = " + ".join(f"IF({c} > 0, 1, 0)" for c in PAY_COLS)
    return wide.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "c_custkey AS ID", "100000 + 100 * c_acctbal AS LIMIT_BAL", "CAST(1 + c_custkey % 2 AS INT) AS SEX",
        "CAST(1 + c_custkey % 4 AS INT) AS EDUCATION", "CAST(1 + c_custkey % 3 AS INT) AS MARRIAGE", "CAST(20 + c_custkey % 60 AS INT) AS AGE",
        *PAY_COLS, *BILL_COLS, *[f"coalesce({c}, 0.0D) AS {c}" for c in PAID_COLS], f"CASE WHEN {late} >= 4 THEN 1 ELSE 0 END AS target")


def _panel_sql() -> str:
    def at(i, c):
        return f"max(CASE WHEN rn = {i} THEN {c} END)"

    pay = ", ".join(f'{at(i + 1, "pay")} AS "{c}"' for i, c in enumerate(PAY_COLS))
    bill = ", ".join(f'{at(i + 1, "o_totalprice")} AS "{c}"' for i, c in enumerate(BILL_COLS))
    paid = ", ".join(f'coalesce({at(i + 1, "amt")}, 0.0::DOUBLE) AS "{c}"' for i, c in enumerate(PAID_COLS))
    late = " + ".join(f'(CASE WHEN "{c}" > 0 THEN 1 ELSE 0 END)' for c in PAY_COLS)
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
paid AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS amt FROM lineitem GROUP BY l_orderkey),
recent AS (SELECT o_custkey, rn, o_totalprice, amt,
 CAST(CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN -2 WHEN '4' THEN -1 WHEN '3' THEN 0
  WHEN '2' THEN 1 + o_orderkey % 2 ELSE 2 + o_orderkey % 7 END AS INTEGER) AS pay
 FROM ranked LEFT JOIN paid ON l_orderkey = o_orderkey WHERE rn <= 6),
wide AS (SELECT o_custkey, {pay}, {bill}, {paid} FROM recent GROUP BY o_custkey HAVING count(*) = 6),
panel AS (SELECT c_custkey AS "ID", 100000 + 100 * c_acctbal AS "LIMIT_BAL",
 CAST(1 + c_custkey % 2 AS INTEGER) AS "SEX", CAST(1 + c_custkey % 4 AS INTEGER) AS "EDUCATION",
 CAST(1 + c_custkey % 3 AS INTEGER) AS "MARRIAGE", CAST(20 + c_custkey % 60 AS INTEGER) AS "AGE",
 {", ".join(f'"{c}"' for c in [*PAY_COLS, *BILL_COLS, *PAID_COLS])},
 CASE WHEN {late} >= 4 THEN 1 ELSE 0 END AS target
 FROM wide JOIN customer ON o_custkey = c_custkey)"""


PANEL = _panel_sql()


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in the shape of a loan application."""
    race = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RACES))
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id",
        "CAST(18 + c_custkey % 63 AS INT) AS age",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex",
        f"CASE c_custkey % {len(RACES)} {race} END AS race",
        "CASE WHEN c_custkey % 7 = 0 THEN 'Hispanic' ELSE 'Non-Hispanic' END AS ethnicity",
        "CAST(20000 + (c_custkey * 7919) % 130001 AS DOUBLE) AS annual_income",
        "CAST(1000 + (c_custkey * 53) % 7000 AS DOUBLE) AS monthly_expenses",
        "CAST((c_custkey * 97) % 100000 AS DOUBLE) AS existing_debt",
        "CAST(c_custkey % 30 AS INT) AS credit_history_length",
        "CAST(c_custkey % 3 AS INT) AS previous_defaults",
        "CAST((c_custkey * 41) % 100 AS INT) AS credit_utilization",
        "CAST(300 + (c_custkey * 37) % 551 AS INT) AS credit_score",
        "((c_custkey * 13) % 90) / 100.0D AS debt_to_income_ratio",
        "CAST(c_custkey % 40 AS DOUBLE) AS employment_length",
        "CAST(1000 + (c_custkey * 611) % 400000 AS DOUBLE) AS loan_amount",
        "CASE c_custkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'auto' ELSE 'personal' END AS loan_purpose",
        "CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS defaulted",
        "CASE WHEN (c_custkey * 37) % 551 > 250 THEN 1 ELSE 0 END AS loan_approved",
        "CASE WHEN (c_custkey * 37) % 551 + c_custkey % 40 > 255 THEN 1 ELSE 0 END AS predicted_approval",
    )


# Group names of the fair-lending fixture.
RACES = ["White", "Black", "Asian", "Other"]

APPLICANTS = """applicants AS (
SELECT c_custkey AS customer_id, CAST(18 + c_custkey % 63 AS INTEGER) AS age,
 CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
 CASE c_custkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Asian' ELSE 'Other' END AS race,
 CASE WHEN c_custkey % 7 = 0 THEN 'Hispanic' ELSE 'Non-Hispanic' END AS ethnicity,
 CAST(20000 + (c_custkey * 7919) % 130001 AS DOUBLE) AS annual_income,
 CAST(1000 + (c_custkey * 53) % 7000 AS DOUBLE) AS monthly_expenses,
 CAST((c_custkey * 97) % 100000 AS DOUBLE) AS existing_debt,
 CAST(c_custkey % 30 AS INTEGER) AS credit_history_length, CAST(c_custkey % 3 AS INTEGER) AS previous_defaults,
 CAST((c_custkey * 41) % 100 AS INTEGER) AS credit_utilization,
 CAST(300 + (c_custkey * 37) % 551 AS INTEGER) AS credit_score,
 ((c_custkey * 13) % 90) / 100.0::DOUBLE AS debt_to_income_ratio,
 CAST(c_custkey % 40 AS DOUBLE) AS employment_length,
 CAST(1000 + (c_custkey * 611) % 400000 AS DOUBLE) AS loan_amount,
 CASE c_custkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'auto' ELSE 'personal' END AS loan_purpose,
 CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS defaulted,
 CASE WHEN (c_custkey * 37) % 551 > 250 THEN 1 ELSE 0 END AS loan_approved,
 CASE WHEN (c_custkey * 37) % 551 + c_custkey % 40 > 255 THEN 1 ELSE 0 END AS predicted_approval
FROM customer)"""


def applicants_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants with missing numbers, missing text and repeated rows."""
    k = F.col("customer_id")
    base = applicants(spark, sf_dir).select(
        "customer_id",
        F.when(k % 17 != 0, F.col("age")).alias("age"),
        F.when(k % 13 != 0, F.col("annual_income")).alias("annual_income"),
        F.when(k % 19 != 0, F.col("credit_score")).alias("credit_score"),
        F.when(k % 23 != 0, F.col("loan_purpose")).alias("loan_purpose"),
        F.when(k % 3 == 0, F.col("existing_debt")).alias("existing_debt"),
        "defaulted")
    return base.unionByName(base.where(k % 50 == 0))


GAPS = APPLICANTS + """, gaps0 AS (
SELECT customer_id, CASE WHEN customer_id % 17 <> 0 THEN age END AS age,
 CASE WHEN customer_id % 13 <> 0 THEN annual_income END AS annual_income,
 CASE WHEN customer_id % 19 <> 0 THEN credit_score END AS credit_score,
 CASE WHEN customer_id % 23 <> 0 THEN loan_purpose END AS loan_purpose,
 CASE WHEN customer_id % 3 = 0 THEN existing_debt END AS existing_debt, defaulted FROM applicants),
gaps AS (SELECT * FROM gaps0 UNION ALL SELECT * FROM gaps0 WHERE customer_id % 50 = 0)"""
