"""Schemas, code labels and value rules of the known tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAY_STATUS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAYMENTS = [f"PAY_AMT{i}" for i in range(1, 7)]
TARGET = "default.payment.next.month"

CARD_CLIENTS = T.StructType(
    [T.StructField("ID", T.LongType()), T.StructField("LIMIT_BAL", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ["SEX", "EDUCATION", "MARRIAGE", "AGE", *PAY_STATUS]]
    + [T.StructField(c, T.DoubleType()) for c in [*BILLS, *PAYMENTS]]
    + [T.StructField(TARGET, T.IntegerType())])

LOAN_APPLICATIONS = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("age", T.IntegerType()),
    T.StructField("income", T.DoubleType()), T.StructField("credit_score", T.IntegerType()),
    T.StructField("debt_to_income_ratio", T.DoubleType()), T.StructField("employment_length", T.DoubleType()),
    T.StructField("loan_amount", T.DoubleType()), T.StructField("loan_purpose", T.StringType())])

BATCH_APPLICANTS = T.StructType([
    T.StructField("age", T.IntegerType()), T.StructField("gender", T.StringType()),
    T.StructField("education", T.StringType()), T.StructField("marital_status", T.StringType()),
    T.StructField("employment_status", T.StringType()), T.StructField("annual_income", T.LongType()),
    T.StructField("monthly_expenses", T.LongType()), T.StructField("existing_debt", T.LongType()),
    T.StructField("credit_history_length", T.IntegerType()), T.StructField("previous_defaults", T.IntegerType()),
    T.StructField("credit_utilization", T.IntegerType())])

# Code labels of the card-client table.
CODE_LABELS = {
    "SEX": {1: "Male", 2: "Female"},
    "EDUCATION": {1: "Graduate School", 2: "University", 3: "High School", 4: "Others", 5: "Unknown", 6: "Unknown"},
    "MARRIAGE": {0: "Others", 1: "Married", 2: "Single", 3: "Others"},
    "PAY": {-2: "No consumption", -1: "Paid in full", 0: "Use of revolving credit", 1: "Payment delay for 1 month",
            **{m: f"Payment delay for {m} months" for m in range(2, 9)}, 9: "Payment delay for 9+ months"},
}

# Allowed range per column of a loan application.
VALUE_RANGES = {
    "age": (18, 100),
    "income": (0, 1000000),
    "credit_score": (300, 850),
    "debt_to_income_ratio": (0, 1),
    "employment_length": (0, 50),
    "loan_amount": (1000, 500000),
}

# Texts and numbers that stand for a missing value.
MISSING_MARKERS = [-999, -9999, "NULL", "null", "N/A", "n/a", ""]

# Column names treated as personal data.
PII_COLUMNS = ["ssn", "social_security", "phone", "email", "address"]
