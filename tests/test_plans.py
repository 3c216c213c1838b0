"""Registry, entry point, streams and the shape of the plans."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditspark.plans import ORACLES, QUERIES
from creditspark.sources import io as sources
from creditspark.sources.fixtures import TABLES, credit_panel, loans, table
from creditspark.streaming import live


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 190 and len(ORACLES) > 160


@pytest.mark.parametrize("name", ["a01_portfolio_kpis", "f05_validate_frame", "l05_fairness_report", "v10_compare_models", "z02_live_kpis"])
def test_queries_run_on_the_small_scale(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_declared_types_are_those_of_the_files(spark, sf):
    for name in TABLES:
        assert table(spark, sf, name).schema.simpleString() == spark.read.parquet(f"{sf}/{name}.parquet").schema.simpleString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(table(spark, sf, "lineitem").where("l_quantity > 10").select("l_orderkey"))
    assert "GreaterThan(l_quantity,10.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_latest_orders_are_limited_before_the_shuffle(spark, sf):
    p = plan(credit_panel(spark, sf))
    assert p.count("WindowGroupLimit") >= 2


def test_kpis_need_one_final_exchange(spark, sf):
    from creditspark.operators.portfolio import by_product

    p = plan(by_product(loans(spark, sf)))
    assert "partial_sum" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_csv_skip_rows_per_file(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_text(f"junk {i}\nmore, junk\na;b\n{i};x\n{i + 10};y\n")
    schema = spark.createDataFrame([], "a int, b string").schema
    got = sources.scan_csv(spark, str(tmp_path), schema, sep=";", skip_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "x"), (1, "x"), (10, "y"), (11, "y")]


def test_processed_data_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.load_processed(spark, str(tmp_path / "none"))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    schema = "ts timestamp, value double"

    def add(i, *rows):
        spark.createDataFrame(list(rows), "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src / f"p{i}"))

    def run():
        rows = live.read_stream(spark, str(src / "*"), spark.createDataFrame([], schema).schema)
        q = live.start_table(live.live_kpis(rows, "ts", "value", F.lit(False)), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()

    add(1, ("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 1.0))
    run()
    add(2, ("2024-01-01 00:20:00", 100.0), ("2024-01-01 09:00:00", 1.0))  # the first row is hours late
    run()
    got = {str(r["window_start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == 1
