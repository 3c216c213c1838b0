"""Readers and writers for tables, reports and fitted preprocessing state."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.session import ensure_checkpoint_dir


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8", header: bool = True,
             skip_rows: int = 0, max_rows: int | None = None) -> DataFrame:
    """CSV with an explicit schema; fields that do not parse become null.

    ``skip_rows`` drops that many leading lines of every file (before the
    header). Lines are ranked per file by block and position; the rank filter is
    a map-side group limit, so only the skipped lines themselves are moved.
    """
    if not skip_rows:
        df = (spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", header)
              .option("mode", "PERMISSIVE").csv(path))
    else:
        lines = spark.read.option("encoding", encoding).text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"))
        first = W.partitionBy("file").orderBy("block", "line")
        drop = lines.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= skip_rows + int(header)).select("line")
        rest = lines.join(drop, "line", "left_anti").where(F.length("value") > 0)
        df = rest.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return df if max_rows is None else df.limit(max_rows)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """JSON records: one document with an array, or one record per line with ``multi_line=False`` (splittable)."""
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema else r).json(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """A saved processed table; a clear error when it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no processed data at {path}") from e


def sql_source(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Mapping | None = None) -> DataFrame:
    """User SQL over named tables, with bound parameters."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=dict(args or {}))


def jdbc_source(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Table of a database read in ``partitions`` parallel key ranges (needs the driver on the class path)."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Snappy parquet, one folder per value of the partition columns."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def report_json(**parts: DataFrame) -> DataFrame:
    """One JSON document per report part from small result tables (name, body)."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("body")).select(F.lit(name).alias("name"), "body")
        out = row if out is None else out.unionByName(row)
    return out


def save_prep_config(spark: SparkSession, params: Mapping[str, Mapping[str, float]], path: str) -> None:
    """Fitted statistics as rows (step, column, value)."""
    rows = [(step, c, float(v)) for step, values in params.items() for c, v in values.items()]
    spark.createDataFrame(rows, "step string, column string, value double").write.mode("overwrite").parquet(path)


def load_prep_config(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in spark.read.parquet(path).collect():  # one row per fitted column
        out.setdefault(r["step"], {})[r["column"]] = r["value"]
    return out


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several jobs read to the shared folder and read it back.

    Unlike a cached table it survives lost executors without recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
