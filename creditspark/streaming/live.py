"""Structured Streaming: scoring of arriving rows, live indicators, drift per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from creditspark.operators.selection import bucket_counts, psi_edges, psi_from_counts
from creditspark.sources.io import materialize


def read_stream(spark: SparkSession, path: str, schema: T.StructType, file_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def stream_scoring(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving rows with a batch function and append them to parquet, exactly once."""
    return (score(rows).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def live_kpis(rows: DataFrame, time: str, value: str, error: Column, by: str | None = None, window: str = "1 hour",
              lateness: str = "10 minutes") -> DataFrame:
    """Throughput, mean value and error share per tumbling window; rows later than the watermark are dropped."""
    keys = [F.window(time, window)] + ([F.col(by)] if by else [])
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    agg = rows.withWatermark(time, lateness).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.avg(F.when(error, 1.0).otherwise(0.0)).alias("error_share"))
    return agg.select(F.col("window.start").alias("window_start"), *([by] if by else []), "n", "mean_value", "error_share")


def start_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a streaming result; complete results replace the folder batch by batch."""
    if mode == "append":
        return (df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()


def drift_monitor(rows: DataFrame, baseline: DataFrame, cols: list[str], out: str, checkpoint: str, alert_above: float = 0.1) -> StreamingQuery:
    """PSI of every micro-batch against a baseline table, one row per (batch, feature).

    Each batch overwrites its own folder, so a repeated batch does not double.
    """
    edges = psi_edges(baseline, cols)
    expected = materialize(bucket_counts(baseline, edges, 10), "baseline")  # features times buckets rows

    def check(batch: DataFrame, batch_id: int) -> None:
        psi_from_counts(expected, bucket_counts(batch, edges, 10), alert_above).withColumnRenamed("unstable", "alert").write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check).trigger(availableNow=True).start()
