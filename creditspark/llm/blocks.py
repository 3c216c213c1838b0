"""Moving many small (key, owner) records between tasks as packed byte blocks.

A mapper cuts its records into one block per bucket of the key's leading bits; the blocks
are shuffled as a few binary rows. Receivers join the blocks of their partition
with numpy. This keeps a record at a few bytes and costs no row object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.flat import U


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def even_labels(df: DataFrame, buckets: int) -> np.ndarray:
    """One label per bucket such that hash partitioning by label gives every task one bucket."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets))
    ids = df.sparkSession.range(buckets * (20 + buckets.bit_length()), numPartitions=1)
    found = {r["p"]: r["b"] for r in ids.groupBy(part.alias("p")).agg(F.min("id").alias("b")).collect()}  # one row per bucket
    spare = iter(range(-1, -buckets - 1, -1))
    return np.array([found[p] if p in found else next(spare) for p in range(buckets)], np.int32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of the key; keys are evenly spread hashes."""
    return (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)


def cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by bucket, and where each bucket begins in it."""
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def packed(records: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of a structured array with a field ``key``."""
    order, at = cut(records["key"], buckets)
    sorted_records = records[order]
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield b, sorted_records[at[b]:at[b + 1]].tobytes()


def block_batch(pairs: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """All records of a partition."""
    parts = [np.frombuffer(p, kind) for batch in batches for p in batch.column(1).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def exchanged(blocks: DataFrame, buckets: int) -> DataFrame:
    return blocks.repartition(buckets, F.col("bucket"))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))
