"""Weighted rendezvous hashing of stable keys over shards, with gapless places inside each shard.

Each (record key, shard) pair gets a pseudo-random number in (0, 1]; the shard with
the smallest ``-ln(u) / weight`` takes the record. A new shard can only win
records for itself, so growing moves few records. Everything is a DataFrame
expression; only narrow columns are shuffled.

Defined results: a null key hashes as the empty text; a null text has no bytes (size
16, checksum 0); rows with the same key stay together; equal rows share a shard and
get different slots (which of them gets which slot shows nowhere). An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.llm.registry import query, table

PRIME = 2147483647  # 2**31 - 1
SLOT_BITS = 12  # a shard's rows are numbered in 2**12 key-hash buckets


def shard_constants(shard: int) -> tuple[int, int, int, int]:
    """Coefficients of a shard's hash function, from its number alone."""
    digest = hashlib.md5(f"shard {shard}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") % PRIME for i in (0, 4, 8, 12))


def key_hash(key: Column, first: int, digits: int) -> Column:
    """``digits`` hexadecimal digits of the key's MD5 as a number."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def shard_scores(weights: Sequence[float]) -> Column:
    """Array of (score, shard) for the key hashes ``_k1`` and ``_k2``; the smallest wins, ties by shard number."""
    rows = ", ".join("named_struct('a', {}L, 'b', {}L, 'c', {}L, 'd', {}L, 'w', {!r}D, 'j', {})".format(*shard_constants(j), float(w), j)
                     for j, w in enumerate(weights))
    v = f"(_k1 * s.a + _k2 * s.b + s.c) % {PRIME}L"
    u = f"(({v}) * (({v}) + s.d) % {PRIME}L + 1) / {float(PRIME)!r}D"
    return F.expr(f"transform(array({rows}), s -> named_struct('score', -ln({u}) / s.w, 'j', s.j))")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` for the longer list of weights, to each row.

    ``grown_weights`` must begin with ``weights``.
    """
    n = len(weights)
    longest = list(grown_weights or weights)
    if longest[:n] != list(weights):
        raise ValueError("the grown list of shards must begin with the present one")
    hashed = df.withColumns({"_k1": key_hash(F.col(key), 1, 7), "_k2": key_hash(F.col(key), 8, 7), "_order": key_hash(F.col(key), 15, 12)})
    scored = hashed.withColumn("_scores", shard_scores(longest))
    return scored.withColumns({
        "shard": F.array_min(F.slice("_scores", 1, n))["j"], "grown_shard": F.array_min("_scores")["j"]}).drop("_k1", "_k2", "_scores")


def number_slots(df: DataFrame, by: str, ties: Sequence[str]) -> DataFrame:
    """Add ``slot``: a gapless number from 0 inside each shard, in key-hash order.

    Rows are numbered inside (shard, leading hash bits) and shifted by the counts of
    the buckets before, so no task orders a whole shard.
    """
    rows = df.withColumn("_bucket", F.shiftright("_order", 48 - SLOT_BITS))
    counts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(by).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(by, "_bucket").orderBy("_order", *ties)
    return (rows.withColumn("_r", F.row_number().over(inside) - 1)
            .join(offsets, (F.col(by) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("slot", (F.col("_r") + F.col("_before")).cast("long"))
            .drop("_bucket", "_order", "_r", "_s", "_b", "_before"))


SHARDS = 40

_ROWS = ", ".join("({}, {}, {}, {}, {})".format(j, *shard_constants(j)) for j in range(SHARDS + 1))
ORACLE_SQL = f"""
WITH shards(j, a, b, c, d) AS (VALUES {_ROWS}),
digits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i) q),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
crc AS (
  SELECT rid, doc_id, bytes, m,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(bytes), lambda k: CAST('0x' || substr(hx, 2 * k + 1, 2) AS BIGINT))),
      lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) AS text_crc32
  FROM docs, digits),
keys AS (
  SELECT *, CAST('0x' || substr(m, 1, 7) AS BIGINT) AS k1, CAST('0x' || substr(m, 8, 7) AS BIGINT) AS k2, CAST('0x' || substr(m, 15, 12) AS BIGINT) AS o FROM crc),
scored AS (
  SELECT rid, j, -ln(((v * (v + d)) % {PRIME} + 1) / CAST({PRIME} AS DOUBLE)) AS score
  FROM (SELECT rid, j, d, (k1 * a + k2 * b + c) % {PRIME} AS v FROM keys, shards) q),
best AS (
  SELECT rid, arg_min(j, score) FILTER (WHERE j < {SHARDS}) AS shard, arg_min(j, score) AS grown_shard FROM scored GROUP BY rid)
SELECT doc_id, bytes + 16 AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, bytes) - 1 AS slot, grown_shard
FROM keys JOIN best USING (rid)"""


@query("op5_rendezvous_sharding", ORACLE_SQL)
def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards by key, with the shard that each would have among 41."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    placed = number_slots(assign_shards(docs, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1)), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.col("grown_shard").cast("int").alias("grown_shard"))
