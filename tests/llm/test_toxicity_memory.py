"""The toxicity fit gives the driver the telling features of its sample, not all of them."""

import gc
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("creditspark.llm")

from creditspark.llm import toxicity_ordinal as t

DOCS, WORDS = 800, 2500


def test_the_driver_gets_little_of_a_large_sample(spark):
    word = "translate(CAST(pmod(xxhash64(id, i), 200000) AS STRING), '0123456789', 'abcdefghij')"
    docs = spark.range(0, DOCS, 1, 4).select(F.col("id").alias("doc_id"), F.expr(
        f"concat_ws(' ', transform(sequence(1, {WORDS}), i -> {word}), IF(id % 4 = 0, repeat('vile ', CAST(id % 7 + 1 AS INT)), 'kind'))").alias("text"))
    labels = docs.select("doc_id", F.expr("IF(doc_id % 4 = 0, 1, 0)").alias("toxic"))
    gc.collect()
    tracemalloc.start()
    model = t.fit_toxicity(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * DOCS * WORDS  # three columns of 8 bytes for each feature of each row
    told = {w: t.features(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([4]))[1][0] for w in ("vile", "kind")}
    assert model.weights[told["vile"]] > 0 > model.weights[told["kind"]]


def test_counts_and_telling_rows_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + i) for i in w) for w in rng.integers(0, 26, (300, 8))]
    rows = [(i, " ".join(rng.choice(words[:200] if i % 3 else words[100:], rng.integers(1, 60))), i % 3 == 0) for i in range(600)]
    rows += [(600, None, True), (601, "", False), (602, "0 1", False), (5, "repeated id " + words[0], False), (603, words[250] * 50, True)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    sample = t.labelled_sample(docs, labels)
    byrow = []  # each row by itself
    for doc_id, text, toxic in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, feature, counts = t.features(raw, np.array([0]), np.array([len(raw)]))
        byrow.append((doc_id, int(toxic), dict(zip(feature.tolist(), counts.tolist()))))
    want = np.zeros((2, 1 << t.BITS), np.int64)
    for _, toxic, found in byrow:
        want[1 - toxic, list(found)] += 1
    bad, good = t.class_counts(sample)
    assert np.array_equal(bad, want[0]) and np.array_equal(good, want[1])
    n = sum(r[1] for r in byrow)
    told, typical = t.telling_features(bad, good, n, len(rows) - n), t.typical_features(bad, good, n, len(rows) - n)
    used = np.flatnonzero(told)
    assert 50 < len(used) < np.count_nonzero(bad + good) and typical.any()
    monkeypatch.setattr(t, "ROWS", 7)
    got = sorted((r.doc_id, r.toxic, r.strength, [(int(used[p]), c) for p, c in zip(r.places, r.counts)]) for r in t.telling_rows(sample, told, typical).collect())
    assert got == sorted((d, toxic, sum(c for f, c in found.items() if typical[f]), sorted((f, c) for f, c in found.items() if told[f])) for d, toxic, found in byrow)
    whole = t.fit_toxicity(docs, labels)
    monkeypatch.setattr(t, "CHUNK", 50)  # several parts, some rows longer than one
    parts = t.fit_toxicity(docs, labels)
    assert np.array_equal(whole.weights, parts.weights) and np.array_equal(whole.thresholds, parts.thresholds)
    assert np.count_nonzero(whole.weights) == len(used)
