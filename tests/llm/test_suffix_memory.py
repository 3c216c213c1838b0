"""Tasks of the suffix deduplication have even buckets and bounded work; common anchors are dealt by their windows."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("creditspark.llm")

from test_llm import removals  # noqa: E402

from creditspark.llm import suffix_dedup  # noqa: E402

LINE = "This passage is printed at the foot of each page of the report by the office."
SCHEMA = "doc_id long, text string"


def _words(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(n))


def _rows(documents=60):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(documents):
        text = f"{_words(rng, 20)}. {LINE} {_words(rng, 15)}"
        if d % 3 == 0:  # a part of the line only, twice
            text += f" {LINE[10:65]}{_words(rng, 4)} {LINE[8:70]}"
        rows.append((1000 - d if d % 2 else d, text))
    dashes = [(7000 + i, "-" * (120 + i)) for i in range(5)]
    return [*rows, rows[5], (rows[7][0], rows[8][1]), *dashes, (None, LINE), (9000, None), (9001, ""), (9002, "short")]


def test_buckets_of_anchors_are_even(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, _words(rng, 1500)) for i in range(60)], SCHEMA).withColumn("h", F.xxhash64("text"))
    rows = suffix_dedup._anchor_blocks(docs, 64, 50).where("substring(payload, 1, 1) = X'54'").groupBy("bucket").agg(F.sum(F.length("payload")).alias("n")).collect()
    assert len(rows) == 64
    assert max(r.n for r in rows) < 2 * np.mean([r.n for r in rows])  # anchors have the smallest hashes of their windows


def _suffixes(n, seed):
    """Batches of suffixes of one anchor with different surroundings, and the documents and windows."""
    rng = np.random.default_rng(seed)
    heads = np.zeros(n, suffix_dedup.SUFFIX_HEAD)
    heads["doc"], heads["h"] = np.arange(n), np.arange(n)
    heads["n"], heads["off"] = 17, 20
    sides = rng.choice(np.frombuffer(b"abcd", np.uint8), (max(1, n // 3), 66))
    text = sides[rng.integers(0, len(sides), n)]  # about three suffixes are equal
    text[::2, -4:] = rng.choice(np.frombuffer(b"xyz", np.uint8), (len(text[::2]), 4))  # or equal but for the end
    text[:, 20:38] = np.frombuffer(b" the common anchor", np.uint8)
    for i in range(0, n, 5000):
        part = heads[i:i + 5000]
        yield part, text[i:i + 5000], pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([text[i:i + 5000].tobytes()], pa.binary())],
                                                                 names=["bucket", "heads", "bytes"])


def _found(batches):
    out = {}
    for b in suffix_dedup._compared(50)(batches):
        for doc, hits in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            hits = np.frombuffer(hits, suffix_dedup.HIT)
            out[doc] = int(np.bitwise_or.reduce(hits["mask"]))
    return out


def _wanted(made):
    first, out = {}, defaultdict(int)
    for heads, text, _ in made:
        for doc, t in zip(heads["doc"].tolist(), text):
            t = t.tobytes()
            for i in range(17):
                if first.setdefault((i, t[i:i + 50]), doc) < doc:
                    out[doc] |= 1 << i
    return out


@pytest.mark.parametrize("windows", [300, 5000, 200_000])
def test_one_anchor_is_compared_in_parts(monkeypatch, windows):
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows, raising=False)
    made = list(_suffixes(900, 1))
    assert _found(m[2] for m in made) == _wanted(made)


def test_comparing_a_common_anchor_takes_bounded_memory():
    batches = [m[2] for m in _suffixes(90_000, 2)]
    size = sum(b.nbytes for b in batches)
    tracemalloc.start()
    found = _found(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 40_000
    assert peak < 10 * size + 60e6, f"{peak / 1e6:.0f} MB for a bucket of {size / 1e6:.0f} MB"


def test_classifying_in_ranges_finds_the_same_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([r for r in _rows() if r[0] is not None], SCHEMA).withColumn("h", F.xxhash64("text")).repartition(7, "doc_id")
    rows = suffix_dedup._anchor_blocks(docs, 1, 50).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.bucket for r in rows], pa.int32()), pa.array([r.block for r in rows]), pa.array([bytes(r.payload) for r in rows], pa.binary())],
                                       names=["bucket", "block", "payload"])

    def kinds():
        out = defaultdict(Counter)
        for b in suffix_dedup._classified()([batch]):
            for block, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p[:1] == b"M":
                    out["M"][block] += 1
                    continue
                k = (len(p) - 1) // (2 + suffix_dedup.WANTED.itemsize)
                owner, w = np.frombuffer(p, np.uint16, k, 1).tolist(), np.frombuffer(p, suffix_dedup.WANTED, k, 1 + 2 * k).tolist()
                out[p[:1].decode()].update((block, o, *x) for o, x in zip(owner, w))
        return out

    whole = kinds()
    for size in (100, 2000):
        monkeypatch.setattr(suffix_dedup, "RANGE", size)
        parts = kinds()
        assert parts["F"] == whole["F"] and parts["M"] == whole["M"] and whole["F"] and whole["C"]
        assert not whole["C"] - parts["C"]


@pytest.mark.parametrize("hot", [-1, 1 << 40])
def test_common_anchors_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot, raising=False)
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if hot < 0:
        assert len(suffix_dedup.sampled(docs, 8, 50).hot) > 3
    got = suffix_dedup.remove_repeats(docs).withColumn("s", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "s").collect()
    assert Counter(map(tuple, got)) == removals(rows)


def test_buckets_follow_the_size_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 2000)
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    shown = suffix_dedup.sampled(docs, 2, 50)
    assert shown.text_bytes == pytest.approx(sum(len((t or "").encode()) for _, t in rows), rel=0.01)
    assert len(shown.splitters) > 5
    assert list(shown.splitters) == sorted(set(shown.splitters))
    got = suffix_dedup.remove_repeats(docs).withColumn("s", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "s").collect()
    assert Counter(map(tuple, got)) == removals(rows)
