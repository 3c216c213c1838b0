"""Counting a bucket of shingles takes little more memory than the bucket."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("creditspark.llm")

from creditspark.llm import jaccard_join

BLOCKS, DOCS, PER_DOC = 60, 100, 300


def _payloads():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, 60_000, dtype=np.uint64)
    for block in range(BLOCKS):
        keys = rng.integers(1, 1 << 62, DOCS * PER_DOC, dtype=np.uint64)
        common = rng.random(len(keys)) < 0.2
        keys[common] = rng.choice(pool, common.sum())
        owner = np.repeat(np.arange(DOCS, dtype=np.uint16), PER_DOC)
        keys, first = np.unique(keys, return_index=True)  # ordered, as senders cut them
        f1 = rng.integers(0, 1 << 60, DOCS, dtype=np.uint64)
        if block % 10 == 9:
            f1[:] = 7  # equal sets in several blocks
        head = np.array([len(keys), DOCS], np.int64).tobytes()
        yield block, keys, owner[first], f1, b"T" + head + np.arange(DOCS, dtype=np.uint16).tobytes() + f1.tobytes() + owner[first].tobytes() + keys.tobytes()


def _batches(rows):
    for i in range(0, len(rows), 10):
        part = rows[i:i + 10]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(part), pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())],
                                         names=["bucket", "block", "payload"])


def test_counting_takes_little_more_than_the_bucket():
    made = list(_payloads())
    lists = [(3, b"M" + bytes(32)), (4, b"M" + bytes(64))]
    rows = [(m[0], m[4]) for m in made] + lists
    size = sum(len(p) for _, p in rows)
    tracemalloc.start()
    passed, got, before = [], 0, tracemalloc.get_traced_memory()[0]
    found = []
    for batch in jaccard_join._count_tokens(_batches(rows)):
        for block, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p[:1] == b"M":
                passed.append((block, p))
                continue
            n = (len(p) - 1) // 14
            got += n
            found.append((block, p))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert sorted(passed) == lists
    # by brute force: (block, owner, key, count) of keys under two fingerprints
    block = np.concatenate([np.full(len(m[1]), m[0]) for m in made])
    key, owner, f1 = (np.concatenate(x) for x in ([m[1] for m in made], [m[2] for m in made], [m[3][m[2]] for m in made]))
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    low, high = np.full(len(count), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(count), np.uint64)
    np.minimum.at(low, place, f1)
    np.maximum.at(high, place, f1)
    many = (low != high)[place]
    want = sorted(zip(block[many].tolist(), owner[many].tolist(), key[many].tolist(), count[place][many].tolist()))
    have = []
    for b, p in found:
        n = (len(p) - 1) // 14
        have += zip([b] * n, np.frombuffer(p, np.uint16, n, 1).tolist(), np.frombuffer(p, np.uint64, n, 1 + 6 * n).tolist(), np.frombuffer(p, np.uint32, n, 1 + 2 * n).tolist())
    assert sorted(have) == want and got == len(want)
    assert peak < 5 * size, f"{peak / size:.1f} times the bucket"


def test_counting_one_key_and_nothing():
    """A range holds all places of its key; an empty task gives nothing."""
    def payload(f1, key):
        head = np.array([1, 1], np.int64).tobytes()
        return b"T" + head + np.zeros(1, np.uint16).tobytes() + np.array([f1], np.uint64).tobytes() + np.zeros(1, np.uint16).tobytes() + np.array([key], np.uint64).tobytes()

    top = (1 << 64) - 1
    for keys, kept in (((top, top), 2), ((0, 0), 2), ((0, top), 0), ((5, 6), 0)):
        out = list(jaccard_join._count_tokens(_batches([(0, payload(1, keys[0])), (1, payload(2, keys[1]))])))
        assert sum(b.num_rows for b in out) == kept
    assert sum(b.num_rows for b in jaccard_join._count_tokens(iter([]))) == 0
