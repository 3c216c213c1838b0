"""Whole Arrow text columns as one byte array: word bounds, word hashes and small Arrow helpers.

Tasks work on the UTF-8 bytes of many documents at once with numpy, so no Python
object is made per word. All functions are pure and keep no state between batches
but tables of constants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
CHUNK = 1 << 20  # bytes hashed at once
SPACES = b" \t\n\v\f\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
    if lower:
        t[65:91] = t[97:123]
    return t


TABLES = {lower: _table(lower) for lower in (False, True)}


def byte_mask(members: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(members)] = True
    return m


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column with the start and end of each row; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    return buf, at[:-1] - at[0], at[1:] - at[0]


def word_bounds(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray):
    """Starts and ends of all words, and the number of words before each row (one more entry than rows)."""
    inside = ~separator[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = ends > starts
    before[starts[full]] = False
    after[ends[full] - 1] = False
    ws, we = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(ws, np.append(starts, len(buf)))
    return ws, we, first


def range_hashes(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte range; ranges are ordered by start."""
    out, t, i = np.empty(len(ws), np.uint64), TABLES[lower], 0
    while i < len(ws):
        lo = ws[i]
        j = max(i + 1, int(np.searchsorted(ws, lo + CHUNK)))
        hi = int(we[i:j].max())
        up, down = powers(max(CHUNK, hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(t[buf[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = ws[i:j] - lo, we[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have about ``limit`` bytes; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts, ends = text_bytes(batch.column(place(batch, column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def place(batch: pa.RecordBatch, name: str) -> int:
    """Place of a column; names that differ only in case match if they are unique, as in Spark."""
    at = batch.schema.get_field_index(name)
    if at < 0:
        same = [i for i, n in enumerate(batch.schema.names) if n.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"{len(same)} columns are named {name!r} among {batch.schema.names}")
        at = same[0]
    return at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(place(batch, name))


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return column(batch, name).to_pylist()


def longs(values) -> np.ndarray:
    """An int64 column without nulls."""
    return values.to_numpy(zero_copy_only=False).astype(np.int64)
