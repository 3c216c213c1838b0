"""Monotone sequences in partitioned Elias-Fano form, and named arrays as one memory-mapped payload."""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np

from creditspark.llm.flat import U

BLOCK = 8192  # values coded together
_BIT = np.arange(64, dtype=np.uint64)


def _coded(v: np.ndarray) -> tuple[int, bytes]:
    """Low bits as they are, high parts in unary, of one ascending block relative to its first value."""
    d, n = v - v[0], len(v)
    low = max(0, (int(d[-1]) // n).bit_length() - 1)
    bits = ((d[:, None] >> _BIT[:low]) & U(1)).astype(np.uint8)
    marks = np.zeros(n + (int(d[-1]) >> low) + 1, np.uint8)
    marks[(d >> U(low)).astype(np.int64) + np.arange(n)] = 1
    return low, np.packbits(bits.ravel(), bitorder="little").tobytes() + np.packbits(marks, bitorder="little").tobytes()


def encode(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold an ascending uint64 sequence."""
    values, low, data, at = values.astype(U), [], [], [0]
    for i in range(0, len(values), BLOCK):
        bits, coded = _coded(values[i:i + BLOCK])
        low.append(bits)
        data.append(coded)
        at.append(at[-1] + len(coded))
    return {f"{name}.first": values[::BLOCK], f"{name}.low": np.array(low, np.uint8), f"{name}.at": np.array(at, np.int64),
            f"{name}.data": np.array(bytearray(b"".join(data)), np.uint8), f"{name}.n": np.array([len(values)], np.int64)}


class Sequence:
    """Reads an encoded sequence; only the blocks that are asked for are decoded."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.first, self.low, self.at, self.data = (arrays[f"{name}.{part}"] for part in ("first", "low", "at", "data"))
        self.n = int(arrays[f"{name}.n"][0])

    def block(self, b: int) -> np.ndarray:
        n, low = min(BLOCK, self.n - b * BLOCK), int(self.low[b])
        raw = self.data[self.at[b]:self.at[b + 1]]
        cut = (n * low + 7) // 8
        high = np.flatnonzero(np.unpackbits(raw[cut:], bitorder="little")) - np.arange(n)
        value = high.astype(U) << U(low)
        if low:
            bits = np.unpackbits(raw[:cut], count=n * low, bitorder="little").reshape(n, low)
            for j in range(low):
                value |= bits[:, j].astype(U) << U(j)
        return value + self.first[b]

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at positions."""
        out = np.empty(len(index), U)
        for b, which in _by_block(index // BLOCK):
            out[which] = self.block(b)[index[which] - b * BLOCK]
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each value's successor (the first value not below it), and whether it is equal."""
        at, equal = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        if not self.n:
            return at, equal
        for b, which in _by_block(np.maximum(np.searchsorted(self.first, x, "right") - 1, 0)):
            values = self.block(b)
            i = np.searchsorted(values, x[which])
            at[which] = i + b * BLOCK
            equal[which] = (i < len(values)) & (values[np.minimum(i, len(values) - 1)] == x[which])
        return at, equal


def _by_block(block: np.ndarray):
    """(block, positions asking for it)."""
    if not len(block):
        return
    if block.max() < 1 << 16:
        block = block.astype(np.uint16)  # sorted by counting
    order = np.argsort(block, kind="stable")
    s = block[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    for i, j in zip(starts, np.append(starts[1:], len(s))):
        yield int(s[i]), order[i:j]


def to_payload(arrays: dict[str, np.ndarray]) -> bytes:
    head, body, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += bytes(-len(raw) % 8)
        head.append((name, a.dtype.str, at, len(a)))
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def mapped(payload: bytes) -> dict[str, np.ndarray]:
    """The arrays of a payload, memory-mapped from an unnamed file that vanishes with the last reader."""
    with tempfile.TemporaryFile() as f:
        f.write(payload)
        f.flush()
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(m[:8], "little")
    return {name: np.frombuffer(m, dtype, n, 8 + size + at) if n else np.zeros(0, dtype) for name, dtype, at, n in json.loads(m[8:8 + size])}
