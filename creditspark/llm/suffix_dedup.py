"""Removal of byte strings that an earlier document holds already, by sampled suffixes.

Every ``length``-byte window belongs to one anchor: the place in it whose next ``GRAM``
bytes hash smallest. Equal windows have equal anchors, so only the suffixes that begin
at anchors need to be compared.

1. Anchors travel packed to the bucket of their hash, each with a hash of all its windows'
   bytes. Anchors met in one document only are done; where a smaller document has
   the very same windows, all of them are repeats; what remains is compared as text.
2. The remaining suffixes, with the bytes before the anchor that its windows need, are
   range-partitioned by their anchors at sampled splitters. Equal anchors never
   split, so no equal windows lie on both sides of a boundary. Each bucket
   sorts its windows by multikey quicksort, eight bytes at a time, only refining
   ties, and compares neighbors; the smallest document of a run keeps its bytes.
3. Each document removes the union of its repeated windows.

A task holds the packed bytes of its bucket and works on a bounded part of them at a time.
Buckets are as many as the counted texts need. Anchors that a bounded sample shows to be too
common for one bucket are dealt by their windows: only equal windows must meet.

Defined results: null texts are empty; shorter texts than a window lose nothing; a document
with a null id neither gives nor loses bytes; rows with the same id do not count
against each other; an empty table gives an empty result; other columns are ignored.
An exact copy inside a task's slice sends no anchors: all its windows are repeats.
The scan order of a partition must be repeatable, as it is for stored tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.blocks import bucket_count, even_labels, runs
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

LENGTH = 50
GRAM = 18
SLICE = 2 << 20
CHUNK = 1 << 18
ARROW_BYTES = "4m"
PART = 8 << 20  # bytes of text whose anchors share a bucket
RANGE = 8 << 20  # bytes of packed anchors that are classified at once
WINDOWS = 200_000  # windows that are compared at once
HOT_BYTES = 4 << 20  # anchors whose suffixes take more are dealt by their windows
SPLITTER_DOCS = 2000  # documents in the sample that places splitters and finds common anchors; it only balances the buckets
U = flat.U
LOW = U(0xFFFFFFFF)
ANCHOR = np.dtype([("b1", "<u2"), ("owner", "<u2"), ("start", "<u4"), ("n", "u1"), ("off", "u1")])  # beside 32 bits of the key and of the windows' hash
NO_HASHES = np.zeros(0, np.uint64)
WANTED = np.dtype([("start", "<u4"), ("n", "u1"), ("off", "u1")])
HIT = np.dtype([("start", "<u4"), ("mask", "<u8")])


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window, number of windows, anchor place, anchor hash) of all anchors, in order; windows never cross rows."""
    span = length - gram + 1
    valid = np.zeros(len(buf), bool)
    for s, e in zip(starts.tolist(), (ends - length + 1).tolist()):
        if e > s:
            valid[s:e] = True
    found = []
    for at in range(0, max(len(buf) - length + 1, 0), CHUNK):
        part = buf[at:at + CHUNK + length - 1]
        power, h, size = U(0x9E3779B97F4A7C15), flat.TABLES[False][part], 1
        grams = {1: h}
        while 2 * size <= gram:
            grams[2 * size] = grams[size][:-size] * U(pow(int(power), size, 1 << 64)) + grams[size][size:]
            size *= 2
        h, got = grams[size], size
        while got < gram:
            size = 1 << ((gram - got).bit_length() - 1)
            n = len(part) - got - size + 1
            h = h[:n] * U(pow(int(power), size, 1 << 64)) + grams[size][got:got + n]
            got += size
        h = flat.mix(h)
        value = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        least, width = value, 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            n = len(value) - span + 1
            least = np.minimum(least[:n], least[span - width:span - width + n])
        ok = valid[at:at + len(least)]
        new = ok.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        last = ok.copy()
        last[:-1] &= (least[1:] != least[:-1]) | ~ok[1:]
        first, end = np.flatnonzero(new), np.flatnonzero(last)
        place = (least[first] & U(0xFFFFFF)).astype(np.int64)
        found.append((first + at, end - first + 1, place + at, h[place]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_blocks(docs: DataFrame, buckets: int, length: int, hot: np.ndarray = NO_HASHES) -> DataFrame:
    """Rows (bucket, block, payload): packed anchors by bucket, and the documents of each block.

    Where a smaller document of the block has the very same windows, the anchor stays at home as a repeat.
    """
    labels = even_labels(docs, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        for batch in flat.slices(batches, "text", SLICE):
            for at in range(0, batch.num_rows, 60_000):
                piece = batch.slice(at, 60_000)
                block, turn = (part << 24) | turn, turn + 1
                ids, prints = flat.longs(flat.column(piece, "doc_id")), flat.longs(flat.column(piece, "h"))
                copy = np.zeros(len(ids), bool)
                smallest: dict[int, int] = {}
                order = np.argsort(ids, kind="stable")
                for i in order.tolist():
                    copy[i] = smallest.setdefault(int(prints[i]), int(ids[i])) != ids[i]
                buf, starts, ends = flat.text_bytes(flat.column(piece, "text"))
                ends_of_senders = np.where(copy, starts, ends)
                first, n, place, h = anchors(buf, starts, ends_of_senders, length)
                whole = flat.range_hashes(buf, first, first + n - 1 + length, lower=False)
                full = np.flatnonzero(ends_of_senders > starts)
                owner = full[np.searchsorted(starts[full], first, "right") - 1] if len(full) else np.zeros(0, np.int64)
                key = flat.mix(h)  # anchors have small hashes: these fill the buckets evenly
                deal = np.where(np.isin(h, hot), flat.mix(h ^ whole), key) if len(hot) else key
                bucket = ((deal >> U(32)) * U(buckets)) >> U(32)
                to, same, doc = (bucket << U(32)) | (key & LOW), whole >> U(16), ids[owner]
                order = np.lexsort((doc, same, to))
                to, same, doc = to[order], same[order], doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (to[1:] != to[:-1]) | (same[1:] != same[:-1])
                begin = np.flatnonzero(new)
                repeat = doc > np.repeat(doc[begin], np.diff(np.append(begin, len(order))))
                w = np.zeros(len(order), WANTED)
                w["start"], w["n"], w["off"] = (first - starts[owner])[order], n[order], (place - first)[order]
                owner = owner[order].astype(np.uint16)
                rows = [(turn % buckets, block, b"M" + ids.tobytes() + prints.tobytes() + copy.tobytes())]
                if repeat.any():
                    rows.append((turn % buckets, block, b"F" + owner[repeat].tobytes() + w[repeat].tobytes()))
                sent = ~repeat
                to, same, owner, w = to[sent], same[sent], owner[sent], w[sent]
                r = np.zeros(len(to), ANCHOR)
                r["b1"] = same & U(0xFFFF)
                for c in WANTED.names:
                    r[c] = w[c]
                windows = (to << U(32)) | (same >> U(16))
                bounds = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64) << U(32))
                for k in range(buckets):
                    if bounds[k] < bounds[k + 1]:
                        s = slice(bounds[k], bounds[k + 1])
                        own = r[s]
                        present, local = np.unique(owner[s], return_inverse=True)
                        own["owner"] = local
                        rows.append((k, block, b"T" + np.int64(len(present)).tobytes() + present.tobytes() + ids[present].tobytes() + windows[s].tobytes() + own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(labels[[x[0] for x in rows]]), pa.array([x[1] for x in rows], pa.int64()),
                                                  pa.array([x[2] for x in rows], pa.binary())], names=["bucket", "block", "payload"])

    return docs.mapInArrow(run, "bucket int, block long, payload binary")


def _payload_batches(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[i:i + 64]], pa.int64()), pa.array([x[1] for x in rows[i:i + 64]], pa.binary())],
                                         names=["block", "payload"])


def _unpacked(p: bytes) -> tuple[np.ndarray, ...]:
    """Views of a payload: the documents' places and ids, key and windows' hash of each anchor in order, the anchors."""
    k = int(np.frombuffer(p, np.int64, 1, 1)[0])
    m = (len(p) - 9 - 10 * k) // (8 + ANCHOR.itemsize)
    return (np.frombuffer(p, np.uint16, k, 9), np.frombuffer(p, np.int64, k, 9 + 2 * k), np.frombuffer(p, np.uint64, m, 9 + 10 * k),
            np.frombuffer(p, ANCHOR, m, 9 + 10 * k + 8 * m))


def _classified(hot_keys: np.ndarray = NO_HASHES):
    """Per block: anchors whose windows a smaller document has all (F), and anchors to compare as text (C).

    The bucket is worked on range by range. Keys that lie in several buckets or ranges count as shared by
    documents with different windows: their anchors are compared as text at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            ready = []
            for block, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (parts if p[:1] == b"T" else ready).append((block, p))
            yield from _payload_batches(ready)
            del batch, ready
        if not parts:
            return
        ranges = -(-sum(len(p) for _, p in parts) // RANGE)
        cuts, split = [], hot_keys
        if ranges > 1:
            sample = np.sort(np.concatenate([_unpacked(p)[2][13 * i % 32::32] for i, (_, p) in enumerate(parts)]))
            edges = np.unique(sample[np.arange(1, ranges) * len(sample) // ranges])
            below, above = np.zeros(len(edges), bool), np.zeros(len(edges), bool)
            for _, p in parts:
                windows = _unpacked(p)[2]
                at = np.searchsorted(windows, edges)
                below |= at > np.searchsorted(windows, edges & ~LOW)
                above |= at < np.searchsorted(windows, edges | LOW, "right")
                cuts.append(np.concatenate([[0], at, [len(windows)]]))
            ranges, split = len(edges) + 1, np.append(hot_keys, edges[below & above] >> U(32))
        for i in range(ranges):
            found = []
            for j, (block, p) in enumerate(parts):
                present, ids, windows, r = _unpacked(p)
                lo, hi = (cuts[j][i], cuts[j][i + 1]) if cuts else (0, len(r))
                if lo < hi:
                    local = r["owner"][lo:hi]
                    found.append((windows[lo:hi], r[lo:hi], ids[local], present[local], np.full(hi - lo, block, np.int64)))
            if i == ranges - 1:
                parts.clear()
            if found:
                yield from _payload_batches(_range_rows(found, split))

    return run


def _range_rows(found: list[tuple[np.ndarray, ...]], split: np.ndarray) -> list[tuple[int, bytes]]:
    windows, r, doc, owner, block = (np.concatenate(x) for x in zip(*found))
    found.clear()
    key = windows >> U(32)
    order = np.argsort(key, kind="stable")
    starts, sizes = runs(key[order])
    sorted_doc = doc[order]
    shared = np.minimum.reduceat(sorted_doc, starts) != np.maximum.reduceat(sorted_doc, starts)
    if len(split):
        shared |= np.isin(key[order[starts]], split)
    kept = order[np.repeat(shared, sizes)]  # anchors that two documents have
    del key, order, sorted_doc
    order = kept[np.lexsort((doc[kept], r["b1"][kept], windows[kept]))]
    r, doc, owner, block, windows = r[order], doc[order], owner[order], block[order], windows[order]
    rows: list[tuple[int, bytes]] = []
    if not len(r):
        return rows
    key = windows >> U(32)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key.copy()
    new[1:] |= (windows[1:] != windows[:-1]) | (r["b1"][1:] != r["b1"][:-1])
    starts = np.flatnonzero(new)
    full = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(r))))
    key_starts = np.flatnonzero(new_key)
    several = np.add.reduceat(new.astype(np.int64), key_starts) > 1
    if len(split):
        several |= np.isin(key[key_starts], split)
    wanted = ~full & np.repeat(several, np.diff(np.append(key_starts, len(r))))
    for mask, name in ((full, b"F"), (wanted, b"C")):
        at = np.flatnonzero(mask)
        at = at[np.argsort(block[at], kind="stable")]
        w, places, blocks = np.zeros(len(at), WANTED), owner[at], block[at]
        for c in WANTED.names:
            w[c] = r[c][at]
        s, n = runs(blocks)
        rows += [(b, name + places[i:i + k].tobytes() + w[i:i + k].tobytes()) for b, i, k in zip(blocks[s].tolist(), s.tolist(), n.tolist())]
    return rows


def hits_of(wanted: np.ndarray) -> np.ndarray:
    """All windows of the given anchors as hits."""
    out = np.zeros(len(wanted), HIT)
    out["start"] = wanted["start"]
    out["mask"] = (U(1) << wanted["n"].astype(np.uint64)) - U(1)
    return out


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, copy, hits, wanted) of documents with anything to do."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(block, []).append(p)
    for block in sorted(held):
        payloads = held.pop(block)
        meta = next(p for p in payloads if p[:1] == b"M")
        n = (len(meta) - 1) // 17
        ids, prints, copy = np.frombuffer(meta, np.int64, n, 1), np.frombuffer(meta, np.int64, n, 1 + 8 * n), np.frombuffer(meta, bool, n, 1 + 16 * n)
        lists: dict[bytes, list] = {}
        for name in (b"F", b"C"):
            owner, w = [np.zeros(0, np.uint16)], [np.zeros(0, WANTED)]
            for p in payloads:
                if p[:1] == name:
                    k = (len(p) - 1) // (2 + WANTED.itemsize)
                    owner.append(np.frombuffer(p, np.uint16, k, 1))
                    w.append(np.frombuffer(p, WANTED, k, 1 + 2 * k))
            owner, w = np.concatenate(owner), np.concatenate(w)
            order = np.argsort(owner, kind="stable")
            w, at = w[order], np.searchsorted(owner[order], np.arange(n + 1))
            lists[name] = [(hits_of(w[s:e]) if name == b"F" else w[s:e]).tobytes() if e > s else None for s, e in zip(at[:-1], at[1:])]
        use = [i for i in range(n) if copy[i] or lists[b"F"][i] or lists[b"C"][i]]
        for i in range(0, len(use), 5000):
            o = use[i:i + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[o]), pa.array(prints[o]), pa.array(copy[o]), pa.array([lists[b"F"][j] for j in o], pa.binary()), pa.array([lists[b"C"][j] for j in o], pa.binary())],
                names=["doc_id", "h", "copy", "hits", "wanted"])


class Sampled(NamedTuple):
    """What a bounded sample shows; all of it only balances the buckets."""

    text_bytes: float  # of the whole table
    splitters: np.ndarray  # anchors that cut the suffixes into about equal ranges
    hot: np.ndarray  # anchors too common for one bucket
    hot_hashes: np.ndarray


def grams_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The anchors' bytes; ``buf`` goes on for ``GRAM`` bytes behind the last place."""
    view = np.lib.stride_tricks.sliding_window_view(buf, GRAM)
    return np.ascontiguousarray(view[places]).view(f"S{GRAM}").ravel()


def sampled(docs: DataFrame, buckets: int, length: int) -> Sampled:
    """Size of the texts, splitters and common anchors, from the beginnings of the texts of a bounded sample."""
    n = docs.count()
    rows = docs.sample(fraction=min(1.0, SPLITTER_DOCS / max(n, 1)), seed=7).select(
        F.encode(F.substring("text", 1, 4000), "utf-8").alias("t"), F.octet_length("text").alias("n")).limit(2 * SPLITTER_DOCS).collect()
    total = n * sum(r["n"] or 0 for r in rows) / max(1, len(rows))
    grams, hashes, read = [np.zeros(0, f"S{GRAM}")], [np.zeros(0, np.uint64)], 0
    for i in range(0, len(rows), 200):
        texts = [bytes(r["t"] or b"") for r in rows[i:i + 200]]
        ends = np.cumsum([len(t) for t in texts])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        _, _, place, h = anchors(buf, np.append(0, ends[:-1]), ends, length)
        read += len(buf)
        if len(place):
            grams.append(grams_at(buf, place))
            hashes.append(h)
    grams, hashes = np.concatenate(grams), np.concatenate(hashes)
    order = np.argsort(grams, kind="stable")
    grams, hashes = grams[order], hashes[order]
    buckets = max(buckets, -int(-total // PART))
    splitters = np.unique(grams[(np.arange(1, buckets) * len(grams)) // buckets]) if len(grams) else grams
    kinds, at, counts = np.unique(hashes, return_index=True, return_counts=True)
    suffix = SUFFIX_HEAD.itemsize + (3 * length) // 2
    hot = (counts >= 4) & (counts * (total / max(1, read)) * suffix > HOT_BYTES)
    return Sampled(total, splitters, grams[at[hot]], kinds[hot])


SUFFIX_HEAD = np.dtype([("doc", "<i8"), ("h", "<i8"), ("start", "<u4"), ("n", "u1"), ("off", "u1")])
PLACED_HEAD = np.dtype(SUFFIX_HEAD.descr + [("at", "<i8")])


def window_table(raw: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """A row of big-endian words for each window and its anchor's offset; ``raw`` has whole words."""
    raw[:, length:] = 0
    words = raw.shape[1] // 8
    table = np.zeros((len(raw), words + 1), np.uint64)
    table[:, :words] = raw.view(">u8")
    table[:, words] = offsets
    return table


def row_hashes(table: np.ndarray) -> np.ndarray:
    h = np.zeros(len(table), np.uint64)
    for i in range(table.shape[1]):
        h = flat.mix((h ^ table[:, i]) * U(0x9E3779B97F4A7C15) + U(i + 1))
    return h


def repeats(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose group has a smaller document."""
    o = np.lexsort((doc, group))
    s, c = runs(group[o])
    return o[doc[o] > np.repeat(doc[o][s], c)]


def _suffix_blocks(joined: DataFrame, splitters: np.ndarray, hot: np.ndarray, length: int) -> DataFrame:
    """Rows (bucket, heads, bytes): suffixes with the bytes that their windows need, by range of the anchors.

    The windows of hot anchors are suffixes of their own, dealt by their hash; where a smaller document of the
    same piece has such a window, it is a hit (a head without bytes).
    """
    shared = joined.sparkSession.sparkContext.broadcast((splitters, hot))  # one anchor per bucket, and the common ones
    width = 2 * length - GRAM
    words = -(-length // 8)
    buckets = len(splitters) + 1
    labels = even_labels(joined, buckets)

    def windows_of(heads: np.ndarray, padded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(suffixes of one window, their buckets, hits) of hot suffixes, some thousand at a time."""
        view = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)
        for i in range(0, len(heads), 4000):
            part = heads[i:i + 4000]
            n = part["n"].astype(np.int64)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(part, n)
            own["start"] += number.astype(np.uint32)
            own["off"] -= number.astype(np.uint8)
            own["at"] += number
            own["n"] = 1
            table = window_table(view[own["at"]], own["off"], length)
            hit = np.zeros(len(own), bool)
            hit[repeats(multikey_groups(table), own["doc"])] = True
            bucket = ((row_hashes(table) >> U(32)) * U(buckets)) >> U(32)
            yield own[~hit], bucket[~hit].astype(np.int64), own[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, common = shared.value
        turn = TaskContext.get().partitionId()
        for batch in flat.slices(batches, "text", SLICE):
            buf, starts, ends = flat.text_bytes(flat.column(batch, "text"))
            heads = []
            for doc, h, at, w in zip(flat.longs(flat.column(batch, "doc_id")), flat.longs(flat.column(batch, "h")), starts, flat.pylist(batch, "wanted")):
                wanted = np.frombuffer(w, WANTED)
                head = np.zeros(len(wanted), PLACED_HEAD)
                for c in ("start", "n", "off"):
                    head[c] = wanted[c]
                head["doc"], head["h"], head["at"] = doc, h, at + wanted["start"].astype(np.int64)
                heads.append(head)
            heads = np.concatenate(heads)
            padded = np.concatenate([buf, np.zeros(width + 8, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, width)
            grams = grams_at(padded, heads["at"] + heads["off"])
            bucket, rows = np.searchsorted(cuts, grams, "right"), []
            if len(common):
                mine = np.isin(grams, common)
                for own, dealt, hits in windows_of(heads[mine], padded):
                    rows += packed(own, dealt, view)
                    if len(hits):
                        turn += 1
                        rows.append((turn % buckets, hits[list(SUFFIX_HEAD.names)].astype(SUFFIX_HEAD).tobytes(), None))
                heads, bucket = heads[~mine], bucket[~mine]
            rows += packed(heads, bucket, view)
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(labels[[r[0] for r in rows[i:i + 5000]]]), pa.array([r[1] for r in rows[i:i + 5000]], pa.binary()),
                                                  pa.array([r[2] for r in rows[i:i + 5000]], pa.binary())], names=["bucket", "heads", "bytes"])

    def packed(heads: np.ndarray, bucket: np.ndarray, view: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        order = np.argsort(bucket, kind="stable")
        begin, sizes = runs(bucket[order])
        rows = []
        for s, size in zip(begin.tolist(), sizes.tolist()):
            for i in range(s, s + size, 20_000):
                part = heads[order[i:min(i + 20_000, s + size)]]
                own = np.zeros(len(part), SUFFIX_HEAD)
                for c in SUFFIX_HEAD.names:
                    own[c] = part[c]
                keep = np.arange(width)[None, :] < (part["n"].astype(np.int64) + length - 1)[:, None]
                rows.append((int(bucket[order[s]]), own.tobytes(), view[part["at"]][keep].tobytes()))
        return rows

    return joined.mapInArrow(run, "bucket int, heads binary, bytes binary")


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """Group number of each row of big-endian words; rows are equal if and only if their groups are.

    Multikey quicksort a word at a time: the first words are sorted, then only rows
    that are still tied are sorted by their next word inside their tie.
    """
    n, levels = words.shape
    group = np.zeros(n, np.int64)
    tied = np.arange(n)
    fresh = 0
    for level in range(levels):
        key, g = words[tied, level], group[tied]
        order = np.argsort(key, kind="stable") if level == 0 else np.lexsort((key, g))
        tied, key, g = tied[order], key[order], g[order]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        numbers = fresh + np.cumsum(new)
        fresh = int(numbers[-1]) if len(numbers) else fresh
        group[tied] = numbers
        starts = np.flatnonzero(new)
        tied = tied[np.repeat(np.diff(np.append(starts, len(tied))) > 1, np.diff(np.append(starts, len(tied))))]
        if not len(tied):
            break
    return group


def _compared(length: int):
    """Hits of the windows that a smaller document of the bucket has too."""
    words = -(-length // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, data, known = [np.zeros(0, SUFFIX_HEAD)], [], [np.zeros(0, SUFFIX_HEAD)]
        for batch in batches:
            for x, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (heads if b is not None else known).append(np.frombuffer(x, SUFFIX_HEAD))
                if b is not None:
                    data.append(b)
            del batch
        heads, known = np.concatenate(heads), np.concatenate(known)
        if not len(heads) + len(known):
            return
        data.append(bytes(8 * words + GRAM))
        buf = np.frombuffer(b"".join(data), np.uint8)
        del data
        n = heads["n"].astype(np.int64)
        sizes = n + length - 1
        at = np.cumsum(sizes) - sizes
        view = np.lib.stride_tricks.sliding_window_view(buf, 8 * words)
        masks = np.zeros(len(heads), np.uint64)

        def table_of(owner: np.ndarray, number: np.ndarray) -> np.ndarray:
            # windows are compared with those of the same offset to their anchor: equal windows have equal offsets
            return window_table(view[at[owner] + number], heads["off"][owner] - number, length)

        for owner, number in _window_sets(heads, buf, at, table_of):
            hit = repeats(multikey_groups(table_of(owner, number)), heads["doc"][owner])
            np.bitwise_or.at(masks, owner[hit], U(1) << number[hit].astype(np.uint64))
        found = np.flatnonzero(masks)
        heads, masks = np.concatenate([heads[found], known]), np.concatenate([masks[found], np.ones(len(known), np.uint64)])
        del buf, view, found
        order = np.lexsort((heads["h"], heads["doc"]))
        heads, masks = heads[order], masks[order]
        key = heads[["doc", "h"]]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(heads) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        hits = np.zeros(len(heads), HIT)
        hits["start"], hits["mask"] = heads["start"], masks
        for i in range(0, len(starts), 10_000):
            s = starts[i:i + 10_000]
            e = np.append(starts, len(heads))[i + 1:i + 1 + len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads["doc"][s]), pa.array(heads["h"][s]), pa.array([hits[x:y].tobytes() for x, y in zip(s, e)], pa.binary())],
                names=["doc_id", "h", "hits"])

    return run


def _window_sets(heads: np.ndarray, buf: np.ndarray, at: np.ndarray, table_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffix, number of its window) in sets of about ``WINDOWS``; equal windows are in one set, those alone with their anchor in none."""
    view = np.lib.stride_tricks.sliding_window_view(buf, 8)
    anchor = at + heads["off"]
    lead, rest = (view[anchor + k].copy().view(">u8").ravel().astype(np.uint64) for k in (0, 8))
    order = np.lexsort((rest, lead))
    lead, rest = lead[order], rest[order]
    new = np.ones(len(order), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])
    del lead, rest
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(order)))
    live = order[np.repeat(counts > 1, counts)]
    ends = np.cumsum(counts[counts > 1])  # of the ties
    del order, new
    n = heads["n"].astype(np.int64)
    windows = np.concatenate([[0], np.cumsum(n[live])])[np.append(0, ends)]
    begin = tie = 0
    while tie < len(ends):  # whole ties at a time
        last = max(tie, int(np.searchsorted(windows, windows[tie] + WINDOWS, "right")) - 2)
        own = live[begin:ends[last]]
        if windows[last + 1] - windows[tie] <= WINDOWS:
            owner = np.repeat(own, n[own])
            yield owner, np.arange(len(owner)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        else:  # one tie that is too large: offset by offset, and by the windows' hash
            off = heads["off"][own].astype(np.int64)
            for offset in range(int((off - n[own] + 1).min()), int(off.max()) + 1):
                has = (off >= offset) & (off - offset < n[own])
                owner, number = own[has], off[has] - offset
                turns = -(-len(owner) // WINDOWS)
                if turns < 2:
                    yield owner, number
                    continue
                turn = np.concatenate([row_hashes(table_of(owner[i:i + WINDOWS], number[i:i + WINDOWS])) % U(turns) for i in range(0, len(owner), WINDOWS)])
                for t in range(turns):
                    yield owner[turn == t], number[turn == t]
        begin, tie = int(ends[last]), last + 1


def removed_bytes(size: int, copy: bool, hits: list[bytes], length: int) -> np.ndarray:
    """Mask of the bytes covered by repeated windows."""
    gone = np.zeros(size, bool)
    if copy and size >= length:
        gone[:] = True
        return gone
    h = np.concatenate([np.frombuffer(x, HIT) for x in hits]) if hits else np.zeros(0, HIT)
    if not len(h):
        return gone
    edges = np.zeros(size + 1, np.int32)
    for i in range(0, len(h), 20_000):
        part = h[i:i + 20_000]
        row, bit = np.nonzero((part["mask"][:, None] >> np.arange(length, dtype=np.uint64)) & U(1))
        at = part["start"][row].astype(np.int64) + bit
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
    return np.cumsum(edges)[:size] > 0


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text, kept, n_bytes, n_removed, n_spans) of every document; ``kept`` has the remaining bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # whole texts reach the workers in small batches
    same = dict(df.dtypes).get(doc_id) == "bigint" and doc_id == "doc_id" and text == "text" and text in df.columns
    # a needless alias would keep Spark from using the shuffled texts twice
    docs = df.select(doc_id, text) if same else df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = 2 * bucket_count(df)
    shown = sampled(docs, buckets, length)
    buckets = max(buckets, -int(-shown.text_bytes // PART))
    named = docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    classified = _anchor_blocks(named, buckets, length, shown.hot_hashes).repartition(buckets, "bucket").mapInArrow(
        _classified(flat.mix(shown.hot_hashes) & LOW), "block long, payload binary")
    todo = materialize(classified.repartition(buckets, "block").mapInArrow(_document_rows, "doc_id long, h long, copy boolean, hits binary, wanted binary"), "anchors")
    placed = named.repartition(buckets, "doc_id", "h")  # used twice below, shuffled once
    wanted = todo.where("wanted IS NOT NULL").select("doc_id", "h", "wanted").dropDuplicates(["doc_id", "h"])
    joined = placed.join(wanted.repartition(buckets, "doc_id", "h").hint("shuffle_hash"), ["doc_id", "h"]).select("doc_id", "h", "text", "wanted")
    hits = _suffix_blocks(joined, shown.splitters, shown.hot, length).repartition(len(shown.splitters) + 1, "bucket").mapInArrow(_compared(length), "doc_id long, h long, hits binary")
    known = todo.select("doc_id", "h", "copy", "hits").unionByName(hits.withColumn("copy", F.lit(False)))
    known = known.groupBy("doc_id", "h").agg(F.max("copy").alias("copy"), F.collect_list("hits").alias("hits"))
    both = placed.join(known.repartition(buckets, "doc_id", "h").hint("shuffle_hash"), ["doc_id", "h"], "left").select("doc_id", "text", "copy", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            kept, size, lost, spans = [], [], [], []
            for t, copy, hits in zip(*(flat.pylist(batch, c) for c in ("text", "copy", "hits"))):
                raw = (t or "").encode()
                gone = removed_bytes(len(raw), bool(copy), hits or [], length)
                n = int(gone.sum())
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw)
                size.append(len(raw))
                lost.append(n)
                spans.append(int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])))
            yield pa.RecordBatch.from_arrays(
                [flat.column(batch, "doc_id"), flat.column(batch, "text"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, lost, spans))],
                names=["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"])

    alone = docs.where("doc_id IS NULL").selectExpr("doc_id", "text", "false AS copy", "CAST(NULL AS ARRAY<BINARY>) AS hits")
    return both.unionByName(alone).mapInArrow(run, "doc_id long, text string, kept binary, n_bytes long, n_removed long, n_spans long")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document holds, removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
