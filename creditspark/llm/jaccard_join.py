"""Exact similarity join of documents by the Jaccard overlap of their word shingles, to connected classes.

The size-aware heavy-light method, in steps:

1. *Counts.* Every document's distinct shingles travel once, packed, to the bucket of their
   hash; there each learns in how many different sets it occurs. Linked documents share
   three quarters of the smaller set, so a document with fewer repeated shingles leaves.
   Equal sets are one class from here on (its smallest document stands for it).
2. *Light sets* (size up to a boundary) enumerate the subsets of exactly the size that two
   linked sets must share; equal subsets are links. The boundary is where enumeration begins to
   cost more than scanning, from the sums of both costs per set size.
3. *Heavy sets* scan inverted lists of their rarest shingles (a prefix long enough that linked
   sets must meet in it). First each list only proposes a few hubs and the neighbor in size, each
   document tries its most frequent proposals, and components form; after a few such rounds
   all members of a list that are still in different components are paired, filtered by size, position, parity
   bits and number of meetings, and compared. Members already connected need no comparison, so a
   group of near copies costs as many comparisons as it has members.
4. Links give connected components.

Defined results: words are split at ASCII white space and A-Z are lowered; a text with fewer than
``width`` words has its whole word sequence as single shingle; null and empty texts have no
shingle, are linked with nothing and are their own component; a null id has a null
component; rows with the same id are linked with each other, and each text of such an
id keeps its own links; ids are cast to long; an empty table
gives an empty result; other columns are ignored. Shingles are 64-bit hashes.
The scan order of a partition must be repeatable, as it is for stored tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.blocks import block_batch, bucket_count, bucket_of, even_labels, exchanged, gathered, packed, runs
from creditspark.llm.components import connected_components
from creditspark.llm.language_model import small_batches
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

WIDTH = 5
SLICE = 2 << 20  # bytes of text per packed block
RANGE = 1 << 18  # shingles of a bucket that are counted at once
TURNS, HUBS = 1, 16  # rounds of proposals before the exact search; hubs per list in the first, doubled in each
TRIES = 4  # proposals of a document that are compared in a round
SHORT_LIST = 64  # the pairs of a shorter list are filtered one by one, to the same result
NODES = 1 << 62  # texts of an id that has several are nodes from here on
LIGHT_MAX = 24  # no larger set is considered for enumeration
SPACES = flat.byte_mask(flat.SPACES)
SET_SCHEMA = "doc_id long, n long, f1 long, f2 long, tokens binary, counts binary"


def least_overlap(n, m):
    """Smallest intersection of linked sets of sizes ``n`` and ``m``: 7 * overlap >= 3 * (n + m)."""
    return -(-3 * (n + m) // 7)


def least_partner(n):
    """Smallest size of a set that can be linked with one of size ``n``."""
    return -(-3 * n // 4)


def shingle_sets(batch: pa.RecordBatch, text: str, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    buf, starts, ends = flat.text_bytes(flat.column(batch, text))
    ws, we, first = flat.word_bounds(buf, starts, ends, SPACES)
    h = flat.range_hashes(buf, ws, we)
    rolled = h[:max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        rolled = flat.mix(rolled) + h[k:k + len(rolled)]
    rolled = flat.mix(rolled)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= width:
            out.append(np.unique(rolled[s:e - width + 1]))
        elif e > s:
            x = np.full(1, e - s, np.uint64)
            for k in range(s, e):
                x = flat.mix(x) + h[k]
            out.append(flat.mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([flat.mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    b = np.array([flat.mix(s + flat.U(0x51ED27)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return a, b


META = np.dtype([("doc", "<i8"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8")])


def _token_blocks(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Rows (bucket, block, payload): shingles by bucket, in order, and one list of documents per block in a bucket of its own."""
    labels = even_labels(docs, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        for batch in flat.slices(batches, "text", SLICE):
            for at in range(0, batch.num_rows, 60_000):
                piece = batch.slice(at, 60_000)
                block, turn = (part << 24) | turn, turn + 1
                sets = shingle_sets(piece, "text", width)
                ids = flat.longs(flat.column(piece, "doc_id"))
                f1, f2 = fingerprints(sets)
                meta = np.zeros(len(sets), META)
                meta["doc"], meta["n"], meta["f1"], meta["f2"] = ids, [len(s) for s in sets], f1, f2
                order = np.lexsort((ids, f2, f1, meta["n"]))  # of equal sets in a block only the smallest id sends its shingles
                m = meta[order]
                new = np.ones(len(m), bool)
                new[1:] = (m["n"][1:] != m["n"][:-1]) | (m["f1"][1:] != m["f1"][:-1]) | (m["f2"][1:] != m["f2"][:-1])
                senders = np.sort(order[new])
                keys = np.concatenate([sets[i] for i in senders]) if len(senders) else np.zeros(0, np.uint64)
                owner = np.repeat(senders.astype(np.uint16), [len(sets[i]) for i in senders])
                order = np.argsort(keys)
                bounds = np.searchsorted(bucket_of(keys[order], buckets), np.arange(buckets + 1))
                rows = [(turn % buckets, block, b"M" + meta.tobytes())]
                for b in range(buckets):
                    o = order[bounds[b]:bounds[b + 1]]
                    if len(o):
                        present, place = np.unique(owner[o], return_inverse=True)
                        head = np.array([len(o), len(present)], np.int64).tobytes()
                        rows.append((b, block, b"T" + head + present.tobytes() + f1[present].tobytes() + place.astype(np.uint16).tobytes() + keys[o].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(labels[[r[0] for r in rows]]), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "payload"])

    return docs.mapInArrow(run, "bucket int, block long, payload binary")


def _payload_batches(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i:i + 64]], pa.int64()), pa.array([r[1] for r in rows[i:i + 64]], pa.binary())],
                                         names=["block", "payload"])


def _by_block(found: list[tuple[np.ndarray, ...]]) -> list[tuple[int, bytes]]:
    block, owner, counts, key = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(block, kind="stable")
    starts, sizes = runs(block[order])
    places = [order[s:s + n] for s, n in zip(starts, sizes)]
    return [(int(block[o[0]]), b"T" + owner[o].tobytes() + counts[o].tobytes() + key[o].tobytes()) for o in places]


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the shingles that occur in two different sets, with their number of sets; lists of documents pass through.

    The bucket's keys are counted range by range, so a task holds little more than the payloads it received.
    """
    parts = []
    for batch in batches:
        passed = []
        for block, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if p[:1] == b"M":
                passed.append((block, p))
                continue
            n, k = np.frombuffer(p, np.int64, 2, 1)
            present = np.frombuffer(p, np.uint16, k, 17)
            f1 = np.frombuffer(p, np.uint64, k, 17 + 2 * k)
            place = np.frombuffer(p, np.uint16, n, 17 + 10 * k)
            parts.append((block, present, f1, place, np.frombuffer(p, np.uint64, n, 17 + 10 * k + 2 * n)))
        yield from _payload_batches(passed)
    if not parts:
        return
    low, high = min(int(p[-1][0]) for p in parts), max(int(p[-1][-1]) for p in parts)
    ranges = -(-sum(len(p[-1]) for p in parts) // RANGE)
    edges = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    bounds = [[0, *np.searchsorted(p[-1], edges).tolist(), len(p[-1])] for p in parts]
    found, held = [], 0
    for i in range(ranges):
        cuts = [(*p, slice(b[i], b[i + 1])) for p, b in zip(parts, bounds) if b[i] < b[i + 1]]
        if cuts:
            keys = np.concatenate([keys[s] for *_, keys, s in cuts])
            order = np.argsort(keys, kind="stable")
            starts, sizes = runs(keys[order])
            prints = np.concatenate([f1[place[s]] for _, _, f1, place, _, s in cuts])[order]
            many = np.minimum.reduceat(prints, starts) != np.maximum.reduceat(prints, starts)
            kept = order[np.repeat(many, sizes)]
            blocks = np.repeat(np.array([c[0] for c in cuts], np.int64), [c[-1].stop - c[-1].start for c in cuts])
            owners = np.concatenate([present[place[s]] for _, present, _, place, _, s in cuts])
            found.append((blocks[kept], owners[kept], np.repeat(sizes[many], sizes[many]).astype(np.uint32), keys[kept]))
            held += len(kept)
        if held >= RANGE or held and i == ranges - 1:
            yield from _payload_batches(_by_block(found))
            found, held = [], 0


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; repeated shingles (by count, then hash) only where enough of them may be shared."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(block, []).append(p)
    for block in sorted(held):
        payloads = held.pop(block)
        meta = np.concatenate([np.frombuffer(p, META, offset=1) for p in payloads if p[:1] == b"M"])
        owner, counts, keys = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for p in payloads:
            if p[:1] == b"T":
                n = (len(p) - 1) // 14
                owner.append(np.frombuffer(p, np.uint16, n, 1))
                counts.append(np.frombuffer(p, np.uint32, n, 1 + 2 * n))
                keys.append(np.frombuffer(p, np.uint64, n, 1 + 6 * n))
        owner, counts, keys = np.concatenate(owner), np.concatenate(counts), np.concatenate(keys)
        order = np.lexsort((keys, counts, owner))
        owner, counts, keys = owner[order], counts[order], keys[order]
        at = np.searchsorted(owner, np.arange(len(meta) + 1))
        enough = (np.diff(at) >= least_partner(meta["n"])) & (meta["n"] > 0)
        tokens = [keys[s:e].tobytes() if ok else None for s, e, ok in zip(at[:-1], at[1:], enough)]
        numbers = [counts[s:e].tobytes() if ok else None for s, e, ok in zip(at[:-1], at[1:], enough)]
        for i in range(0, len(meta), 5000):
            part = slice(i, i + 5000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(meta["doc"][part]), pa.array(meta["n"][part]), pa.array(meta["f1"][part].view(np.int64)), pa.array(meta["f2"][part].view(np.int64)),
                 pa.array(tokens[part], pa.binary()), pa.array(numbers[part], pa.binary())], names=["doc_id", "n", "f1", "f2", "tokens", "counts"])


def repeated_shingles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, f1, f2, tokens, counts) of every document; ``tokens`` only for possible members of a link."""
    buckets = bucket_count(docs)
    counted = exchanged(_token_blocks(docs, buckets, width), buckets).mapInArrow(_count_tokens, "block long, payload binary")
    return counted.repartition(buckets, "block").mapInArrow(_document_rows, SET_SCHEMA)


def prefix_length(n, repeated):
    """Repeated shingles in the prefix: any linked set shares one of them. Shingles of one set only come first and meet nothing."""
    return np.maximum(n - least_partner(n) + 1 - (n - repeated), 0)


MEETINGS = 4  # shared prefix shingles that a pair is asked for, where its sizes allow it


def needed_meetings(n, m):
    """Meetings k that linked sets of sizes n <= m have among their first n - overlap + k and m - overlap + k shingles.

    Both ranges must lie inside the stored prefixes; a size ratio near the limit leaves only one meeting.
    """
    return np.minimum(MEETINGS, least_overlap(n, m) - least_partner(m) + 1)


#: own: shingles that no other set has; s0, s1: parity bits of the repeated ones.
POSTING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("comp", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("n", "<i4"), ("pos", "<i4"), ("own", "<i4")])


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits per set: whether an odd number of its shingles falls into each of 128 bins.

    Sets whose bits differ in d places differ in at least d shingles, so the bits refuse pairs
    without a comparison and never refuse a linked pair.
    """
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    odd = np.bincount((row << 7) | (flat.mix(keys) >> flat.U(57)).astype(np.int64), minlength=len(sets) << 7) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view("<u8")


def differences(r: np.ndarray, a, b) -> np.ndarray:
    """Fewest shingles that only one of the two sets can have."""
    bits = np.bitwise_count(r["s0"][a] ^ r["s0"][b]).astype(np.int64) + np.bitwise_count(r["s1"][a] ^ r["s1"][b])
    return bits + r["own"][a] + r["own"][b]


def most_differences(n, m):
    """Most shingles that only one of two linked sets has."""
    return n + m - 2 * least_overlap(n, m)


def _prefix_blocks(sets: DataFrame, buckets: int, light: int) -> DataFrame:
    """Postings of the prefixes of all sets that may be linked with a set above the boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            sets_of_batch = [np.frombuffer(t, np.uint64) for t in flat.pylist(batch, "tokens")]
            for doc, comp, n, keys, bits in zip(*(flat.pylist(batch, c) for c in ("doc_id", "comp", "n")), sets_of_batch, parity_bits(sets_of_batch)):
                if 4 * n < 3 * (light + 1):
                    continue
                p = int(prefix_length(n, len(keys)))
                r = np.zeros(p, POSTING)
                r["key"], r["doc"], r["comp"], r["n"], r["own"] = keys[:p], doc, comp, n, n - len(keys)
                r["s0"], r["s1"], r["pos"] = bits[0], bits[1], n - len(keys) + np.arange(p)
                parts.append(r)
            if parts:
                yield block_batch(packed(np.concatenate(parts), buckets))

    return sets.select("doc_id", "comp", "n", "tokens").mapInArrow(run, "bucket int, payload binary")


def _sorted_postings(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = gathered(batches, POSTING)
    r = r[np.lexsort((r["doc"], r["n"], r["key"]))]
    return (r, *runs(r["key"]))


def _pair_batches(low: np.ndarray, high: np.ndarray, need: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b, number) of distinct pairs, with the number that they need if given."""
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(low)))
    for i in range(0, len(starts), 100_000):
        s = starts[i:i + 100_000]
        columns = [pa.array(low[s]), pa.array(high[s]), pa.array(counts[i:i + 100_000])]
        if need is None:
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "meetings"])
        else:
            yield pa.RecordBatch.from_arrays([*columns, pa.array(need[order][s])], names=["a", "b", "meetings", "need"])


def _proposals(light: int, turn: int):
    """Each member of a list with two of its hubs or its neighbor in size: the likest by parity bits, in another component.

    Hubs are the members whose ids hash smallest under the seeds of the turn, so the lists that
    hold a hub agree on it, and another turn has other hubs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, starts, sizes = _sorted_postings(batches)
        if not len(r):
            return
        number = np.repeat(np.arange(len(starts)), sizes)
        new = np.ones(len(r), bool)
        new[1:] = (number[1:] != number[:-1]) | (r["comp"][1:] != r["comp"][:-1])
        begins = np.flatnonzero(new)
        best = [(np.full(len(r), np.iinfo(np.int64).max), np.full(len(r), -1)) for _ in range(2)]  # differences and partner
        (near, who), (next_near, next_who) = best

        def offer(b: np.ndarray) -> None:
            at = np.flatnonzero((b >= 0) & (number == number[b]) & (r["comp"] > r["comp"][b]))
            b = b[at]
            n, m = r["n"][at].astype(np.int64), r["n"][b].astype(np.int64)
            far = differences(r, at, b)
            good = (far <= most_differences(n, m)) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.maximum(n, m) > light)
            at, b, far = at[good], b[good], far[good]
            first = far < near[at]
            second = ~first & (far < next_near[at]) & (b != who[at])
            i = at[first]
            next_near[i], next_who[i] = near[i], who[i]
            near[i], who[i] = far[first], b[first]
            i = at[second]
            next_near[i], next_who[i] = far[second], b[second]

        offer(begins[np.cumsum(new) - 1] - 1)  # the last member before the stretch of one's own component
        for seed in range(HUBS << turn, HUBS << (turn + 1)):
            h = flat.mix(r["doc"].view(np.uint64) + flat.mix(np.full(1, seed + 1, np.uint64)))
            mark = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, starts), sizes))
            hub = np.zeros(len(starts), np.int64)
            hub[number[mark]] = mark
            offer(hub[number])
        a, b = np.concatenate([np.flatnonzero(w >= 0) for _, w in best]), np.concatenate([w[w >= 0] for _, w in best])
        yield from _pair_batches(r["doc"][a], r["doc"][b])

    return run


def _with_partners(n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Members of a list, ordered by size, whose own shingles leave room for a link with some size of the list."""
    sizes, first, place = np.unique(n, return_index=True, return_inverse=True)
    fewest = np.minimum.reduceat(own, first)  # own shingles of the likest member of each size
    most = np.full(len(sizes), -1)
    for i, m in enumerate(sizes.tolist()):
        j = slice(*np.searchsorted(sizes, [least_partner(m), 4 * m // 3 + 1]))
        most[i] = (most_differences(m, sizes[j]) - fewest[j]).max()
    return own <= most[place]


def _remaining(light: int):
    """All pairs of a list in different components that pass the size, position and parity filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, starts, sizes = _sorted_postings(batches)
        if not len(r):
            return
        mixed = np.minimum.reduceat(r["comp"], starts) != np.maximum.reduceat(r["comp"], starts)
        left, right, needs, held = [], [], [], 0
        for s, size in zip(starts[mixed].tolist(), sizes[mixed].tolist()):
            part = r[s:s + size]
            doc, comp, n, pos = (part[c].astype(np.int64) for c in ("doc", "comp", "n", "pos"))
            able = _with_partners(n, part["own"].astype(np.int64)) if size > SHORT_LIST else np.ones(size, bool)
            values, members = np.unique(comp, return_counts=True)
            most_common = values[members.argmax()]
            for i in np.flatnonzero((comp != most_common) & able).tolist():  # one side of every pair is outside the largest component
                j = np.arange(*np.searchsorted(n, [least_partner(n[i]), 4 * n[i] // 3 + 1]))
                j = j[able[j] & (comp[j] != comp[i]) & ((comp[j] == most_common) | (j > i)) & (np.maximum(n[j], n[i]) > light)]
                overlap, need = least_overlap(n[i], n[j]), needed_meetings(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]))
                late = need - 1 - overlap  # linked sets meet that often before these places
                most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
                good = (most >= overlap) & (pos[i] <= n[i] + late) & (pos[j] <= n[j] + late) & (differences(part, i, j) <= most_differences(n[i], n[j]))
                if good.any():
                    other = doc[j][good]
                    left.append(np.minimum(other, doc[i]))
                    right.append(np.maximum(other, doc[i]))
                    needs.append(need[good])
                    held += len(right[-1])
            if held > 2_000_000:
                yield from _pair_batches(*map(np.concatenate, (left, right, needs)))
                left, right, needs, held = [], [], [], 0
        if held:
            yield from _pair_batches(*map(np.concatenate, (left, right, needs)))

    return run


def _light_keys(sets: DataFrame, light: int) -> DataFrame:
    """(key, lo, hi, doc_id, n): hashed subsets of the size that linked sets of sizes lo and hi share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, tokens in zip(*(flat.pylist(batch, c) for c in ("doc_id", "n", "tokens"))):
                own = np.sort(np.frombuffer(tokens, np.uint64))
                for m in range(least_partner(n), min(light, 4 * n // 3) + 1):
                    size = least_overlap(n, m)
                    if size > len(own):
                        continue
                    at = np.array(list(itertools.combinations(range(len(own)), size)), np.int64)
                    h = np.full(len(at), size, np.uint64)
                    for k in range(size):
                        h = flat.mix(h) + own[at[:, k]]
                    h = flat.mix(h).view(np.int64)
                    same = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(np.full(same, min(n, m))), pa.array(np.full(same, max(n, m))), pa.array(np.full(same, doc)), pa.array(np.full(same, n))],
                        names=["key", "lo", "hi", "doc_id", "n"])

    return sets.where(F.col("n") <= light).select("doc_id", "n", "tokens").mapInArrow(run, "key long, lo long, hi long, doc_id long, n long")


def light_pairs(sets: DataFrame, light: int) -> DataFrame:
    """Pairs of light sets with a common subset; inside one key both sizes meet through their smallest document."""
    keys = _light_keys(sets, light)
    ends = keys.groupBy("key", "lo", "hi").agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("doc_id"))).alias("low"),
                                               F.min(F.when(F.col("n") == F.col("hi"), F.col("doc_id"))).alias("high"), F.count("*").alias("members"))
    both = keys.join(ends.where("members > 1"), ["key", "lo", "hi"])
    other = F.when(F.col("n") == F.col("lo"), F.col("high")).otherwise(F.col("low"))
    return both.select(F.least("doc_id", other).alias("a"), F.greatest("doc_id", other).alias("b")).where("a < b").distinct()


def enumeration_cost(n: int, repeated: int, most: int = LIGHT_MAX) -> int:
    return sum(comb(repeated, least_overlap(n, m)) for m in range(least_partner(n), min(most, 4 * n // 3) + 1))


def light_boundary(sets: DataFrame) -> int:
    """Largest set size up to which enumerating subsets costs no more than scanning lists; 0 if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, scan, enum = [], [], []
            for n, tokens, counts in zip(*(flat.pylist(batch, c) for c in ("n", "tokens", "counts"))):
                repeated = len(tokens) // 8
                size.append(n)
                scan.append(int(np.frombuffer(counts, np.uint32)[:int(prefix_length(n, repeated))].sum()))
                enum.append(float(enumeration_cost(n, repeated)))
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(scan, pa.int64()), pa.array(enum, pa.float64())], names=["n", "scan", "enumerate"])

    costs = sets.where(F.col("n") <= LIGHT_MAX).select("n", "tokens", "counts").mapInArrow(run, "n long, scan long, enumerate double")
    rows = sorted(costs.groupBy("n").agg(F.sum("scan"), F.sum("enumerate")).collect())  # at most LIGHT_MAX rows
    best, gain, at = 0.0, 0.0, 0
    for n, scan, enum in rows:
        gain += scan - enum
        if gain >= best:
            best, at = gain, n
    return at


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for na, nb, ta, tb in zip(*(flat.pylist(batch, c) for c in ("na", "nb", "ta", "tb"))):
                shared = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                good.append(7 * shared >= 3 * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _one_text_per_node(stored: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a node as ``doc_id`` that has one text, and edges from ids with several texts to their nodes, if any."""
    texts = F.struct("n", "f1", "f2")
    several = materialize(stored.where("n > 0").groupBy("doc_id").agg(F.min(texts).alias("a"), F.max(texts).alias("b")).where("a <> b").select("doc_id"), "several")
    if several.isEmpty():
        return stored, None
    node = F.xxhash64("n", "f1", "f2").bitwiseAND(F.lit(NODES - 1)) + F.lit(NODES)
    marked = materialize(stored.join(several.withColumn("many", F.lit(True)), "doc_id", "left")
                         .withColumn("node", F.when(F.col("many"), node).otherwise(F.col("doc_id"))), "nodes")
    names = marked.where("many AND n > 0").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    return marked.drop("doc_id", "many").withColumnRenamed("node", "doc_id"), names


def _named(components: DataFrame, names: DataFrame) -> DataFrame:
    """Components of ids alone, each named by its smallest id."""
    ids = components.join(names.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
    return ids.join(ids.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


def near_duplicate_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = F.col("tokens").isNotNull()
    with small_batches(df.sparkSession):  # texts and payloads reach the workers in small batches
        read = materialize(repeated_shingles(docs.where("doc_id IS NOT NULL"), width).withColumn("sent", sent), "shingles")
    stored, names = _one_text_per_node(read)
    buckets = bucket_count(df)
    speaker = F.coalesce(F.min(F.when(F.col("sent"), F.col("doc_id"))), F.min("doc_id"))  # of a possible link only some rows carry the set
    classes = stored.where("n > 0").groupBy("n", "f1", "f2").agg(speaker.alias("rep"), F.count("*").alias("members"))
    members = materialize(stored.select("doc_id", "n", "f1", "f2").join(classes.where("members > 1"), ["n", "f1", "f2"]).select("doc_id", "rep"), "members")
    possible = stored.where("tokens IS NOT NULL").select("doc_id", "n", "tokens", "counts")
    others = members.where("doc_id <> rep").select("doc_id").distinct()
    sets = materialize(possible.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "n"]).withColumn("comp", F.col("doc_id")), "sets")

    light = light_boundary(sets)
    links, marked = materialize(verified(light_pairs(sets, light), sets), "links"), sets
    for turn in range(TURNS):  # cheap links first; the exact search below only sees what they leave apart
        proposed = exchanged(_prefix_blocks(marked, buckets, light), buckets).mapInArrow(_proposals(light, turn), "a long, b long, meetings long")
        counted = proposed.groupBy("a", "b").agg(F.sum("meetings").alias("meetings"))
        best = W.partitionBy("a").orderBy(F.desc("meetings"), "b")  # a document has few proposals: its hubs and neighbors
        tried = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIES).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = materialize(verified(tried.distinct(), sets), "links")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        known = connected_components(links)
        marked = materialize(sets.drop("comp", "counts").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "comp", F.coalesce("component", "doc_id")).drop("component"), "marked")
    rest = (exchanged(_prefix_blocks(marked, buckets, light), buckets).mapInArrow(_remaining(light), "a long, b long, meetings long, need long")
            .groupBy("a", "b").agg(F.sum("meetings").alias("meetings"), F.max("need").alias("need")).where("meetings >= need"))
    more = materialize(verified(rest, marked), "more")
    edges = links.unionByName(more).unionByName(members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = connected_components(edges) if names is None else _named(connected_components(edges.unionByName(names)), names)
    sizes = read.select("doc_id", F.col("n").alias("n_shingles"))
    found = sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.unionByName(_without_id(docs.where("doc_id IS NULL"), width))


def _without_id(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            sizes = [len(s) for s in shingle_sets(batch, "text", width)]
            nulls = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, pa.array(sizes, pa.int64()), nulls], names=["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


@query("op9_heavy_light_join")
def op9_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and class of all documents."""
    return near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
