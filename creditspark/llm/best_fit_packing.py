"""Hierarchical residual packing of token sequences.

Documents are tokenized once; longer ones are cut into full pieces. Every piece shorter
than a sequence is an item. Partitions of bounded size pack their items by best
fit, largest first; bins that are nearly full are emitted, and the underfull bins
are merged as items in the next, smaller round of partitions, until one
partition is left or a round closes fewer than ``MIN_GAIN`` of its bins.

A bin carries the list of its pieces, at most ``capacity`` of them, so no join resolves
the merges. No task ever holds more than about ``GROUP`` items.

Defined results: a null text is packed as an empty one (only the end mark); repeated
rows are packed once each; an empty table gives an empty result; other columns
are ignored. Each round is written to the shared folder, so a lost executor repeats a
round at most.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
GROUP = 1 << 16  # items packed by one task
NEARLY_FULL = 0.995
MIN_GAIN = 0.002
CACHE_WORDS = 400_000
#: Letters whose lower case and composition do not depend on their neighbors, then marks that are one pre-token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]*)")


class WordTokens(dict):
    """Chunk of text without spaces -> its ids as little-endian bytes.

    The vocabulary splits at white space before merging, so the ids of a text are
    the ids of its chunks. The table is emptied when large: it is a cache only.
    """

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.parts = self.tokenizer.model, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level vocabularies
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, chunk: str) -> bytes:
        m = PLAIN.fullmatch(chunk)
        ids = self._part(m[1].lower()) + self._part(m[2]) if m else self._encode(chunk)
        self[chunk] = ids
        return ids

    def _encode(self, chunk: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if (ids := self.parts.get(part)) is None:
            piece = part.encode().decode("latin1").translate(self.alphabet)
            ids = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(piece))
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENS: dict[str, WordTokens] = {}


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """File of a public vocabulary; ``folder`` overrides the installed place."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per piece: its document, place, start, length and checksum of its ids."""
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(VOCABULARY, folder)
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        tokens = _TOKENS[path]
        for batch in flat.slices(batches, text, 8 << 20):
            source, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(flat.pylist(batch, text)):
                ids = (tokens.encode(t) if t else b"") + END_ID.to_bytes(4, "little")
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    source.append(row)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids_column = flat.column(batch, doc_id).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_column, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[doc_id, "piece", "start", "length", "ids_crc32"])

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers per bin: items by falling size, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}  # free room -> bins
    rooms: list[int] = []  # the distinct free rooms, ascending
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(item)
        left = room - size
        if left:
            if left not in open_at:
                open_at[left] = []
                bisect.insort(rooms, left)
            open_at[left].append(b)
    return bins


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack rows (item long, length long; lengths at most ``capacity``) into bins.

    Returns (item, sequence_id, offset). ``item`` must be unique.
    """
    done = None
    full = items.where(F.col("length") >= capacity).select(F.array("item").alias("items"), F.array("length").alias("lengths"), F.col("length").alias("filled"))
    bins = items.where(F.col("length") < capacity).select(F.array("item").alias("items"), F.array("length").alias("lengths"), F.col("length").alias("filled"))
    parts, last, turn = [full], None, 0
    while True:
        n = bins.count()
        groups = -(-n // group)
        if not n or (last is not None and (n > (1 - MIN_GAIN) * last[0] or last[1] == 1)):
            parts.append(bins)
            break
        packed = materialize(_round(bins, groups, turn, capacity), f"packing-{turn}")
        limit = int(NEARLY_FULL * capacity)
        parts.append(packed.where(F.col("filled") >= limit))
        bins, last, turn = packed.where(F.col("filled") < limit), (n, groups), turn + 1
    for p in parts:
        done = p if done is None else done.unionByName(p)
    return done.mapInArrow(_places, "item long, sequence_id long, offset long")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item of each bin; a bin is named by its first item."""
    for batch in batches:
        items, lengths = flat.column(batch, "items"), flat.column(batch, "lengths")
        counts = items.value_lengths().to_numpy(zero_copy_only=False)
        sizes = lengths.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        before = np.repeat((ends - sizes)[first] if len(first) else ends, counts)
        names = items.flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.repeat(names[first], counts)), pa.array(ends - sizes - before)],
                                         names=["item", "sequence_id", "offset"])


def _round(bins: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Best fit inside ``groups`` evenly filled partitions; another grouping in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one group, at most about GROUP bins
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        items, lengths, filled = (rows.column(c).combine_chunks() for c in ("items", "lengths", "filled"))
        found = best_fit(filled.to_pylist(), capacity)
        order = pa.array([i for b in found for i in b], pa.int64())
        sizes = [len(b) for b in found]
        counts = items.value_lengths().take(order).to_pylist()
        offsets, at, k = [0], 0, 0
        for s in sizes:
            at += sum(counts[k:k + s])
            k += s
            offsets.append(at)
        offsets = pa.array(offsets, pa.int32())
        merged_items = pa.ListArray.from_arrays(offsets, items.take(order).flatten())
        merged_lengths = pa.ListArray.from_arrays(offsets, lengths.take(order).flatten())
        sums = [sum(filled_values) for filled_values in _chunks(filled.take(order).to_pylist(), sizes)]
        out = pa.RecordBatch.from_arrays([merged_items, merged_lengths, pa.array(sums, pa.int64())], names=["items", "lengths", "filled"])
        for i in range(0, out.num_rows, 10_000):
            yield out.slice(i, 10_000)

    key = F.pmod(F.xxhash64(F.lit(turn), F.element_at("items", 1)), F.lit(groups))
    return bins.repartition(groups, key).mapInArrow(run, "items array<long>, lengths array<long>, filled long")


def _chunks(values: list[int], sizes: list[int]) -> Iterator[list[int]]:
    at = 0
    for s in sizes:
        yield values[at:at + s]
        at += s


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str | None = None,
                   group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    pieces = materialize(cut_pieces(df, doc_id, text, capacity, folder).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("item", "length"), capacity, group), "item").select(
        doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_hierarchical_packing")
def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
