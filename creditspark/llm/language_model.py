"""Trigram language model in Elias-Fano tries, trained and queried in Spark.

Words are told apart by 64-bit hashes; the most frequent ones (a table of bounded size, broadcast)
have their frequency rank as a short code. N-grams are dealt to cells by the hash of the
middle word of a trigram, which is the direct context of the predicted word, so one cell holds all that a query needs but the predicted
word's own count. A cell's trie has these levels, each a monotone sequence in Elias-Fano form with its
quantised values beside it, memory-mapped while it is queried:

* context words, with pointers into their successors and the weight left for the level below;
* successors of each context word, with the discounted bigram probability;
* words before a context word, with pointers and the weight left;
* successors of each pair, held as positions among the successors of the nearer word (a small
  universe), with the discounted trigram probability.

P(w | u v) = d3(u v w) + g(u v) * (d2(v w) + g(v) * P1(w)) with absolute discounting:
d = (count - discount) / count of the context, g = what the kept n-grams leave, P1 = (c + 1) / (N + V + 1).
The probabilities of all words, unseen ones as one, sum to 1, up to the quantisation.

Frequent context words: a cell with more n-grams than a task should hold is counted in several
parts by the predicted word, pruned there and only then joined; its queries are dealt to several copies of its trie. What stays
bounded by the language alone is the number of kept n-grams around one word.

Defined results: null and empty texts are a single end token; rows that repeat an id are scored by their own text; a null id
trains; an empty table gives an empty result, and a model of nothing scores all words alike; other columns are not looked at. Ids are cast to long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.llm import elias_fano, flat
from creditspark.llm.flat import U, mix
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

SLICE = 3 << 20
BATCH_BYTES = "4m"  # of an Arrow batch while texts are cut into n-grams
SHORT_CODES = 1 << 20  # most words with a code of their own: 16 MB of hashes and counts
CELL_TOKENS = 1 << 20  # n-gram occurrences one task holds at once
LEAST = (1, 2)  # occurrences a bigram and a trigram need to be kept
DISCOUNT = 0.75
STEPS = 2048  # quantisation steps per factor of ten
BEGIN, END = mix(np.array([1, 2], U))  # stand for the words around a text
SEPARATORS = flat.byte_mask(flat.SPACES)
CHUNK = 1 << 18  # n-grams scored at once
FIXED = float(1 << 22)  # a cell's sum for a text travels as a whole number of such parts
BUCKET_TEXTS = 20_000  # texts whose sums are added up in one task
PARTS = "bucket int, payload binary, texts binary, id long, sig int, h long, a double, b double"
TEXTS = (np.int64, np.uint8, np.int32, np.int64, np.int64, np.float64)  # id, whether it is null, sig, n_tokens, n_short, base_short


@dataclass
class NgramModel:
    unigrams: DataFrame  # (h, c) of all training tokens
    tries: DataFrame  # (cell, payload)
    codes: Broadcast  # (key, sorted hashes, their codes, counts by code)
    tokens: int  # N
    words: int  # V
    size: int  # bytes of the training texts
    loads: np.ndarray  # training tokens per cell


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of a few MB for the jobs run inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _sequences(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words between two begin marks and an end mark per text, which of them are predicted, and their row."""
    buf, starts, ends = flat.text_bytes(text)
    ws, we, first = flat.word_bounds(buf, starts, ends, SEPARATORS)
    rows, n = len(starts), len(ws)
    doc = np.repeat(np.arange(rows), np.diff(first))
    out, owner = np.full(n + 3 * rows, BEGIN, U), np.repeat(np.arange(rows, dtype=np.int32), np.diff(first) + 3)
    predicted = np.zeros(len(out), bool)
    at, end = np.arange(n) + 3 * doc + 2, first[1:] + 3 * np.arange(rows) + 2
    if n:
        out[at] = flat.range_hashes(buf, ws, we)
    out[end] = END
    predicted[at] = predicted[end] = True
    return out, np.flatnonzero(predicted), owner


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c) of all words and ends of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            h, at, _ = _sequences(flat.column(batch, "text"))
            key, n = np.unique(h[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["h", "c"])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _short_codes(unigrams: DataFrame, most: int):
    """The most frequent words, at most ``most``: sorted hashes, their codes by falling count, counts by code."""
    group = F.floor(4 * F.log2(F.col("c").cast("double"))).cast("int")
    sizes = {r["g"]: r["n"] for r in unigrams.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}  # at most 256 rows
    least, total = 256, 0
    for g in sorted(sizes, reverse=True):
        total += sizes[g]
        if total > most:
            break
        least = g
    got = unigrams.where(group >= least).toArrow()
    h, c = flat.longs(got.column("h").combine_chunks()).view(U), flat.longs(got.column("c").combine_chunks())
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    place = np.argsort(h)
    return uuid.uuid4().hex, h[place], place.astype(U), c


def _codes(shared, h: np.ndarray) -> np.ndarray:
    """Short code of a frequent word, the hash itself of any other."""
    _, known, code, _ = shared.value
    if not len(known):
        return h
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, code[at], h)


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return ((mix(h) >> U(32)) % U(cells)).astype(np.int64)


def _loads(unigrams: DataFrame, cells: int, texts: int) -> np.ndarray:
    """N-grams per cell, from the counts of the words that deal them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for batch in batches:
            h = flat.longs(flat.column(batch, "h")).view(U)
            n += np.bincount(_cell(h, cells), flat.longs(flat.column(batch, "c")) * (h != END), cells).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["cell", "n"])

    out = np.zeros(cells, np.int64)
    for r in unigrams.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    out[_cell(np.array([BEGIN]), cells)[0]] += texts
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    raw = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        raw.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def _joined(payloads: list[bytes], *kinds) -> list[np.ndarray]:
    parts = [_unpack(p, *kinds) for p in payloads]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in no order, and the place of each value among them."""
    coded = pc.dictionary_encode(pa.array(values), memory_pool=pa.system_memory_pool())  # gives its memory back at once
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct values of all columns, and each column as places among them."""
    values, place = _numbered(np.concatenate(columns))
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    return values[order], np.split(rank[place], np.cumsum([len(c) for c in columns])[:-1])


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by non-negative keys, the first one first; they are sorted as one number where that has at most 64 bits."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 64:
        return np.lexsort(keys[::-1])
    one = keys[0].astype(U)
    for k, b in zip(keys[1:], bits[1:]):
        one <<= U(b)
        one |= k.astype(U)
    return np.argsort(one)


class Trigrams:
    """All predicted words of a slice of texts with the two words before, sorted by cell, v, u, w; words as numbers into small tables.

    With ``wanted``, only those of the wanted cells.
    """

    def __init__(self, text: pa.Array, codes, cells: int, wanted: np.ndarray | None = None):
        h, at, owner = _sequences(text)
        words, place = _numbered(h)
        cell, code = _cell(words, cells), _codes(codes, words)
        by_cell = np.lexsort((code, cell))
        rank = np.empty(len(words), np.int32)
        rank[by_cell] = np.arange(len(words), dtype=np.int32)
        self.code, self.cells, self.hash = code[by_cell], cell[by_cell], words[by_cell]
        i = rank[place]
        del h, place
        self.text_words, self.text_rows = i[at], owner[at]  # as they follow in the texts
        if wanted is not None:
            at = at[wanted[self.cells[i[at - 1]]]]
        w, v, u = i[at], i[at - 1], i[at - 2]
        order = _order(v, u, w)
        self.u, self.v, self.w, self.row = u[order], v[order], w[order], owner[at[order]]

    def keep(self, which: np.ndarray) -> None:
        self.u, self.v, self.w, self.row = (x[which] for x in (self.u, self.v, self.w, self.row))

    def cell(self) -> np.ndarray:
        return self.cells[self.v]

    def coded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.code[self.v[which]], self.code[self.u[which]], self.code[self.w[which]]


def _blocks(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its positions in order)."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    starts = _firsts(g)
    for s, e in zip(starts, np.append(starts[1:], len(g))):
        yield int(g[s]), order[s:e]


def _training_blocks(texts: DataFrame, codes, splits: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(cell, part, payload): counted trigrams of a slice of texts, one row per wanted cell and part."""
    cells, base = len(splits), np.concatenate([[0], np.cumsum(splits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            t = Trigrams(flat.column(batch, "text"), codes, cells, None if wanted.all() else wanted)
            new = _firsts(t.v, t.u, t.w)
            n = np.diff(np.append(new, len(t.v))).astype(np.uint32)
            t.keep(new)
            cell = t.cell()
            part = (mix(t.hash[t.w] ^ U(5)) % splits[cell].astype(U)).astype(np.int64)
            rows = [(g, _pack(*t.coded(i), n[i])) for g, i in _blocks(base[cell] + part)]
            owner = np.searchsorted(base, [g for g, _ in rows], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner.astype(np.int32)), pa.array((np.array([g for g, _ in rows]) - base[owner]).astype(np.int32)),
                 pa.array([p for _, p in rows], pa.binary())], names=["cell", "part", "payload"])

    return texts.mapInArrow(run, "cell int, part int, payload binary")


def _kept(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, least: tuple[int, int]) -> list[tuple[np.ndarray, ...]]:
    """Kept trigrams (v, u, w, n), kept bigrams (v, w, n), all pairs (v, u, n) and all context words (v, n), from sorted distinct trigrams."""
    keep, bi = n >= least[1], _summed((v, w), n)
    return [tuple(x[keep] for x in (v, u, w, n)), tuple(x[bi[-1] >= least[0]] for x in bi), _runs((v, u), n), _runs((v,), n)]


def _runs(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with the sum of their counts, from sorted ones."""
    at = _firsts(*keys)
    return (*(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n)


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sum of their counts."""
    order = _order(*keys)
    return _runs(tuple(k[order] for k in keys), n[order].astype(U, copy=False))


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        q = np.rint(-STEPS * np.log10(np.maximum(p, 0)))
    return np.minimum(q, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return _RESTORED[q]


_RESTORED = np.append(10.0 ** (-np.arange(65535, dtype=np.float64) / STEPS), 0.0)


def _trie(counts: list[tuple[np.ndarray, ...]], codes: np.ndarray, discount: float) -> bytes:
    """The levels of one cell as a payload; words in ``counts`` are places among the sorted ``codes``."""
    (v3, u3, w3, n3), (v2, w2, n2), (vp, up, np_), (v1, n1) = counts
    used, context = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    used[w2] = used[u3] = True
    number, words = np.cumsum(used) - 1, codes[used]
    context[v1] = np.arange(len(v1))
    size = U(max(len(words), 1))
    one = context[v2]
    d2 = (n2 - discount) / n1[one]
    left1 = np.maximum(1 - np.bincount(one, d2, len(v1)), 0)
    successors = one.astype(U) * size + number[w2].astype(U)
    start = np.searchsorted(one, np.arange(len(v1) + 1))
    # pairs that have a kept trigram
    first = _firsts(v3, u3)
    pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v3))))
    pv = context[v3[first]]
    pairs = pv.astype(U) * size + number[u3[first]].astype(U)
    known = used[up]  # a word that no kept trigram begins with has no number
    everything = context[vp[known]].astype(U) * size + number[up[known]].astype(U)
    totals = np_[known][np.searchsorted(everything, pairs)] if len(pairs) else np.zeros(0, U)
    d3 = (n3 - discount) / totals[pair] if len(v3) else np.zeros(0)
    left2 = np.maximum(1 - np.bincount(pair, d3, len(first)), 0)
    base = np.concatenate([[0], np.cumsum(np.diff(start)[pv])])  # each pair has as many places as its nearer word has successors
    place = np.searchsorted(successors, context[v3].astype(U) * size + number[w3].astype(U)) - start[pv[pair]] if len(v3) else np.zeros(0, np.int64)
    return elias_fano.to_payload(
        elias_fano.encode("context", codes[v1]) | elias_fano.encode("word", words) | elias_fano.encode("successor", successors) | elias_fano.encode("start", start)
        | elias_fano.encode("pair", pairs) | elias_fano.encode("base", base) | elias_fano.encode("relative", base[pair] + place)
        | {"left1": quantised(left1), "d2": quantised(d2), "left2": quantised(left2), "d3": quantised(d3)})


class Trie:
    """Queries one cell; words are places among the sorted ``codes``."""

    def __init__(self, payload: bytes, codes: np.ndarray):
        arrays = elias_fano.mapped(payload)
        self.seq = {n: elias_fano.Sequence(arrays, n) for n in ("context", "word", "successor", "start", "pair", "base", "relative")}
        self.value = {n: arrays[n] for n in ("left1", "d2", "left2", "d3")}
        self.contexts, self.words = self.seq["context"].find(codes), self.seq["word"].find(codes)

    def mixture(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) such that P(w | u v) = a + b * P1(w)."""
        a, b = np.zeros(len(u)), np.ones(len(u))
        at = np.flatnonzero(self.contexts[1][v])
        one, size = self.contexts[0][v[at]], U(max(self.seq["word"].n, 1))
        b[at] = restored(self.value["left1"][one])
        (w_no, w_known), (u_no, u_known) = ([x[k[at]] for x in self.words] for k in (w, u))
        two, has2 = self.seq["successor"].find(one.astype(U) * size + w_no.astype(U))
        has2 &= w_known
        a[at[has2]] = restored(self.value["d2"][two[has2]])
        pair, has_pair = self.seq["pair"].find(one.astype(U) * size + u_no.astype(U))
        has_pair &= u_known
        p = at[has_pair]
        left = restored(self.value["left2"][pair[has_pair]])
        a[p] *= left
        b[p] *= left
        both = has_pair & has2
        relative = two[both].astype(U) - self.seq["start"].get(one[both])
        three, has3 = self.seq["relative"].find(self.seq["base"].get(pair[both]) + relative)
        a[at[both][has3]] += restored(self.value["d3"][three[has3]])
        return a, b


def _counted(texts: DataFrame, short_codes: int, cell_tokens: int) -> NgramModel:
    """The word counts, short codes and loads of a model, without tries."""
    spark = texts.sparkSession
    with small_batches(spark):
        unigrams = materialize(count_words(texts), "unigrams")
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    tokens, words = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    codes = spark.sparkContext.broadcast(_short_codes(unigrams, short_codes))
    loads = _loads(unigrams, max(1, -(-tokens // cell_tokens)), rows)
    return NgramModel(unigrams, spark.createDataFrame([], "cell int, payload binary"), codes, tokens, words, size, loads)


def _splits(loads: np.ndarray, cell_tokens: int) -> np.ndarray:
    return np.maximum(1, -(-loads // (2 * cell_tokens)))


def _tries(texts: DataFrame, model: NgramModel, least: tuple[int, int], discount: float, cell_tokens: int, wanted: np.ndarray) -> DataFrame:
    """(cell, payload) of the wanted cells."""
    splits = _splits(model.loads, cell_tokens)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        *words, n = _joined(rows.column("payload").to_pylist(), U, U, U, np.uint32)
        codes, words = _ranked(words)
        counts = _kept(*_summed(tuple(words), n), least)
        if splits[cell] == 1:
            return _trie_row(cell, True, [_trie(counts, codes, discount)])
        return _trie_row(cell, False, [_pack(*(codes[k] for k in c[:-1]), c[-1]) for c in counts])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        kinds = [(U,) * 4, (U,) * 3, (U,) * 3, (U,) * 2]
        parts = rows.column("parts").to_pylist()
        columns = [_joined([p[i] for p in parts], *kind) for i, kind in enumerate(kinds)]
        codes, words = _ranked([k for c in columns for k in c[:-1]])
        words = iter(words)
        return _trie_row(key[0].as_py(), True, [_trie([_summed(tuple(next(words) for _ in c[:-1]), c[-1]) for c in columns], codes, discount)])

    schema = "cell int, done boolean, parts array<binary>"
    counted = _training_blocks(texts, model.codes, splits, wanted).groupBy("cell", "part").applyInArrow(count, schema)
    with small_batches(texts.sparkSession):
        counted = materialize(counted, "counted")
    if (splits[wanted] > 1).any():
        counted = counted.where("done").unionByName(counted.where("NOT done").groupBy("cell").applyInArrow(join, schema))
        counted = materialize(counted, "tries")
    return counted.select("cell", F.col("parts")[0].alias("payload"))


def fit_ngrams(df: DataFrame, text: str = "text", least: tuple[int, int] = LEAST, discount: float = DISCOUNT, short_codes: int = SHORT_CODES,
               cell_tokens: int = CELL_TOKENS) -> NgramModel:
    """Counts of all words and n-grams of ``text``, as a table of tries by cell."""
    _check(least)
    texts = df.select(F.col(text).cast("string").alias("text"))
    model = _counted(texts, short_codes, cell_tokens)
    return replace(model, tries=_tries(texts, model, least, discount, cell_tokens, np.ones(len(model.loads), bool)))


def _check(least: tuple[int, int]) -> None:
    if least[0] > least[1]:
        raise ValueError("a kept trigram needs its bigram: least[0] must not exceed least[1]")


def _trie_row(cell: int, done: bool, parts: list[bytes]) -> pa.Table:
    return pa.table({"cell": pa.array([cell], pa.int32()), "done": [done], "parts": pa.array([parts], pa.list_(pa.binary()))})


def _query_blocks(rows: DataFrame, codes, copies: np.ndarray, total: float) -> DataFrame:
    """(cell, copy, payload, docs): the trigrams of a slice of texts by cell, and the texts they belong to.

    What a text has by itself (``TEXTS``) follows as ``docs`` of cell -1, with the task as copy.
    """
    cells = len(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, task = np.log10((codes.value[3] + 1) / total), TaskContext.get().partitionId()
        for batch in flat.slices(batches, "text", SLICE):
            ids, sigs = flat.longs(flat.column(batch, "id")), flat.longs(flat.column(batch, "sig")).astype(np.int32)
            train = flat.longs(flat.column(batch, "train")).astype(np.uint8)
            t = Trigrams(flat.column(batch, "text"), codes, cells)
            cell = t.cell()
            copy = (mix(ids.view(U))[t.row] % copies[cell].astype(U)).astype(np.int64)
            out = [(-1, task, None, _pack(ids, np.asarray(flat.column(batch, "doc_id").is_null()).astype(np.uint8), sigs, *_alone(t, logs, len(ids))))]
            for g, i in _blocks(cell * int(copies.max(initial=1)) + copy):
                seen = np.zeros(len(ids), bool)
                seen[t.row[i]] = True
                docs, local = np.flatnonzero(seen), (np.cumsum(seen) - 1)[t.row[i]]
                out.append((cell[i[0]], copy[i[0]], _pack(*t.coded(i), local.astype(np.uint32)), _pack(ids[docs], sigs[docs], train[docs])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["cell", "copy", "payload", "docs"])

    return rows.mapInArrow(run, "cell int, copy int, payload binary, docs binary")


def _alone(t: Trigrams, logs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its tokens, those with a short code, and the sum of these ones' logarithms."""
    short, log = t.code < U(len(logs)), np.zeros(len(t.code))
    log[short] = logs[t.code[short].astype(np.int64)]
    return (np.bincount(t.text_rows, minlength=rows), np.bincount(t.text_rows[short[t.text_words]], minlength=rows),
            np.bincount(t.text_rows, log[t.text_words], rows))


class Occurrences:
    """The n-grams of all blocks of a cell: ``codes`` of its words, distinct n-grams in order, and for each occurrence its n-gram and text."""

    def __init__(self, payloads: list[bytes], docs: list[list[np.ndarray]]):
        known, columns, owner, shift = [], [], [], 0
        for p, d in zip(payloads, docs):  # block by block, so that codes are never held whole
            *words, local = _unpack(p, U, U, U, np.uint32)
            codes, words = _ranked(words)
            known.append(codes)
            columns.append(words)
            owner.append((local + shift).astype(np.int32))
            shift += len(d[0])
        self.owner = np.concatenate(owner)
        del owner
        self.codes = np.unique(np.concatenate(known))
        for i, codes in enumerate(known):
            rank = np.searchsorted(self.codes, codes).astype(np.int32)
            columns[i] = [rank[c] for c in columns[i]]
        v, u, w = (np.concatenate(c) for c in zip(*columns))
        del known, columns
        contexts = np.zeros(len(self.codes), bool)
        contexts[v] = True
        self.order = _order((np.cumsum(contexts, dtype=np.int32) - 1)[v], u, w).astype(np.int32)
        v, u, w = v[self.order], u[self.order], w[self.order]
        self.first = _firsts(v, u, w)
        self.v, self.u, self.w = v[self.first], u[self.first], w[self.first]
        self.ngram = np.empty(len(v), np.int32)
        self.ngram[self.order] = np.repeat(np.arange(len(self.first), dtype=np.int32), np.diff(np.append(self.first, len(v))))

    def trie(self, train: np.ndarray, least: tuple[int, int], discount: float) -> bytes | None:
        """The trie of the n-grams in the marked texts."""
        n = np.add.reduceat(train[self.owner[self.order]], self.first, dtype=np.int32)
        at = n > 0
        return _trie(_kept(self.v[at], self.u[at], self.w[at], n[at], least), self.codes, discount) if at.any() else None

    def mixture(self, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
        """``Trie.mixture`` of the distinct n-grams, a bounded number at a time."""
        parts = [trie.mixture(self.u[i:i + CHUNK], self.v[i:i + CHUNK], self.w[i:i + CHUNK]) for i in range(0, len(self.v), CHUNK)]
        return tuple(np.concatenate(c) for c in zip(*parts))


def _signed_where_needed(rows: DataFrame, few: int = 10_000) -> DataFrame:
    """``sig`` only where an id has several texts; elsewhere 0, which costs nothing to move."""
    several = rows.groupBy("id").agg(F.count_distinct("sig").alias("texts")).where("texts > 1").select("id", F.lit(True).alias("several"))
    n = several.limit(few + 1).count()
    if not n:
        return rows.withColumn("sig", F.lit(0))
    return rows.join(F.broadcast(several) if n <= few else several, "id", "left").withColumn("sig", F.when(F.col("several"), F.col("sig")).otherwise(F.lit(0)))


def _scored(df: DataFrame, model: NgramModel, doc_id: str, text: str, cell_tokens: int, train=None, least=LEAST, discount: float = DISCOUNT) -> DataFrame:
    """All rows scored; with ``train``, cells of a bearable size make their trie from the marked rows among their blocks."""
    spark, codes, cells = df.sparkSession, model.codes, len(model.loads)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.lit(False) if train is None else train).cast("int").alias("train"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.hash("doc_id", "text").alias("sig"), F.coalesce("text", F.lit("")).alias("text"), "train")
    rows = _signed_where_needed(rows)
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    here = _splits(model.loads, cell_tokens) == 1 if train is not None else np.zeros(cells, bool)
    copies = np.where(here, 1, np.maximum(1, -(-model.loads * max(size, 1) // (max(model.size, 1) * 2 * cell_tokens))))
    total, buckets = float(model.tokens + model.words + 1), -(-n_rows // BUCKET_TEXTS) or 1

    def answer(key: tuple, blocks: pa.Table, tries: pa.Table) -> pa.Table:
        cell, packed = key[0].as_py(), blocks.column("docs").to_pylist()
        if cell < 0 or not packed:
            return _part_table([], [], packed)
        docs = [_unpack(d, np.int64, np.int32, np.uint8) for d in packed]
        ids, sigs, marked = (np.concatenate([d[k] for d in docs]) for k in (0, 1, 2))
        found = Occurrences(blocks.column("payload").to_pylist(), docs)
        trie = tries.column("payload")[0].as_py() if tries.num_rows else found.trie(marked, least, discount) if here[cell] else None
        a, b = found.mixture(Trie(trie, found.codes)) if trie else (np.zeros(len(found.v)), np.ones(len(found.v)))
        counts, word = codes.value[3], found.codes[found.w]
        short, log = word < U(len(counts)), np.zeros(len(word))
        log[short] = np.log10(a[short] + b[short] * (counts[word[short].astype(np.int64)] + 1) / total)
        sums = np.bincount(found.owner, log[found.ngram], len(ids))
        far = np.flatnonzero(~short[found.ngram])
        owner, ngram = found.owner[far], found.ngram[far]
        return _part_table(_bucketed(ids, sigs, sums, buckets), [ids[owner], sigs[owner], word[ngram].view(np.int64), a[ngram], b[ngram]])

    def add_up(key: tuple, blocks: pa.Table) -> pa.Table:
        ids, sigs, sums = _joined(blocks.column("payload").to_pylist(), np.int64, np.int32, np.int64)
        order = np.lexsort((sigs, ids))
        ids, sigs, sums = ids[order], sigs[order], sums[order]
        at = _firsts(ids, sigs)
        return pa.table({"id": ids[at], "sig": sigs[at], "score": np.add.reduceat(sums, at) / FIXED})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in flat.pylist(batch, "texts"):
                ids, null, *rest = _unpack(packed, *TEXTS)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null == 1), *map(pa.array, (ids, *rest))], names=["doc_id", "id", "sig", "n_tokens", "n_short", "base_short"])

    places = pa.table({"cell": pa.array(np.repeat(np.arange(cells), copies), pa.int32()),
                       "copy": pa.array(np.concatenate([np.arange(c) for c in copies]), pa.int32())})
    tries = model.tries.join(spark.createDataFrame(places, "cell int, copy int"), "cell")
    with small_batches(spark):
        parts = materialize(_query_blocks(rows, codes, copies, total).groupBy("cell", "copy").cogroup(tries.groupBy("cell", "copy")).applyInArrow(answer, PARTS), "parts")
    counted = parts.where("texts IS NOT NULL").select("texts").mapInArrow(alone, "doc_id long, id long, sig int, n_tokens long, n_short long, base_short double")
    known = model.unigrams.select("h", "c")
    rare = parts.where("h IS NOT NULL").select("id", "sig", "h", "a", "b").join(known, "h", "left").withColumn("p1", (F.coalesce("c", F.lit(0)) + 1) / F.lit(total))
    sums = parts.where("payload IS NOT NULL").select("bucket", "payload").groupBy("bucket").applyInArrow(add_up, "id long, sig int, score double")
    sums = sums.select("id", "sig", "score", F.lit(0).alias("known"), F.lit(0.0).alias("base")).unionByName(
        rare.select("id", "sig", F.log10(F.col("a") + F.col("b") * F.col("p1")).alias("score"), F.col("c").isNotNull().cast("int").alias("known"), F.log10("p1").alias("base")))
    sums = sums.groupBy("id", "sig").agg(F.sum("score").alias("score"), F.sum("known").alias("known"), F.sum("base").alias("base"))
    # equal rows share (id, sig): their parts were added up, and each of them gets its share
    counted = counted.withColumn("times", F.count("*").over(W.partitionBy("id", "sig")))
    return counted.join(sums, ["id", "sig"]).select(
        "doc_id", "n_tokens", (F.col("n_short") + (F.col("known") / F.col("times")).cast("long")).alias("n_known"),
        (F.col("base_short") + F.col("base") / F.col("times")).alias("base_score"), (F.col("score") / F.col("times")).alias("score"))


def score_ngrams(df: DataFrame, model: NgramModel, doc_id: str = "doc_id", text: str = "text", cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score and score (log10 of the text's probability by word counts alone, and by the model)."""
    return _scored(df, model, doc_id, text, cell_tokens)


def train_and_score(df: DataFrame, train, doc_id: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST, discount: float = DISCOUNT,
                    short_codes: int = SHORT_CODES, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """Every row scored by a model of those for which the column ``train`` holds, moving each n-gram once.

    The answer is that of ``fit_ngrams`` and ``score_ngrams``, but the n-grams that a cell counts
    are the ones that it scores. Only cells with too many n-grams for a task are fitted beforehand. Adds ``train_tokens``.
    """
    _check(least)
    texts = df.where(train).select(F.col(text).cast("string").alias("text"))
    model = _counted(texts, short_codes, cell_tokens)
    large = _splits(model.loads, cell_tokens) > 1
    if large.any():
        model = replace(model, tries=_tries(texts, model, least, discount, cell_tokens, large))
    return _scored(df, model, doc_id, text, cell_tokens, train, least, discount).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def _bucketed(ids: np.ndarray, sigs: np.ndarray, sums: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Sums per text as one packed row for each bucket of texts."""
    order = np.lexsort((sigs, ids))
    ids, sigs, sums = ids[order], sigs[order], sums[order]
    at = _firsts(ids, sigs)
    ids, sigs, sums = ids[at], sigs[at], np.rint(np.add.reduceat(sums, at) * FIXED).astype(np.int64)
    bucket = (mix(ids.view(U)) % U(buckets)).astype(np.int64)
    return [(g, _pack(ids[i], sigs[i], sums[i])) for g, i in _blocks(bucket)]


def _part_table(sums: list[tuple[int, bytes]], rare: list[np.ndarray], texts: list[bytes] = ()) -> pa.Table:
    """Packed sums, packed texts and n-grams that wait for the count of a rare word, as rows of ``PARTS``."""
    n, m, k = len(sums), len(rare[0]) if rare else 0, len(texts)
    columns = {"bucket": pa.array([g for g, _ in sums] + [None] * (k + m), pa.int32()), "payload": pa.array([p for _, p in sums] + [None] * (k + m), pa.binary()),
               "texts": pa.array([None] * n + list(texts) + [None] * m, pa.binary())}
    for i, (name, kind) in enumerate((("id", pa.int64()), ("sig", pa.int32()), ("h", pa.int64()), ("a", pa.float64()), ("b", pa.float64()))):
        columns[name] = pa.concat_arrays([pa.nulls(n + k, kind), pa.array(rare[i], kind) if m else pa.nulls(0, kind)])
    return pa.table(columns)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(7)) == 2


@query("op13_elias_fano_scores")
def op13_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a trigram model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return train_and_score(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
