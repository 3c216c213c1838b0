"""Collocations by Toivonen's sampling method, exact at every size.

A sample of the documents proposes frequent phrases at a lowered limit. A full pass then
counts them together with their negative border: every phrase whose first and whose last
words (all but one) were both proposed, so what the sample missed by one step is counted too. If a counted
phrase is frequent but was not proposed, the border failed there. Another pass counts what grows
from such phrases: at once in all lengths, as if everything grown were frequent, while they are a small share of the text, which closes
the border; otherwise one word further, until nothing new is frequent. The result never depends on the
sample, only the number of passes does (usually two, at most the longest phrase's length).

Proposals reach the tasks as a table of bits of bounded size. A wrong bit only lets a
few more phrases be counted. These passes count 64-bit hashes, which can only count too much; the last pass counts
what they found frequent by the phrases themselves.

Defined results: a null text has no words; a null language is ``und``; repeated rows
count as often as they stand there; an empty table gives an empty result; other columns
are not looked at. A column absent from the table raises Spark's own error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.flat import U, mix
from creditspark.llm.language_model import small_batches
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SAMPLE = 0.1  # share of the documents that proposes; any value gives the same result
MOST_BITS = 1 << 27  # of the proposal table: 16 MB
SLICE = 2 << 20
TEXTS = 1 << 16  # phrases written out at once
AHEAD = 0.125  # missed phrases up to this share of all words are grown to all lengths in one pass
SALTS = 8  # lookups of one word's count are spread over so many keys
PIECE_ENDS = b".,;:!?\n\v\f\r"
GAPS = flat.byte_mask(PIECE_ENDS + b" \t")
ENDS = flat.byte_mask(PIECE_ENDS)
COUNTED = "lang string, k int, phrase string, n long"


class Bits:
    """Set of 64-bit hashes with false positives, never false negatives."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = U(len(words) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> U(32)) & self.mask):
            out &= (self.words[at >> U(6)] >> (at & U(63))) & U(1) != 0
        return out

    def few(self, h: np.ndarray) -> np.ndarray:
        """Places of the members, for tables that hold few of the hashes."""
        at = h & self.mask
        some = np.flatnonzero((self.words[at >> U(6)] >> (at & U(63))) & U(1))
        return some[self.has(h[some])]


def bits_of(hashes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """The bit table of a column ``h``: a few bits per entry, at most ``most`` in all."""
    size = 1 << 16
    wanted = 32 * hashes.count()
    while size < min(wanted, most):
        size *= 2
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1))))
    slots = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()  # at most size / 64 rows
    words = np.zeros(size >> 6, U)
    words[flat.longs(slots.column("slot").combine_chunks())] = flat.longs(slots.column("bits").combine_chunks()).view(U)
    return words


_OPEN: dict = {}


def _tables(shared) -> list[Bits]:
    """The broadcast bit tables, wrapped once per Python worker."""
    key, arrays = shared.value
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = [Bits(a) for a in arrays]
    return _OPEN[key]


class Windows:
    """Word windows of a slice of documents: hashes by length, and their texts."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        buf, starts, ends = flat.text_bytes(text)
        self.ws, self.we, first = flat.word_bounds(buf, starts, ends, GAPS)
        self.buf, self.n = buf, len(self.ws)
        self.doc = np.repeat(np.arange(len(starts)), np.diff(first))
        lbuf, lstart, lend = flat.text_bytes(lang)
        self.lang_hash = flat.range_hashes(lbuf, lstart, lend, lower=False) if len(lbuf) else mix((lend - lstart).astype(U))
        self.piece = np.searchsorted(np.flatnonzero(ENDS[buf]), self.ws) + self.doc  # differs whenever a piece or a document ends in between
        self.words = mix(flat.range_hashes(buf, self.ws, self.we) ^ mix(self.lang_hash[self.doc])) if self.n else np.zeros(0, U)
        self.spaced = None

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hash of the window at each word, whether it stays in one piece)."""
        h = self.words
        for k in range(1, longest + 1):
            if k > 1:
                h = mix(h[:-1] * U(0x9E3779B97F4A7C15) + self.words[k - 1:])
            yield k, h, self.piece[:len(h)] == self.piece[k - 1:] if len(h) else np.zeros(0, bool)
            if not len(h):
                return

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """Windows of ``k`` words with one space between words, A-Z lowered."""
        if self.spaced is None:
            size = self.we - self.ws
            start = np.cumsum(size + 1) - (size + 1)
            out = np.full(int((size + 1).sum()), 32, np.uint8)
            src = np.repeat(self.ws - start, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(self.n), size))
            dst = np.arange(int(size.sum())) + np.repeat(np.arange(self.n), size)
            out[dst] = flat_lower(self.buf[src])
            self.spaced = out, start, start + size
        out, start, end = self.spaced
        s, e = start[at], end[at + k - 1]
        size = e - s
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        data = out[np.repeat(s - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def flat_lower(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)


def _grouped(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, one window, count) per distinct hash of the windows ``at``."""
    order = np.argsort(h[at], kind="stable")
    s = h[at][order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[new], at[order[new]], np.diff(np.append(new, len(s)))


def _sampled(docs: DataFrame, lengths: Sequence[int], shared=None) -> DataFrame:
    """(h, n) of all windows of these lengths; with a bit table only those whose word pairs are all in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tables(shared)[0] if shared is not None else None
        for batch in flat.slices(batches, "text", SLICE):
            w, good = Windows(flat.column(batch, "lang"), flat.column(batch, "text")), None
            for k, h, whole in w.hashes(max(lengths)):
                if known is not None and k == 2:
                    good = whole & known.has(h)
                elif known is not None and k > 2:
                    good = good[:-1] & good[1:]
                if k in lengths and len(h):
                    key, _, n = _grouped(h, np.flatnonzero(whole if good is None else good))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, shared, longest: int) -> DataFrame:
    """(h, k, n) of all words and of the windows that grow from the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known,) = _tables(shared)
        for batch in flat.slices(batches, "text", SLICE):
            before = None
            for k, h, whole in Windows(flat.column(batch, "lang"), flat.column(batch, "text")).hashes(longest):
                good = whole if k == 1 else whole & _grown(known, before)
                before = h
                yield _hashed(h, k, np.flatnonzero(good))

    return _summed(docs, run)


def _missed(docs: DataFrame, shared, longest: int, ahead: bool) -> DataFrame:
    """(h, k, n) of the windows that grow from the frequent phrases and were not counted before; ``ahead`` grows them further as if all were frequent.

    The tables are the proposals and, for this pass and those before, the phrases known then and the new ones among them.
    A pass looks only at windows that begin or end with a new phrase, or with a window grown from one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *later = _tables(shared)
        *old, (known, fresh) = zip(later[::2], later[1::2])
        for batch in flat.slices(batches, "text", SLICE):
            before, grown = None, np.zeros(0, np.int64)
            for k, h, whole in Windows(flat.column(batch, "lang"), flat.column(batch, "text")).hashes(longest):
                if k > 1:
                    seeds = np.union1d(fresh.few(before), grown)
                    at = np.union1d(seeds - 1, seeds)
                    at = at[(at >= 0) & (at < len(h))]
                    at = at[whole[at]]
                    at = at[np.logical_and(*[known.has(before[e]) | np.isin(e, grown) for e in (at, at + 1)])]
                    at = at[~_both(first, before, at)]
                    for o, new in old:
                        at = at[~(_both(o, before, at) & (new.has(before[at]) | new.has(before[at + 1])))]
                    grown = at if ahead else grown
                    yield _hashed(h, k, at)
                before = h

    return _summed(docs, run)


def _hashed(h: np.ndarray, k: int, at: np.ndarray) -> pa.RecordBatch:
    key, _, n = _grouped(h, at)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, np.int32)), pa.array(n, pa.int64())], names=["h", "k", "n"])


def _summed(docs: DataFrame, run) -> DataFrame:
    return docs.mapInArrow(run, "h long, k int, n long").groupBy("h").agg(F.max("k").alias("k"), F.sum("n").alias("n"))


def _named(docs: DataFrame, shared, longest: int) -> DataFrame:
    """(lang, k, phrase, n): exact counts, by the phrase itself, of all windows whose hash is in the bit table; k = 0 holds the number of words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known,) = _tables(shared)
        for batch in flat.slices(batches, "text", SLICE):
            lang = flat.column(batch, "lang").cast(pa.string())
            w = Windows(lang, flat.column(batch, "text"))
            yield _rows(lang, 0, pa.array([""] * len(lang)), np.bincount(w.doc, minlength=len(lang)))
            for k, h, whole in w.hashes(longest):
                _, at, n = _grouped(h, np.flatnonzero(whole & known.has(h)))
                for i in range(0, len(at), TEXTS):
                    some = slice(i, i + TEXTS)
                    yield _rows(lang.take(pa.array(w.doc[at[some]])), k, w.texts(at[some], k), n[some])

    return docs.mapInArrow(run, COUNTED).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _both(known: Bits, shorter: np.ndarray, at: np.ndarray) -> np.ndarray:
    return known.has(shorter[at]) & known.has(shorter[at + 1])


def _grown(known: Bits, shorter: np.ndarray) -> np.ndarray:
    both = known.has(shorter)
    return both[:-1] & both[1:]


def _rows(lang: pa.Array, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), k, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])


def _outside(rows: DataFrame, shared) -> DataFrame:
    """Rows whose hash is not in the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known,) = _tables(shared)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~known.has(flat.longs(flat.column(batch, "h")).view(U))))

    return rows.mapInArrow(run, rows.schema)


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST,
                     sample: float = SAMPLE) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of up to ``longest`` words found ``min_count`` times or more; k = 0 holds each language's words.

    The result is a written table.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    part = docs.where(F.rand(11) < sample)
    expected = min_count * sample
    low = max(2, math.floor(expected - 1.5 * math.sqrt(expected)))
    with small_batches(spark):
        proposed = materialize(_sampled(part, (1, 2)).where(F.col("n") >= low), "proposed")
        if longest > 3:
            pairs = _share(spark, [bits_of(proposed)])
            proposed = proposed.unionByName(materialize(_sampled(part, range(3, longest), pairs).where(F.col("n") >= low), "proposed"))
    tables = [bits_of(proposed)]
    shared = _share(spark, tables)
    with small_batches(spark):
        found = materialize(_counted(docs, shared, longest).where(F.col("n") >= min_count), "frequent")
    words = found.where("k = 1").agg(F.sum("n")).first()[0] or 0
    fresh = _outside(found.where(F.col("k") < longest), shared)
    while (size := fresh.agg(F.sum("n")).first()[0]) is not None:
        tables += [bits_of(found.where(F.col("k") < longest)), bits_of(fresh)]
        ahead = size <= AHEAD * words
        with small_batches(spark):
            new = materialize(_missed(docs, _share(spark, tables), longest, ahead).where(F.col("n") >= min_count), "frequent")
        found, fresh = found.unionByName(new), new.where(F.col("k") < longest)
        if ahead:
            break
    with small_batches(spark):
        return materialize(_named(docs, _share(spark, [bits_of(found)]), longest).where((F.col("n") >= min_count) | (F.col("k") == 0)), "phrases")


def _share(spark: SparkSession, arrays: list[np.ndarray]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, arrays))


def _inner(words: str, start: str, count: str):
    return F.array_join(F.expr(f"slice({words}, {start}, {count})"), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 sample: float = SAMPLE, absorb_percent: int = 100) -> DataFrame:
    """The ``top`` phrases of two or more words per language by their weakest cut.

    A cut into ``l`` and ``r`` occurrences scores floor(1000 * a * n / (l * r)). A phrase inside a longer one
    that has at least ``absorb_percent`` of its occurrences is left out; it is enough to look at phrases one word longer,
    as counts never grow with length.
    """
    counts = frequent_phrases(df, text, lang, min_count, longest, sample)
    totals = counts.where("k = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    longer = phrases.where("k >= 3").select(
        "lang", F.explode(F.array(_inner("w", "1", "k - 1"), _inner("w", "2", "k - 1"))).alias("phrase"), F.col("a").alias("outer")
    ).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < absorb_percent * F.col("a")))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    known = counts.where("k >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w", "k", salt.alias("salt"))
    cuts = cuts.withColumns({"head": _inner("w", "1", "cut"), "tail": _inner("w", "cut + 1", "k - cut")}).drop("w", "k")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.withColumnsRenamed({"part": side, "part_n": name}), ["lang", side, "salt"])
    big = "decimal(38,0)"
    score = F.expr(f"CAST((CAST(a * 1000 AS {big}) * CAST(total AS decimal(19,0))) AS {big}) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    scored = cuts.join(F.broadcast(totals) if _few(totals) else totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("total").alias("n"), F.col("b.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _few(rows: DataFrame, most: int = 100_000) -> bool:
    return rows.limit(most + 1).count() <= most


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) ks WHERE len(w) >= k) q),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT * FROM f x WHERE k >= 2 AND NOT EXISTS (
  SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND y.a >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
s AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c),
t AS (SELECT s.lang, s.phrase, s.a, s.cut, l.a AS l, r.a AS r, tot.n, (1000 * s.a * tot.n) // (l.a * r.a) AS score
  FROM s JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.cut], ' ')
  JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.cut + 1:], ' ') JOIN tot ON tot.lang = s.lang),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= {TOP}"""


@query("op11_toivonen_collocations", ORACLE_SQL)
def op11_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents per language."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))
