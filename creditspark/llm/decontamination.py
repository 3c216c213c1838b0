"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``window`` consecutive benchmark words is a pattern. A table of shifts,
keyed by blocks of two words, lets the search jump over positions where no pattern
can end; where the shift is 0 the block selects a bucket of patterns with that
suffix, and a direct comparison confirms the occurrence. Patterns of one length
share a matcher; items shorter than a window are one pattern of their own length.

The patterns are broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text; a
larger benchmark takes several passes over the documents, so its size is no limit.

Defined results: null and empty texts have no words and are never contaminated; items
without words have no window; repeated rows are judged alike; an empty benchmark
or table works; other columns pass through (the added names must be free).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import flat
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Upper-case letters fold; every byte that belongs to no word becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ADDED = "n_words long, hit_ranges array<struct<start:long,end:long>>, hit_items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Finds all occurrences of word sequences of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.length = len(patterns[0])
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for number, p in enumerate(patterns):
            for end in range(self.block, self.length + 1):
                key = p[end - 2:end] if self.block == 2 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
            self.bucket[key].append((number, list(p)))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of each occurrence, by end position."""
        shift, default, length, n = self.shift.get, self.default, self.length, len(words)
        end = length - 1
        if self.block == 2:
            while end < n:
                key = (words[end - 1], words[end])
                jump = shift(key, default)
                if jump:
                    end += jump
                    continue
                start = end - length + 1
                here = words[start:end + 1]
                for number, p in self.bucket[key]:
                    if p == here:
                        yield start, number
                end += 1
        else:
            for end, word in enumerate(words):
                for number, _ in self.bucket.get(word, ()):
                    yield end, number


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))]


class Patterns:
    """All windows of a block of items, grouped by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), window):
                owners[w].add(item)
        by_length = defaultdict(list)
        for w in sorted(owners):
            by_length[len(w)].append(w)
        self.matchers = [(WuManber(ps), [owners[p] for p in ps]) for ps in by_length.values()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges covered by occurrences, and the items they belong to."""
        spans, items = [], set()
        for matcher, owners in self.matchers:
            for start, number in matcher.search(words):
                spans.append((start, start + matcher.length))
                items |= owners[number]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict = {}


def _patterns(shared, window: int) -> Patterns:
    """The matchers of a broadcast block, built once per Python worker."""
    key = (shared.value[0], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(shared.value[1], window)
    return _BUILT[key]


def mark_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (merged word ranges) and ``hit_items`` (distinct, sorted) to each row."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = df
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(r["item"], r["text"]) for r in part.collect()]  # at most about BLOCK_BYTES of text
        if b:
            out = materialize(out, "decontaminated")  # one block of patterns in memory at a time
        out = _pass(out, df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows)), text, window, first=b == 0)
    return out


def _pass(df: DataFrame, shared, text: str, window: int, first: bool) -> DataFrame:
    kept = [f for f in df.schema.fields if first or f.name not in ("n_words", "hit_ranges", "hit_items")]
    schema = T.StructType(kept + T._parse_datatype_string(ADDED).fields)
    range_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(shared, window)
        for batch in batches:
            before = zip(flat.pylist(batch, "hit_ranges"), flat.pylist(batch, "hit_items")) if not first else None
            counts, ranges, items = [], [], []
            for t in flat.pylist(batch, text):
                words = words_of(t)
                spans, found = patterns.hits(words)
                if before:
                    old_spans, old_items = next(before)
                    spans, found = merged(spans + [(r["start"], r["end"]) for r in old_spans]), found | set(old_items)
                counts.append(len(words))
                ranges.append([{"start": s, "end": e} for s, e in spans])
                items.append(sorted(found))
            added = [pa.array(counts, pa.int64()), pa.array(ranges, range_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([flat.column(batch, f.name) for f in kept] + added, names=schema.names)

    return df.mapInArrow(run, schema)


def hit_words() -> F.Column:
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_SPLIT}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0) q),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) ns WHERE len(w) >= n) q),
m AS (SELECT rid, i, n, item FROM dw JOIN p USING (n, k)),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM m) q GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m) q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)"""


@query("op4_wu_manber_decontamination", ORACLE_SQL)
def op4_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    marked = mark_contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"))
