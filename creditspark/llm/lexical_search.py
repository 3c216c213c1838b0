"""Ranked lexical search where documents with the same bag of item words are scored once.

Documents are restricted to the words of the items. Those with the same term frequencies and
the same length factor ``m`` form a class: they are grouped by the hash of the vector and compared as whole
vectors by the grouping itself. Each class is scored once against all items through the items' posting lists; the best classes
are then expanded into their members by ascending id. Only the ``top`` smallest ids of a class can ever be asked for,
so a class of any size costs each task at most that many rows.

Items are broadcast in blocks of at most about ``BLOCK_TERMS`` item words; more items take more passes.

Defined results: null texts and texts without terms score nothing and do not count as documents; rows that repeat an id are documents
of their own; texts of one item id, also the null id, are one item; items without known
words have no rows; null document ids come first among equal scores; an empty table gives an empty result; other columns are
not looked at. Document ids are cast to long. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditspark.llm import flat
from creditspark.llm.flat import U
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

TOP = 50
BLOCK_TERMS = 1 << 20
SLICE = 4 << 20
CELLS = 1 << 21  # scores, and additions, held at once
SEPARATORS = flat.byte_mask(bytes(b for b in range(128) if not chr(b).isalnum()))
NULL_ID = np.iinfo(np.int64).min
ENTRY = np.dtype([("term", np.uint32), ("tf", np.uint32)])


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, h): the hashes of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            row, h = _terms(flat.column(batch, "text"))
            yield pa.RecordBatch.from_arrays([flat.column(batch, "item").take(pa.array(row)), pa.array(h.view(np.int64))], names=["item", "h"])

    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("item", F.lit(0).cast("long").alias("h")).schema).distinct()


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term occurrence."""
    buf, starts, ends = flat.text_bytes(text)
    ws, we, first = flat.word_bounds(buf, starts, ends, SEPARATORS)
    return np.repeat(np.arange(len(starts)), np.diff(first)), flat.range_hashes(buf, ws, we) if len(ws) else np.zeros(0, U)


def restrict(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, vec): number of terms and the packed frequencies of the broadcast vocabulary (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[1]
        for batch in flat.slices(batches, "text", SLICE):
            row, h = _terms(flat.column(batch, "text"))
            n = np.bincount(row, minlength=batch.num_rows)
            at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
            known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
            key, tf = np.unique(row[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
            entries = np.empty(len(key), ENTRY)
            owner, entries["term"] = np.divmod(key, max(len(vocabulary), 1))
            entries["tf"] = tf
            size = np.bincount(owner, minlength=batch.num_rows) * ENTRY.itemsize
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            vec = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(entries)])
            yield pa.RecordBatch.from_arrays([flat.column(batch, "doc_id"), pa.array(n, pa.int64()), vec], names=["doc_id", "n", "vec"])

    return docs.mapInArrow(run, "doc_id long, n long, vec binary")


def _entries(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed entries of a binary column, and where each row begins."""
    _, offsets, data = vec.buffers()
    at = np.frombuffer(offsets, np.int32)[vec.offset:vec.offset + len(vec) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(ENTRY), (at - at[0]) // ENTRY.itemsize


def document_frequencies(vectors: DataFrame, terms: int) -> DataFrame:
    """(term, df) of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(_entries(flat.column(batch, "vec"))[0]["term"], minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    return vectors.select("vec").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def class_members(vectors: DataFrame, m, top: int) -> DataFrame:
    """The ``top`` smallest ids of each class with their place; the first one carries the vector."""
    rows = vectors.where(F.octet_length("vec") > 0).select("doc_id", m.alias("m"), F.xxhash64("vec").alias("h"), "vec")
    same = W.partitionBy("h", "m", "vec").orderBy("doc_id")
    ranked = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= top)
    return ranked.select("h", "m", F.first("doc_id").over(same).alias("head"), "doc_id", "place", F.when(F.col("place") == 1, F.col("vec")).alias("vec"))


class Best:
    """The best ``top`` classes per item met so far, by score and smallest id."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(5)]  # item, score, head, h, m
        self.more: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, head: np.ndarray, h: np.ndarray, m: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.more.append([item, scores[row, item], head[row], h[row], m[row]])
        self.waiting += len(row)
        if self.waiting > CELLS // 4:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        all_ = [np.concatenate(c) for c in zip(self.kept, *self.more)]
        order = np.lexsort((all_[2], -all_[1], all_[0]))
        item = all_[0][order]
        starts = np.searchsorted(item, item)
        rank = np.arange(len(item)) - starts
        self.kept = [c[order[rank < self.top]] for c in all_]
        full = rank == self.top - 1
        self.floor[item[full]] = all_[1][order[full]]
        self.more, self.waiting = [], 0
        return self.kept


def score_classes(members: DataFrame, shared, top: int) -> DataFrame:
    """(item number, score, head, h, m): the best classes of each task; every class meets every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, at, postings, weight, items = shared.value
        best, fan = Best(items, top), np.diff(at)
        for batch in batches:
            entries, first = _entries(flat.column(batch, "vec"))
            head = flat.longs(flat.column(batch, "head").fill_null(NULL_ID))
            h, m = (flat.longs(flat.column(batch, c)) for c in ("h", "m"))
            work = np.concatenate([[0], np.cumsum(fan[entries["term"]])])[first]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, min(i + max(1, CELLS // max(items, 1)), int(np.searchsorted(work, work[i] + CELLS, "right")) - 1))
                e = entries[first[i]:first[j]]
                row = np.repeat(np.arange(j - i), np.diff(first[i:j + 1]))
                tf, term = e["tf"].astype(np.int64), e["term"]
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[i:j][row]))
                k = fan[term]
                item = postings[np.repeat(at[term] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
                scores = _sums(np.repeat(row, k) * items + item, np.repeat(value, k), (j - i) * items).reshape(j - i, items)
                best.add(scores, head[i:j], h[i:j], m[i:j])
                i = j
        kept = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in kept], names=["item_no", "score", "head", "h", "m"])

    return members.where("place = 1").select("vec", "head", "h", "m").mapInArrow(run, "item_no long, score long, head long, h long, m long")


def _sums(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums by key: two halves of 31 bits each stay exact in doubles."""
    low = np.bincount(key, value & 0x7FFFFFFF, size).astype(np.int64)
    high = np.bincount(key, value >> 31, size).astype(np.int64)
    return low + (high << 31)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    terms = materialize(item_terms(items, item_id, item_text), "item_terms")
    blocks = -(-terms.count() // block_terms) or 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found = _block(rows, part, top)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("item", item_id)


def _block(rows: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    spark = rows.sparkSession
    got = terms.toArrow()  # at most about one block of item words
    names = got.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    h = flat.longs(got.column("h").combine_chunks()).view(U)
    vocabulary, term = np.unique(h, return_inverse=True)
    order = np.argsort(term, kind="stable")
    postings = flat.longs(names.indices)[order]
    at = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

    vectors = materialize(restrict(rows, spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary))), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weight = np.zeros(len(vocabulary), np.int64)
    idf = F.floor(1000 * F.log((2 * F.lit(total["docs"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    for r in document_frequencies(vectors, len(vocabulary)).select("term", idf.alias("w")).toLocalIterator():  # one row per word of the block
        weight[r["term"]] = r["w"]
    m = F.lit(50) + F.expr(f"(50 * n * {total['docs']}L) div {max(total['terms'], 1)}L")
    members = materialize(class_members(vectors, m, top), "members")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, at, postings, weight, len(names.dictionary)))
    by_item = W.partitionBy("item_no").orderBy(F.desc("score"), "head")
    classes = score_classes(members, shared, top).withColumn("nth", F.row_number().over(by_item)).where(F.col("nth") <= top).drop("nth")
    classes = classes.withColumn("head", F.when(F.col("head") != NULL_ID, F.col("head")))
    on = [classes[c].eqNullSafe(members[c]) for c in ("h", "m", "head")]
    docs = classes.join(members, on).select("item_no", "score", "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(W.partitionBy("item_no").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    schema = terms.select(F.lit(0).cast("long").alias("item_no"), "item").schema
    named = spark.createDataFrame(pa.table({"item_no": pa.array(np.arange(len(names.dictionary))), "item": names.dictionary}), schema)
    return ranked.join(named, "item_no").select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
tot AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
idf AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS wt FROM (SELECT term, count(*) AS df FROM f GROUP BY term) y, tot),
dm AS (SELECT rid, doc_id, 50 + ((50 * len(w) * nd) // greatest(nt, 1)) AS m FROM d, tot),
s AS (SELECT item_id, rid, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN idf USING (term) JOIN dm USING (rid) GROUP BY item_id, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
FROM s JOIN dm USING (rid) WHERE score > 0 QUALIFY rank <= {TOP}"""


@query("op12_bag_class_search", ORACLE_SQL)
def op12_bag_class_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
