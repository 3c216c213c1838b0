"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text becomes hashed features: its words and the beginnings of its longer words. One
weight vector is shared by all thresholds: P(grade <= k) = sigmoid(theta_k - w.x), with
theta rising. The output is the expected severity, the sum of P(grade >= k).

The labels only say toxic or not, so the fit grades the toxic training rows 1 to 3 by
how often they use features that the labels show to be typical of toxic rows.
The fit reads a bounded sample of labelled rows (``max_toxic`` and ``max_clean``, in hash
order, weighted back to all labels); scoring covers every document. Tasks count the sample's
features by class and keep the telling ones of each row; only these reach the driver.

Defined results: null and empty texts have no feature and severity of the intercept
alone; without both classes among the labels every severity is 0 and nothing is
rejected; repeated rows are scored alike; labels that are null or not 0/1 are
left out; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import flat
from creditspark.llm.registry import query, table
from creditspark.sources.io import materialize

BITS = 18
PREFIX = 6  # bytes
GRADES = 3
MAX_TOXIC, MAX_CLEAN = 6000, 10000
MAX_FEATURES, MIN_GAIN, PENALTY = 8192, 6.0, 3e-6
TYPICAL = 8.0  # odds of a typical feature
SLICE = 4 << 20
ROWS = 256  # of the sample, reduced at once
CHUNK = 1 << 18  # features met at once in a step of the fit
NOT_WORD = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of each distinct feature of each row, ordered by row."""
    ws, we, first = flat.word_bounds(buf, starts, ends, NOT_WORD)
    row = np.repeat(np.arange(len(starts)), np.diff(first))
    words = flat.mix(flat.range_hashes(buf, ws, we) + flat.U(1))
    long = we - ws > PREFIX
    heads = flat.mix(flat.range_hashes(buf, ws[long], ws[long] + PREFIX) + flat.U(2))
    shift = flat.U(64 - BITS)
    keys = np.concatenate([(row << BITS) | (words >> shift).astype(np.int64), (row[long] << BITS) | (heads >> shift).astype(np.int64)])
    keys, counts = np.unique(keys, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts


def values_of(counts: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + counts)


class OrdinalModel:
    """Shared weights and rising thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceed(self, row: np.ndarray, feature: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        z = np.bincount(row, weights=self.weights[feature] * values_of(counts), minlength=rows)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def typical_features(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Mask of the features that are typical of toxic rows; ``bad`` and ``good`` count the rows of either class with each feature."""
    odds = ((bad + 0.5) / (toxic + 1)) / ((good + 0.5) / (clean + 1))
    return (odds >= TYPICAL) & (bad >= 5)


def severity_grades(strength: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean rows; toxic rows by equal shares of their number of typical features."""
    cuts = np.quantile(strength[toxic], [k / grades for k in range(1, grades)])
    return np.where(toxic, 1 + np.searchsorted(cuts, strength, "left"), 0)


def telling_features(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int, most: int = MAX_FEATURES) -> np.ndarray:
    """Mask of the features whose presence is most informative about the class (likelihood-ratio statistic)."""
    share = (bad + good) / (toxic + clean)

    def part(seen, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / (n * p)), 0.0) + np.where(seen < n, (n - seen) * np.log((n - seen) / (n * (1 - p))), 0.0)

    gain = np.where((bad + good >= 3) & (share < 1), part(bad, toxic, share) + part(good, clean, share), 0.0)
    gain = np.nan_to_num(gain)
    mask = np.zeros(len(bad), bool)
    mask[np.argsort(-gain, kind="stable")[:most]] = True
    return mask & (gain > MIN_GAIN)


def fit_ordinal(used: np.ndarray, sizes: np.ndarray, place: np.ndarray, counts: np.ndarray, grade: np.ndarray, weight: np.ndarray,
                penalty: float = PENALTY, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty, by Adam over the telling features ``used`` of the whole sample.

    ``place`` (in ``used``) and ``counts`` hold the telling features of all rows, row by row; ``sizes`` says how many each row has.
    """
    n, top = len(grade), int(grade.max())
    first = np.append(0, np.cumsum(sizes))
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1], CHUNK)), [0, n]))  # whole rows, about CHUNK features together
    chunks = [(slice(lo, hi), slice(first[lo], first[hi])) for lo, hi in zip(cuts[:-1], cuts[1:])]
    x, weight = values_of(counts), weight / weight.sum()
    share = np.array([weight[grade >= k].sum() for k in range(1, top + 1)]).clip(1e-6, 1 - 1e-6)
    start = -np.log(share / (1 - share))
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    params = np.concatenate([np.zeros(len(used)), free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda t: 1.0 / (1.0 + np.exp(-np.clip(t, -40, 40)))
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, f = params[:len(used)], params[len(used):]
        gaps = np.exp(f[1:])
        theta = np.concatenate([[f[0]], f[0] + np.cumsum(gaps)])
        z = np.concatenate([np.bincount(np.repeat(rows[some] - some.start, sizes[some]), weights=w[place[part]] * x[part], minlength=some.stop - some.start)
                            for some, part in chunks])
        cdf = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((n, 1))], axis=1)  # P(grade <= k - 1)
        high, low = cdf[rows, grade + 1], cdf[rows, grade]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        dz = weight * (slope_high - slope_low) / p  # derivative of -log p by z
        dtheta = np.zeros(top)
        np.add.at(dtheta, np.minimum(grade, top - 1), np.where(grade < top, -weight * slope_high / p, 0.0))
        np.add.at(dtheta, np.maximum(grade - 1, 0), np.where(grade > 0, weight * slope_low / p, 0.0))
        tail = np.cumsum(dtheta[::-1])[::-1]
        slope = np.zeros(len(used))
        for some, part in chunks:
            np.add.at(slope, place[part], np.repeat(dz[some], sizes[some]) * x[part])
        grad = np.concatenate([slope + penalty * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    weights = np.zeros(1 << BITS)
    weights[used] = params[:len(used)]
    f = params[len(used):]
    return OrdinalModel(weights, np.concatenate([[f[0]], f[0] + np.cumsum(np.exp(f[1:]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(doc_id, toxic, features, counts) of at most ``max_toxic`` + ``max_clean`` labelled documents, in hash order of their ids."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")  # at most 16,000 ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text", SLICE):
            row, feature, counts = features(*flat.text_bytes(flat.column(batch, "text")))
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [flat.column(batch, "doc_id").cast(pa.int64()), flat.column(batch, "toxic").cast(pa.int32()),
                 *(pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (feature, counts))], names=["doc_id", "toxic", "features", "counts"])

    return texts.mapInArrow(run, "doc_id long, toxic int, features array<int>, counts array<int>")


def class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of toxic and of clean rows with each feature."""
    got = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).toArrow()  # at most 2**BITS rows
    bad, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    feature = got["feature"].to_numpy()
    bad[feature], good[feature] = got["bad"].to_numpy(), got["good"].to_numpy()
    return bad, good


def telling_rows(sample: DataFrame, told: np.ndarray, typical: np.ndarray) -> DataFrame:
    """(doc_id, toxic, strength, places, counts): typical features met in each row, and its telling ones by their place among all of these."""
    places = np.where(told, np.cumsum(told) - 1, -1).astype(np.int16)  # at most MAX_FEATURES
    shared = sample.sparkSession.sparkContext.broadcast((places, typical))  # 0.8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, typical = shared.value
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            lists, n = flat.column(batch, "features"), batch.num_rows
            feature, counts = lists.flatten().to_numpy(), flat.column(batch, "counts").flatten().to_numpy()
            row = np.repeat(np.arange(n), flat.longs(pc.list_value_length(lists)))
            strength = np.bincount(row, weights=counts * typical[feature], minlength=n).astype(np.int64)
            kept = places[feature] >= 0
            at = pa.array(np.append(0, np.cumsum(np.bincount(row[kept], minlength=n))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [flat.column(batch, "doc_id"), flat.column(batch, "toxic"), pa.array(strength), pa.ListArray.from_arrays(at, pa.array(places[feature[kept]])),
                 pa.ListArray.from_arrays(at, pa.array(counts[kept]))], names=["doc_id", "toxic", "strength", "places", "counts"])

    return sample.mapInArrow(run, "doc_id long, toxic int, strength long, places array<smallint>, counts array<int>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> OrdinalModel | None:
    """Model from the bounded sample; None without both classes."""
    sample = materialize(labelled_sample(docs, labels, max_toxic, max_clean), "labelled")
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # 2 rows
    if len(classes) < 2:
        return None
    bad, good = class_counts(sample)
    told = telling_features(bad, good, classes[1], classes[0])
    got = telling_rows(sample, told, typical_features(bad, good, classes[1], classes[0])).toArrow()  # bounded by the two parameters
    got = got.take(np.argsort(got["doc_id"].to_numpy(), kind="stable"))
    toxic = got["toxic"].to_numpy() == 1
    lists = got["places"].combine_chunks()
    totals = {r["toxic"]: r["n"] for r in labels.where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    weight = np.where(toxic, totals[1] / classes[1], totals[0] / classes[0])
    return fit_ordinal(np.flatnonzero(told), flat.longs(pc.list_value_length(lists)), lists.flatten().to_numpy(), got["counts"].combine_chunks().flatten().to_numpy(),
                       severity_grades(got["strength"].to_numpy(), toxic), weight)


def score_toxicity(df: DataFrame, model: OrdinalModel | None, text: str = "text") -> DataFrame:
    """Add ``expected_severity``, ``toxic_probability`` (grade of 1 or more) and ``severity_grade`` (the most probable) to each row."""
    schema = T.StructType(df.schema.fields + T._parse_datatype_string("expected_severity double, toxic_probability double, severity_grade int").fields)
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else (model.weights.astype(np.float32), model.thresholds))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value and OrdinalModel(*shared.value)
        for batch in flat.slices(batches, text, SLICE):
            if held:
                exceed = held.exceed(*features(*flat.text_bytes(flat.column(batch, text))), batch.num_rows)
            else:
                exceed = np.zeros((batch.num_rows, GRADES))
            chance = np.concatenate([np.ones((batch.num_rows, 1)), exceed], axis=1) - np.concatenate([exceed, np.zeros((batch.num_rows, 1))], axis=1)
            added = [pa.array(exceed.sum(1)), pa.array(exceed[:, 0].copy()), pa.array(chance.argmax(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(batch.columns + added, names=schema.names)

    return df.mapInArrow(run, schema)


REJECT = 0.5


@query("op1_ordinal_toxicity")
def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", "expected_severity", "toxic_probability", "severity_grade",
                                              (F.col("toxic_probability") >= REJECT).alias("toxic"))
