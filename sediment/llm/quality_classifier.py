"""Quality classifier by importance resampling: two hashed n-gram models and Gumbel top-k.

The target model is counted on labelled good documents, the raw model on every document. A bucket's log ratio
compares the target's count with the count that the raw model expects. The sum over a document's hashed byte n-grams is
its log importance weight, and ``resample`` keeps the k documents of the largest weights plus Gumbel noise: plain
importance resampling for a k that is given.

``classify`` decides which documents are good, for which the sum won't do: it grows with a text's length, so that top-k
by it ranks long texts first. There the weight is the mean log ratio, calibrated to log odds on the labelled
documents, and k is the number of documents whose log odds are at least ``LEAST_ODDS``. So k follows the data, and noise
only decides among documents of about equal weight. Labelled documents are at most ``LABELLED_ROWS``, chosen by hash, one
for each labelled id; all else covers every document.

Counts of hashed n-grams are vectors of fixed size, summed per task and then across tasks. The k-th key is
found by counting keys in ever finer bins, without sorting; documents that tie with it are all kept. Noise is drawn
from a hash of id and text, so repeated rows are scored alike and stay or go together. Null and
empty texts have no n-grams and a mean of 0; without good and bad labels all
documents are kept; an empty table gives an empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch, stage, tuned, unused

#: Bytes of an n-gram, and log2 of the number of hash buckets.
N, BITS = 4, 16
#: Bound of the labelled rows that the target model and the calibration use.
LABELLED_ROWS = 20_000
#: Least log odds of documents that count as good: losing a good document costs e times keeping a bad one.
LEAST_ODDS = -1.0
#: Log ratios are summed as whole multiples of 1 / SCALE.
SCALE = 1 << 24
#: n-grams of no evidence that every text's mean counts beside its own.
FEW = 100
#: Counts by which a bucket's ratio is drawn towards 1; buckets of fewer expected counts say little.
PRIOR = 10.0
#: Bytes of text that are hashed at once.
SLICE = 2 << 20
BINS = 2048


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text begins, with the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte but the last N - 1."""
    if len(data) < N:
        return np.zeros(0, np.uint32)
    code = np.zeros(len(data) - N + 1, np.uint32)
    for k in range(N):
        code = (code << np.uint32(8)) | data[k : len(code) + k]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _parts(texts: pa.Array):
    """(hashes, first hash of each text, end of each text's hashes) of slices of the texts."""
    data, at = _flat(texts)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE)))
        last = min(last, len(at) - 1)
        begin = at[first : last + 1] - at[first]
        yield _hashes(data[at[first] : at[last]]), begin[:-1], np.maximum(begin[1:] - N + 1, begin[:-1])
        first = last


def _counts(texts: DataFrame) -> np.ndarray:
    """Counts of the buckets over all texts of the one column."""

    @lean
    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for h, begin, end in _parts(b.column(0)):
                within = np.zeros(len(h) + 1, np.int32)
                np.add.at(within, np.minimum(begin, len(h)), 1)
                np.add.at(within, np.minimum(end, len(h)), -1)
                total += np.bincount(h[np.cumsum(within[:-1]) > 0], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BITS)), pa.array(total)], ["bucket", "n"])

    out = np.zeros(1 << BITS)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


class Model(NamedTuple):
    """Log ratio of each bucket; log odds that a document is good = intercept + slope * mean log ratio."""

    ratio: np.ndarray
    intercept: float
    slope: float


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on one measure, by Newton's steps with halving."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    cost = lambda w: np.logaddexp(0, -(2 * y - 1) * (design @ w)).sum() + ridge * w @ w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 2 * ridge * np.eye(2), design.T @ (y - p) - 2 * ridge * w)
        while cost(w + step) > cost(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _sums(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log ratios of each text's n-grams, and their number."""
    sums, sizes, fixed = [np.zeros(0)], [np.zeros(0, np.int64)], np.round(ratio * SCALE).astype(np.int64)
    for h, begin, end in _parts(texts):
        run = np.concatenate([[0], np.cumsum(fixed[h])])  # whole numbers, so that sums don't depend on what lies before
        begin, end = np.minimum(begin, len(h)), np.minimum(end, len(h))
        sums.append((run[end] - run[begin]) / SCALE)
        sizes.append(end - begin)
    return np.concatenate(sums), np.concatenate(sizes)


def _means(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams, drawn towards 0 where they are few."""
    sums, sizes = _sums(texts, ratio)
    return sums / (sizes + FEW)


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """The model; without both good and bad labels every document is as likely good."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)  # bounded, so it may be broadcast
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of rows that share a labelled id
    labelled = stage(own.agg(one).select("text", "quality"), "labelled")
    raw, target = _counts(docs.select("text")), _counts(labelled.filter("quality = 1").select("text"))
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))

    @lean
    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_means(b.column(0), ratio)), b.column(1).cast(pa.int32())], ["x", "quality"])

    got = labelled.mapInArrow(measure, "x double, quality int").toPandas().sort_values(["x", "quality"])
    if got.quality.nunique() < 2:
        return Model(ratio, 1.0, 0.0)
    return Model(ratio, *_logistic(got.x.to_numpy(), (got.quality == 1).to_numpy(float)))


def _uniform() -> Column:
    return (F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def log_weights(docs: DataFrame, model: Model, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The named columns with three more, whose names are given too: the log odds, the log odds with Gumbel noise, and the log
    importance weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS numbers, whatever the input
    names = [unused(columns, x) for x in ("log_weight", "key", "log_importance")]
    noisy = docs.select(*(F.col(f"`{c}`") for c in columns), F.coalesce(F.col("text"), F.lit("")).alias(unused(columns, "whole")), (-F.log(-F.log(_uniform()))).alias(unused(columns, "noise")))
    n = len(columns)

    @lean
    def score(batches):
        m = shared.value
        for b in batches:
            sums, sizes = _sums(b.column(n), m.ratio)
            weight = np.round(m.intercept + m.slope * (sums / (sizes + FEW)), 9)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(weight), pa.array(weight + b.column(n + 1).to_numpy()), pa.array(sums)], [*columns, *names])

    own = docs.select(*(F.col(f"`{c}`") for c in columns)).schema.fields
    return noisy.mapInArrow(score, T.StructType([*own, *(T.StructField(x, T.DoubleType()) for x in names)])), names


def kth_largest(keys: DataFrame, k: int, key: str = "key") -> float:
    """The k-th largest of a column: counts in bins, then in the bins of the bin that holds it."""
    x = F.col(key)
    low, high = keys.agg(F.min(x), F.max(x)).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        if low + width <= low:
            break
        inside = keys.filter(x.between(low, high))
        bins = inside.groupBy(F.least(F.floor((x - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b.bin):
            if above + b.n >= k:
                low, high = b.low, b.high
                break
            above += b.n
    return high


def _least_key(keys: DataFrame, weight: str, key: str) -> float:
    """The key of the last document that is kept."""
    k = keys.filter(F.col(weight) >= LEAST_ODDS).count()
    return kth_largest(keys, k, key) if k else math.inf


def classify(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, log_weight (log odds), key, log_importance and ``kept`` of each row."""
    with scratch(), tuned(docs.sparkSession):
        found, (weight, key, _) = log_weights(docs, train(docs, labels, labelled_rows), ["doc_id"])
        keys = stage(found, "quality-keys", keep=True)
        return keys.withColumn("kept", F.col(key) >= _least_key(keys, weight, key))


def keep_good(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The documents that the classifier keeps, with their columns; scored twice rather than shuffled."""
    with scratch(), tuned(docs.sparkSession):
        model = train(docs, labels, labelled_rows)
        found, (weight, key, _) = log_weights(docs, model, ["doc_id"])
        least = _least_key(stage(found, "quality-keys"), weight, key)
    scored, (_, key, _) = log_weights(docs, model, docs.columns)
    return scored.filter(F.col(key) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def resample(docs: DataFrame, labels: DataFrame, k: int, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, log_importance, key of the k documents, and those that tie with the last, of plain importance resampling."""
    with scratch(), tuned(docs.sparkSession):
        found, (weight, key, importance) = log_weights(docs, train(docs, labels, labelled_rows), ["doc_id"])
        noisy = found.select("doc_id", importance, (F.col(importance) + F.col(key) - F.col(weight)).alias("key"))
        keys = stage(noisy, "resampled", keep=True)
        return keys.filter(F.col("key") >= (kth_largest(keys, k) if k else math.inf))
