"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one of raw text (every
document), one of target text (documents labelled good, by half of a bounded
sample of the labels). The target model is the raw one where the sample is silent:
a bucket's probability is that of raw text, times (count + SMOOTHING) / (expected
count + SMOOTHING). A document's log weight is the sum over its n-grams of
log p_target - log p_raw. Sums grow with length, and with them certainty, so a
document counts for LENGTH words at most: of a longer one the sum is that of
LENGTH of its average words. Documents are drawn without replacement by Gumbel
top-k: the k largest of ``log weight / temperature + Gumbel noise``, the noise
being a hash of the document, so that reruns agree. So a document near the cut
is drawn with a chance; far from it the weight decides.

n-grams are words, word pairs, word shapes (character classes present, first
and last class, length, whether the word repeats its predecessor) and pairs of
shapes, each in 2**BITS buckets. k is the number of documents whose log weight exceeds the cut that best
separates the other half of the sample; the k-th key is found by narrowing a histogram
of fixed size, and ties at it stay.

Null or empty text has log weight 0. Without labels of both kinds every document is
kept. Labels of unknown documents, null labels and repeated labels (the least
counts) do no harm. Null and repeated doc_ids keep their rows; a repeated id
shares its label. Extra columns are ignored, or kept by resample(). An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches, written
from .tables import SEGMENTS, segments_of, summed

#: Buckets of each of the four orders of n-grams, as a power of two.
BITS = 16
BUCKETS = 4 << BITS
SMOOTHING, LENGTH = 4.0, 32
#: Bound of the labelled sample, drawn by hash of doc_id.
MOST_LABELS = 20_000
TEMPERATURE = 1.0
BINS = 4096

_CLASS = np.full(256, 4, np.uint8)  # other ASCII
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASS[ord("!")] = 5
_CLASS[128:] = 6
_BITS = (1 << _CLASS).astype(np.uint8)
_BITS[K.SPACE] = 0


def features(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a chunk."""
    n = len(w.hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(w.hi - w.lo), w.counts())
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    same = np.zeros(n, np.int64)
    same[second] = w.hashes[second] == w.hashes[second - 1]
    classes = np.bitwise_or.reduceat(_BITS[w.data], w.starts).astype(np.int64)
    length = np.minimum(np.log2(w.ends - w.starts + 1), 7).astype(np.int64)
    shape = (classes << 12 | _CLASS[w.data[w.starts]].astype(np.int64) << 9 | _CLASS[w.data[w.ends - 1]].astype(np.int64) << 6 | length << 1 | same).astype(K.U64)
    with np.errstate(over="ignore"):
        pair = w.hashes[second] * K.U64(3) + w.hashes[second - 1]
        shapes = shape[second] << K.U64(32) | shape[second - 1]
    parts = [(K.mix(x, 21 + i) >> K.U64(64 - BITS)).astype(np.int64) + (i << BITS) for i, x in enumerate((w.hashes, pair, shape, shapes))]
    return np.concatenate([doc, doc[second], doc, doc[second]]), np.concatenate(parts)


def _counts(good) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)  # raw, target
        ids = np.frombuffer(good.value, np.int64)
        for batch in batches:
            wanted = np.isin(batch["doc_id"].fill_null(0).to_numpy(), ids) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for w in K.hashed_words(batch["text"]):
                doc, bucket = features(w)
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                if wanted[w.lo : w.hi].any():
                    counts[1] += np.bincount(bucket[wanted[w.lo : w.hi][doc]], minlength=BUCKETS)
        yield from segments_of(counts.reshape(-1))

    return K.tidy(run)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of every bucket, order by order."""
    out = np.zeros(BUCKETS)
    for lo in range(0, BUCKETS, 1 << BITS):
        r, t = (x[lo : lo + (1 << BITS)].astype(np.float64) for x in (raw, target))
        if r.sum() and t.sum():
            out[lo : lo + (1 << BITS)] = np.log((t + SMOOTHING) / (r * (t.sum() / r.sum()) + SMOOTHING))
    return out


def keys(doc_ids: pa.Array, texts: pa.Array, ratio: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, log weight and Gumbel key of every document."""
    n, weight, noise = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), K.U64)
    for w in K.hashed_words(texts):
        doc, bucket = features(w)
        n[w.lo : w.hi] = w.counts()
        weight[w.lo : w.hi] = np.bincount(doc, weights=ratio[bucket], minlength=w.hi - w.lo)
        noise[w.lo : w.hi] = K.span_hashes(w.hashes, w.offsets[:-1], w.offsets[1:], seed=31)
    weight /= np.maximum(n / LENGTH, 1)
    ids = doc_ids.fill_null(-1).cast(pa.int64()).to_numpy()
    u = (K.mix(noise ^ K.mix(ids.view(K.U64), 32), 33) >> K.U64(11)).astype(np.float64)
    gumbel = -np.log(-np.log((u + 0.5) / 2.0**53))
    return n, weight, weight / temperature + gumbel


def _scores(ratio, temperature: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(ratio.value, np.float64)
        for batch in batches:
            n, weight, key = keys(batch["doc_id"], batch["text"], table, temperature)
            yield pa.record_batch([batch["doc_id"], pa.array(n), pa.array(weight), pa.array(key)], names=["doc_id", "n_words", "log_weight", "gumbel_key"])

    return K.tidy(run)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that best separates two samples: greatest sum of the two rates, in the middle of its gap."""
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    above = 1 - np.searchsorted(np.sort(good), cuts, "right") / len(good)
    below = np.searchsorted(np.sort(bad), cuts, "right") / len(bad)
    return float(cuts[np.argmax(above + below)])


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by narrowing a histogram of BINS bins; only its counts reach the driver."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while True:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        at = F.least(F.lit(BINS - 1), F.floor((F.col(column) - lo) / F.lit(width)).cast("int"))
        rows = df.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).toArrow().to_pylist()
        for row in sorted(rows, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        if row["lo"] == row["hi"]:
            return row["lo"]
        if k == 1:
            return row["hi"]
        if k == row["n"]:
            return row["lo"]
        lo, hi = row["lo"], row["hi"]


class Resampler:
    """Fits on a table of documents (doc_id, text) and labels (doc_id, quality)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, most_labels: int = MOST_LABELS):
        if temperature <= 0 or most_labels < 1:
            raise ValueError("temperature and most_labels are positive")
        spark = docs.sparkSession
        small_batches(spark)
        self.temperature = temperature
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).toArrow()
        ids, quality = sample["doc_id"].to_numpy(), sample["quality"].to_numpy()
        half = (K.mix(ids.astype(np.int64).view(K.U64), 35) & K.U64(1)).astype(bool)
        fitted = spark.sparkContext.broadcast(ids[half & (quality > 0)].astype(np.int64).tobytes())
        raw, target = summed(docs.mapInArrow(_counts(fitted), SEGMENTS), 2 * BUCKETS).reshape(2, -1)
        self.ratio = log_ratio(raw, target)
        self.shared = spark.sparkContext.broadcast(self.ratio.tobytes())
        self.scores = written(docs.mapInArrow(_scores(self.shared, temperature), "doc_id long, n_words long, log_weight double, gumbel_key double"), "weights")
        known = F.broadcast(spark.createDataFrame(list(zip(ids[~half].tolist(), quality[~half].tolist(), strict=True)), "doc_id long, quality int"))
        # A row for each label: rows of a repeated id count once, by their mean.
        held_out = self.scores.join(known, "doc_id").groupBy("doc_id").agg(F.avg("log_weight").alias("log_weight"), F.min("quality").alias("quality")).select("log_weight", "quality").toArrow()
        weight, good = held_out["log_weight"].to_numpy(), held_out["quality"].to_numpy() > 0
        self.cut = best_cut(weight[good], weight[~good]) if good.any() and not good.all() else -math.inf
        self.k = self.scores.where(F.col("log_weight") > self.cut).count() if self.cut > -math.inf else self.scores.count()
        self.least = kth_largest(self.scores, "gumbel_key", self.k) if self.k else math.inf
        if self.cut == -math.inf:
            self.least = -math.inf

    def verdicts(self) -> DataFrame:
        """doc_id, n_words, log_weight, gumbel_key, kept of every row."""
        return self.scores.withColumn("kept", F.col("gumbel_key") >= self.least)

    def resample(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are drawn, with all their columns."""
        shared, temperature, least = self.shared, self.temperature, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(shared.value, np.float64)
            for batch in batches:
                yield batch.filter(pa.array(keys(batch["doc_id"], batch["text"], table, temperature)[2] >= least))

        return docs.mapInArrow(K.tidy(run), docs.schema)
