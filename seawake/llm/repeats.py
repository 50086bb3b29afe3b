"""Substring deduplication with fixed-block anchors.

Words are runs of bytes other than space and 0x09-0x0D, taken unchanged. A
window of ``window`` words is repeated if its word sequence also starts
anywhere else, in the same text included. Every word covered by a repeated
window goes; windows are judged on the input.

* Reference blocks are the non-overlapping runs of ``block = (window + 1) // 2``
  words of every text, so any window holds a whole block. They are indexed in a
  bitmap of fixed size; a full bitmap lets more rolling windows through, no
  fewer.
* Every rolling window of block length probes the index. A block sequence that
  occurs twice or more, at least once as a reference block, is a hit at all its
  places.
* Hits are extended: the windows that hold a hit are compared whole (96 bits of
  hash, drawn independently of the anchors'). The union of repeated windows
  are the maximal exact repeats of at least ``window`` words.

Equal texts are one text with a mark: all windows of a marked text are repeated,
and it is shuffled once per task, not once per copy.

Null text is an empty text. A null or repeated doc_id is kept: one row out for
every row in. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches, written
from .tables import bucketed

INDEX_BITS = 28
SEGMENT_BITS = 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _name(text: bytes, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16, salt=seed.to_bytes(8, "big")).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _rows(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, kept = [], [], []
            for text in _bytes(batch["text"]):
                words = text.split()
                names.append(_name(text, seed)[0])
                counts.append(len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([batch["doc_id"], pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "uid", "n_words", "whole"])

    return K.tidy(run)


def _firsts(window: int, seed: int) -> Callable:
    """A text once per task, and once more without the text if the task meets it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, bool] = {}
        for batch in batches:
            names, checks, texts = [], [], []
            for text in _bytes(batch["text"]):
                if text.count(b" ") + sum(text.count(c) for c in (b"\t", b"\n", b"\v", b"\f", b"\r")) < window - 1 or len(text.split()) < window:
                    continue
                name, check = _name(text, seed)
                if name not in met:
                    texts.append(text)
                elif not met[name]:
                    texts.append(None)
                else:
                    continue
                met[name] = name in met
                names.append(name)
                checks.append(check)
            if names:
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(checks, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["uid", "check", "text"])

    return K.tidy(run)


def _places(w: K.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place within it of word numbers."""
    doc = np.searchsorted(w.offsets, at, "right") - 1
    return doc, at - w.offsets[doc]


def _blocks(block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for w in K.hashed_words(batch["text"]):
                at, h = w.windows(block)
                _, place = _places(w, at)
                found.append((h[place % block == 0] >> K.U64(64 - INDEX_BITS)).astype(np.int64))
            bits = np.unique(np.concatenate(found))
            segments, begin = np.unique(bits >> SEGMENT_BITS, return_index=True)
            if len(bits):
                parts = np.split((bits & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32), begin[1:])
                yield pa.record_batch([pa.array(segments, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "bits"])

    return K.tidy(run)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, bits in zip(batch["segment"].to_pylist(), batch["bits"].to_pylist(), strict=True):
            maps.setdefault(segment, np.zeros(1 << SEGMENT_BITS, bool))[np.frombuffer(bits, np.uint32)] = True
    yield pa.record_batch([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())], names=["segment", "bits"])


_SEEN = "h long, h2 int, met boolean, uid long, place int, times int, anchored boolean"


def _seen(h: np.ndarray, h2: np.ndarray, uid: np.ndarray, place: np.ndarray, anchored: np.ndarray) -> pa.RecordBatch:
    """Rows for a count per (h, h2). Windows that the batch itself shows to be repeated are settled (met) and dealt out
    evenly; one row without a place stands for all of them in the count. So a sequence that every text holds is not
    one task's work.
    """
    order = np.lexsort((h2, h))
    a, b = h[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    settled = np.zeros(len(order), bool)
    if len(order):
        group = (size > 1) & np.logical_or.reduceat(anchored[order], begin)
        settled[order] = np.repeat(group, size)
        heads = order[begin[group]]
    else:
        group = heads = np.zeros(0, np.int64)
    n, m = len(h), len(heads)
    key = np.where(settled, K.mix(uid.view(K.U64) * K.U64(31) + place.astype(K.U64), 61), h)
    none = np.zeros(n + m, bool)
    none[n:] = True
    put = lambda x, more: np.concatenate([x, more])
    return pa.record_batch(
        [
            pa.array(K.signed(put(key, h[heads]))),
            pa.array(put(h2, h2[heads]).astype(np.uint32).view(np.int32)),
            pa.array(put(settled, np.zeros(m, bool))),
            pa.array(put(uid, np.zeros(m, np.int64)), mask=none),
            pa.array(put(place, np.zeros(m, np.int64)).astype(np.int32), mask=none),
            pa.array(put(np.ones(n, np.int32), np.full(m, 2, np.int32))),
            pa.array(put(anchored, np.ones(m, bool))),
        ],
        names=["h", "h2", "met", "uid", "place", "times", "anchored"],
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """uid, places of the rows of _seen() whose sequence occurs twice or more, at least once anchored."""
    of = Window.partitionBy("h", "h2", "met")
    met = rows.withColumn("all", F.sum("times").over(of)).withColumn("any", F.max("anchored").over(of))
    return met.where("uid IS NOT NULL AND (met OR (all > 1 AND any))").groupBy("uid").agg(F.collect_list("place").alias("places"))


def _probes(block: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            uids, found = batch["uid"].to_numpy(), []
            for w in K.hashed_words(batch["text"]):
                at, h = w.windows(block)
                bit = (h >> K.U64(64 - INDEX_BITS)).astype(np.int64)
                on = np.flatnonzero((index[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                doc, place = _places(w, at[on])
                found.append((h[on], uids[w.lo + doc], place))
            if found:
                h, uid, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _seen(h, np.zeros(len(h), np.int64), uid, place, place % block == 0)

    return K.tidy(run)


def _candidates(window: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, places, found = batch["uid"].to_numpy(), batch["places"], []
            hits, of = places.values.to_numpy(), places.offsets.to_numpy()
            for w in K.hashed_words(batch["text"]):
                at, h = w.windows(window, seed=7)
                held = np.zeros(len(w.hashes) + 1, np.int64)
                row = np.repeat(np.arange(w.lo, w.hi), np.diff(of[w.lo : w.hi + 1]))
                first = w.offsets[row - w.lo]
                hit = hits[of[w.lo] : of[w.hi]] + first
                np.add.at(held, np.maximum(first, hit - (window - block)), 1)  # a window from here to the hit holds it
                np.add.at(held, hit + 1, -1)
                on = np.cumsum(held)[at] > 0
                at, h = at[on], h[on]
                other = K.span_hashes(K.mix(w.hashes, 11), at, at + window, seed=13)
                doc, place = _places(w, at)
                found.append((h, (other >> K.U64(32)).astype(np.int64), uids[w.lo + doc], place))
            if found:
                h, h2, uid, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _seen(h, h2, uid, place, np.ones(len(h), bool))

    return K.tidy(run)


def _removed(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(_bytes(batch["text"]), batch["places"], strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                at = places.values.to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                stay = np.cumsum(gone)[:-1] == 0
                removed.append(int((~stay).sum()))
                kept.append(hashlib.sha256(b" ".join(x for x, s in zip(words, stay.tolist(), strict=True) if s)).hexdigest())
            yield pa.record_batch([batch["uid"], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["uid", "n_removed", "kept_sha256"])

    return K.tidy(run)


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame, int]:
    """(texts, found, seed): distinct texts of at least window words (uid, text, several) and their repeated windows (uid, places)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    small_batches(spark)
    block = (window + 1) // 2
    for seed in range(8):
        firsts = docs.select("text").mapInArrow(_firsts(window, seed), "uid long, check long, text string")
        one = firsts.groupBy("uid").agg(F.max("text").alias("text"), (F.count("*") > 1).alias("several"), (F.min("check") != F.max("check")).alias("clash"))
        texts = bucketed(one, "uid", "repeats")
        if not texts.where("clash").take(1):
            break
    else:
        raise RuntimeError("different texts had equal names eight times over")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = texts.select("text").mapInArrow(_blocks(block), "segment int, bits binary").repartition(n, "segment").mapInArrow(_segments, "segment int, bits binary").toArrow()
    index = np.zeros(1 << (INDEX_BITS - 3), np.uint8)  # of fixed size
    for segment, bits in zip(segments["segment"].to_pylist(), segments["bits"].to_pylist(), strict=True):
        index[segment << (SEGMENT_BITS - 3) :][: 1 << (SEGMENT_BITS - 3)] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(index.tobytes())
    hits = _repeated(texts.select("uid", "text").mapInArrow(_probes(block, shared), _SEEN))
    found = written(_repeated(texts.join(hits, "uid").select("uid", "text", "places").mapInArrow(_candidates(window, block), _SEEN)), "repeated")
    return texts, found, seed


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts, found, seed = repeated_windows(docs, window)
    single = texts.where("NOT several").join(found, "uid").select("uid", "text", "places").mapInArrow(_removed(window), "uid long, n_removed long, kept_sha256 string")
    whole = texts.where("several").select("uid", F.lit(-1).cast("long").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(seed), "doc_id long, uid long, n_words long, whole string")
    out = rows.join(single.union(whole), "uid", "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
