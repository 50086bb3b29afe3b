"""Order MinHash fingerprints.

A text's k-mers (runs of k words; a shorter text is one k-mer) are numbered by
occurrence, so that repeated ones differ. For each of m hash functions the
``TUPLE`` least k-mers are taken and put back into text order, and the tuple is
hashed to 32 bits: unlike MinHash, moving text about changes the signature, so
likeness (the share of equal entries) follows edit distance.

A null text counts as empty; texts without words share one fingerprint. Equal
texts have equal fingerprints. Rows are ordered by descending doc_id (null
last; equal ids by descending text), so repeated rows follow one another and a
single row follows itself. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches

KMER, FUNCTIONS, TUPLE = 2, 32, 2
#: Bounds of doc_id ranges that are kept on the driver.
MOST_RANGES = 20_000


def occurrence_numbered(docs: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that tell the first, second, ... occurrence of a k-mer in a text apart."""
    order = np.lexsort((h, docs))
    a, d = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    with np.errstate(over="ignore"):
        return K.mix(h + number.astype(K.U64) * K.U64(0x9FB21C651E98DF25), 41)


def signatures(texts: pa.Array, k: int = KMER, m: int = FUNCTIONS) -> np.ndarray:
    """uint32 matrix (text, m)."""
    out = np.zeros((len(texts), m), np.uint32)
    for w in K.hashed_words(texts):
        at, h = w.windows(k, seed=k)
        docs = np.searchsorted(w.offsets, at, "right") - 1
        counts = w.counts()
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            docs = np.concatenate([docs, short])
            h = np.concatenate([h, K.span_hashes(w.hashes, w.offsets[short], w.offsets[short + 1], seed=k)])
            order = np.argsort(docs, kind="stable")
            docs, h = docs[order], h[order]
        if not len(h):
            continue
        h = occurrence_numbered(docs, h)
        some, begin, size = np.unique(docs, return_index=True, return_counts=True)
        for j in range(m):
            v = _permuted(h, j)
            one = np.minimum.reduceat(v, begin)
            first = np.flatnonzero(v == np.repeat(one, size))
            if len(first) != len(some):  # equal values in a text: the foremost counts
                first = first[np.unique(docs[first], return_index=True)[1]]
            v[first] = ~K.U64(0)
            two = np.minimum.reduceat(v, begin)
            second = np.flatnonzero(v == np.repeat(two, size))
            if len(second) != len(some):
                second = second[np.unique(docs[second], return_index=True)[1]]
            with np.errstate(over="ignore"):
                pair = K.mix(np.where(first <= second, one, two) * K.U64(3) + np.where(first <= second, two, one), 43)
            out[w.lo + some, j] = (pair >> K.U64(32)).astype(np.uint32)
    return out


def _permuted(h: np.ndarray, j: int) -> np.ndarray:
    odd = int(K.mix(np.array([j], K.U64), 42)[0]) | 1
    with np.errstate(over="ignore"):
        v = h * K.U64(odd)
        v ^= v >> K.U64(32)
        v *= K.U64(0xD6E8FEB86659FD93)
    return v


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range; the row after the last of a range, marked `after`, closes it."""
    held: tuple | None = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = list(zip(part["range"].to_pylist(), part["doc_id"].to_pylist(), part["text"].fill_null("").to_pylist(), part["after"].to_pylist(), strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            texts = [r[2] for r in rows]
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][3]]
            if not pairs:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in pairs]
            own = signatures(pa.array(texts, pa.string()))
            new = signatures(pa.array(changed, pa.string()))
            at = np.array(pairs)
            yield pa.record_batch(
                [
                    pa.array([rows[i][1] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array(_hex(own[at])),
                    pa.array(_hex(new)),
                    pa.array((own[at] == new).mean(axis=1)),
                    pa.array((own[at] == own[at + 1]).mean(axis=1)),
                ],
                names=_COLUMNS,
            )


def _ranges(bounds: np.ndarray) -> Callable:
    def number(ids: pa.Array) -> pa.Array:
        """0 for the largest ids, then on; null ids come last."""
        found = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        return pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), found, len(bounds) + 1).astype(np.int32))

    return number


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside that of the text edited with its successor's head."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = min(MOST_RANGES, 4 * n)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / several for i in range(1, several)], 10 * several).alias("b")).first().b or []
    bounds = np.unique(np.array(bounds, np.int64))
    number = F.arrow_udf(_ranges(bounds), "int")
    ids = docs.select("doc_id", number("doc_id").alias("range"))
    heads = sorted(ids.groupBy("range").agg(F.max("doc_id").alias("doc_id")).toArrow().to_pylist(), key=lambda r: r["range"])
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    # The head of each range, here of at most MOST_RANGES, also closes the range before it.
    closes = [(h["doc_id"], heads[i - 1]["range"]) for i, h in enumerate(heads)]
    closing = F.broadcast(spark.createDataFrame(closes, "head long, range int"))
    after = docs.join(closing, docs.doc_id.eqNullSafe(F.col("head"))).groupBy("range", "doc_id").agg(F.max(F.struct("text")).alias("t"))
    after = after.select("doc_id", F.col("t.text").alias("text"), "range", F.lit(True).alias("after"))
    rows = docs.select("doc_id", "text", number("doc_id").alias("range"), F.lit(False).alias("after")).unionByName(after)
    dealt = rows.repartition(n, "range").sortWithinPartitions("range", "after", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    return dealt.select("range", "doc_id", "text", "after").mapInArrow(_fingerprinted, _SCHEMA)
