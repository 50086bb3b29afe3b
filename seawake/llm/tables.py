"""Bucketed intermediate tables, tables of counts summed over tasks, and bitmaps of fixed size that spare a shuffle what it need not carry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import scratch


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder in buckets of key: one shuffle now, none in later joins on key."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"seawake_{name}_{uuid.uuid4().hex}"
    (
        df.repartition(n, key)
        .write.format("parquet")
        .option("path", f"{scratch(spark)}/{table}")
        .option("compression", "zstd")
        .bucketBy(n, key)
        .saveAsTable(table)
    )
    return spark.table(table)


SEGMENT = 1 << 13
SEGMENTS = "segment int, counts binary"


def segments_of(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts in segments, those that are not empty: a row for SEGMENT counts, not for each."""
    for i, part in enumerate(table.reshape(-1, SEGMENT)):
        if part.any():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.astype(np.int64).tobytes()], pa.binary())], names=["segment", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch["segment"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums.setdefault(i, np.zeros(SEGMENT, np.int64))[:] += np.frombuffer(counts, np.int64)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["segment", "counts"])


def summed(segments: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables of `size` counts; segments are dealt out before they reach the driver."""
    n = min(size // SEGMENT, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(size, np.int64)
    found = segments.repartition(n, "segment").mapInArrow(_added, SEGMENTS).toArrow()
    for i, counts in zip(found["segment"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[i * SEGMENT : (i + 1) * SEGMENT] = np.frombuffer(counts, np.int64)
    return out


def _bits(bits: int, segment: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            for s in np.unique(at >> segment).tolist():
                maps.setdefault(s, np.zeros(1 << segment, bool))[at[at >> segment == s] & ((1 << segment) - 1)] = True
        if maps:
            yield pa.record_batch([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())], names=["segment", "bits"])

    return run


def bitmap(hashes: DataFrame, bits: int = 25, segment: int = 18) -> bytes:
    """2**bits bits, one set by the high bits of every value of the only column: a filter that lets through all of them, and more as it fills.

    Segments are dealt out before they reach the driver, where the whole has its fixed size.
    """
    spark = hashes.sparkSession
    n = min(1 << (bits - segment), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = hashes.distinct().selectExpr(f"{hashes.columns[0]} AS h", f"shiftrightunsigned({hashes.columns[0]}, {64 - bits + segment}) AS segment").repartition(n, "segment").select("h")
    out = np.zeros(1 << (bits - 3), np.uint8)
    found = rows.mapInArrow(_bits(bits, segment), "segment int, bits binary").toArrow()
    for s, b in zip(found["segment"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[s << (segment - 3) :][: 1 << (segment - 3)] |= np.frombuffer(b, np.uint8)
    return out.tobytes()


def in_bitmap(shared, bits: int = 25) -> Callable[[pa.Array], pa.Array]:
    """For F.arrow_udf: whether a hash may be among those of a broadcast bitmap."""

    def test(hashes: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.uint8)
        at = (hashes.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pa.array(((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return test
