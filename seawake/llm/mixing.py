"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share
  the size of all documents; a target stops at ``most_passes`` times its
  source's size and the excess is shared again by weight until none is above.
* Schedule: slot i falls to the source in whose part of the cumulative targets
  the fractional part of (i + 1/2) times the golden ratio lies. Slots are ranked
  per source; a source that is a few slots short at the end gets them after.
* Blocks: each source's documents, shuffled by a hash of doc_id, are cut into
  blocks of ``block`` words. The slot of rank r takes block r modulo the number
  of blocks, the last slot only as much as the target still wants. So each
  source's taken words are its rounded target, and a document's slots tell where
  in the mix it stands: mix() gives documents in the order of their slots, each
  once for every pass over its source that takes any of it.

Ranks and positions are prefix sums of two levels, so that no source, however
hot, is ordered in one task. A null text has size 0 and takes 0; documents
without words keep their rows, without a slot. Null and repeated ids and repeated rows are rows of
their own. Extra columns are ignored, or kept by mix(). An empty table gives an
empty result. The number of sources must not exceed MOST_SOURCES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import file_count, fresh, small_batches, written

GOLDEN = (5**0.5 - 1) / 2
BLOCK_WORDS = 1024
MOST_SOURCES = 1_000_000
CHUNK_SLOTS = 1 << 16


def water_fill(sizes: list[int], weights: list[int], most_passes: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above most_passes times its size."""
    total, caps = float(sum(sizes)), [float(most_passes * s) for s in sizes]
    left, weight, level = total, float(sum(weights)), 0.0
    for i in sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i]):
        level = left / weight if weight else 0.0
        if caps[i] > level * weights[i]:
            break
        left, weight = left - caps[i], weight - weights[i]
    else:
        level = float("inf")
    return [min(c, level * w) if c else 0.0 for c, w in zip(caps, weights, strict=True)]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(t.split()) for t in batch["text"].fill_null("").cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch["doc_id"], batch["source"], batch["h"], pa.array(n, pa.int64())], names=["doc_id", "source", "h", "size"])


def _slots(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["id"].to_numpy()
            point = np.modf((slot + 0.5) * GOLDEN)[0] if len(slot) and slot[-1] < 1 << 40 else np.array([((2 * s + 1) * 0x9E3779B97F4A7C15 >> 1) % (1 << 64) / 2.0**64 for s in slot.tolist()])
            source = np.minimum(np.searchsorted(edges, point, "right"), len(edges) - 1)
            yield pa.record_batch([batch["id"], pa.array(source, pa.int32())], names=["slot", "source_no"])

    return run


class Mixture:
    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, block: int = BLOCK_WORDS):
        if most_passes < 1 or block < 1 or min(weights) < 1:
            raise ValueError("weights, most_passes and block are positive")
        self.spark, self.block = docs.sparkSession, block
        small_batches(self.spark)
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"), "text")
        sized = written(slim.mapInArrow(_sizes, "doc_id long, source string, h long, size long"), "sizes")
        rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows.sort(key=lambda r: (r.source is None, r.source or ""))
        self.names, self.sizes = [r.source for r in rows], [r["size"] for r in rows]
        self.targets = water_fill(self.sizes, [weights[i % len(weights)] for i in range(len(rows))], most_passes)
        self.files = file_count(self.spark, sum(r.n for r in rows))
        blocks = [-(-s // block) for s in self.sizes]
        wanted = [round(t) for t in self.targets]
        self.plan = self.spark.createDataFrame(
            [(i, a, s, t, w, b, (w // s) * b + -(-(w % s) // block) if s else 0) for i, (a, s, t, w, b) in enumerate(zip(self.names, self.sizes, self.targets, wanted, blocks, strict=True))],
            "source_no int, source string, source_size long, target double, wanted long, blocks long, slots long",
        )
        # MOST_SOURCES bounds the plan; Spark decides by its size whether to broadcast it.
        numbered = sized.join(self.plan, sized.source.eqNullSafe(self.plan.source)).select("doc_id", sized.source, "h", "size", "source_no", "source_size", "target")
        self.places = written(self._placed(numbered), "places", self.files)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """start: words of the same source before the document in hash order."""
        # Rows without an id are told apart by their text.
        rows = rows.withColumn("key", F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.col("h").cast("string"))))))
        rows = rows.withColumn("part", F.substring("key", 1, 3))
        parts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("source_no", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        own = Window.partitionBy("source_no", "part").orderBy("key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0))).join(parts, ["source_no", "part"])
        return placed.select("doc_id", "source", "h", "size", "source_no", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))

    def schedule(self) -> DataFrame:
        """slot, source_no, rank, block_no, words and pass (over the source, from 0) of every slot."""
        plan = self.plan.toArrow().sort_by("source_no")
        slots = plan["slots"].to_numpy()
        n = int(slots.sum())
        if not n:
            return self.spark.createDataFrame([], "slot long, source_no int, rank long, block_no long, words long, pass long")
        edges = np.cumsum(slots) / n
        parts = max(1, min(20_000, n // CHUNK_SLOTS))
        drawn = self.spark.range(0, n, 1, parts).mapInArrow(_slots(edges), "slot long, source_no int").withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
        counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        own = Window.partitionBy("source_no", "chunk").orderBy("slot")
        ranked = drawn.withColumn("inner", F.row_number().over(own) - 1).join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("base") + F.col("inner")).alias("rank"))
        had = drawn.groupBy("source_no").agg(F.count("*").alias("had"))
        short = self.plan.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
        short = short.select((F.lit(n) + F.col("source_no")).alias("slot"), "source_no", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank"))
        slots_of = ranked.unionByName(short).join(self.plan, "source_no").where("rank < slots")
        start = F.expr("floor(rank / blocks)") * F.col("source_size") + F.expr("rank % blocks") * self.block
        words = F.least(F.lit(self.block), F.col("source_size") - F.expr("rank % blocks") * self.block, F.col("wanted") - start)
        return slots_of.select("slot", "source_no", "rank", F.expr("rank % blocks").alias("block_no"), words.alias("words"), F.expr("floor(rank / blocks)").alias("pass"))

    def _met(self) -> DataFrame:
        """Documents with words, cut at the ends of blocks, met with the slots that take the blocks: overlap is in words."""
        some = self.places.where("size > 0")
        pieces = some.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block))))
        begin = F.col("block_no") * self.block
        overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), begin + F.col("words")) - F.greatest("start", begin))
        return pieces.join(self.schedule(), ["source_no", "block_no"], "left").withColumn("overlap", F.when(F.col("words").isNotNull(), overlap).otherwise(0))

    def taken(self) -> DataFrame:
        """doc_id, source, h, size, source_size, target, taken, first_slot (null: not taken) of every row."""
        keys = ["source_no", "start", "doc_id", "source", "h", "size", "source_size", "target"]  # source and start tell documents with words apart
        out = self._met().groupBy(*keys).agg(F.sum("overlap").alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("slot"))).alias("first_slot"))
        columns = ["doc_id", "source", "h", "size", "source_size", "target", "taken", "first_slot"]
        none = self.places.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
        return out.select(*columns).unionByName(none.select(*columns))

    def mix(self, docs: DataFrame) -> DataFrame:
        """docs as often as the mix takes any of their words in a pass over their source, in the order of their first slot in that pass.

        Documents without words are left out. Rows equal in doc_id, source and text all get the passes of any of them.
        """
        key, id_, source, h, slot, turn, start = fresh(docs, "key", "id", "source", "h", "slot", "turn", "start")
        takes = self._met().where("overlap > 0").groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("h").alias(h), F.col("pass").alias(turn)).agg(F.min("slot").alias(slot), F.min("start").alias(start))
        keyed = docs.withColumn(key, F.xxhash64("text"))
        met = keyed.join(takes, (F.col(key) == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
        return met.orderBy(slot, start, id_, turn).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (to 6 places), taken, first_slot."""
    return Mixture(docs).taken().select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")
