"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles; with fewer words, its
whole word sequence is its one shingle; without words its set is empty and it
links with nothing. Two documents link when ``den * |A & B| >= num * |A | B|``.
Equal sets are one node from the start.

* Shingles are ordered by a frequency table over all documents (hash buckets,
  their number by the size of the input), rarest first. A linked pair shares at
  least l of the first ``n - ceil(t n) + l`` shingles of each, whatever l is.
* Each document picks its own l: a longer prefix where the estimated lists of
  its prefix are long. Pair (x, y) is verified only if its prefixes share
  min(l_x, l_y) shingles, and if its sizes allow the threshold.
* Components are what is asked for, so no large group of documents under one
  shingle is expanded into all its pairs (groups of at most SMALL nodes are, once
  and for all). In each round the most central documents of a
  group (pivots: those whose prefix is commonest) are compared with the members
  of other components only; the last round takes every document as a pivot, so
  that any pair that is still apart has been compared. Groups that have become
  one component drop out. Of shingles that the same documents have, one counts.
  A large group is dealt out in parts of about PART members, which meet all its pivots.
* A pair is dropped early only if it cannot link: by its sizes, or because the
  parity sketches of its sets (a shingle flips a bit) differ in more bits than
  the sets may in shingles. Sketches have 256 bits in small groups, 1024 in large
  ones; sets of over WIDE_FROM shingles have longer ones too.
* Verification compares whole shingle sets made from whole texts.

Null text counts as empty. Repeated rows are equal sets and share a component.
A null doc_id keeps its row; it gives a component its name only when no member
has an id. Extra columns are ignored. An empty table gives an empty result.
Shingles are compared by 64-bit hashes; the 64-bit name of a set is checked
against a second hash and drawn again on a collision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernels as K
from .components import components
from .storage import file_count, fresh, small_batches, written
from .tables import bitmap, in_bitmap, segments_of, summed

#: Buckets of the frequency table, as powers of two: at inputs of half a GB and less, and at most.
TABLE_BITS, MOST_TABLE_BITS = 19, 23
#: Pivots of a group in each round; None: all its members.
ROUNDS = (1, 4, None)
MOST_MATCHES = 4
SMALL = 16
#: Members of a part of a large group.
PART = 256
SKETCH = ("s0", "s1", "s2", "s3")
LONG_SKETCH = tuple(f"s{i}" for i in range(16))
WIDE_FROM = 128


def shingle_sets(words: K.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash) of every distinct shingle, sorted, and each document's count."""
    at, h = words.windows(k, seed=k)
    docs = np.searchsorted(words.offsets, at, "right") - 1
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        docs = np.concatenate([docs, short])
        h = np.concatenate([h, K.span_hashes(words.hashes, words.offsets[short], words.offsets[short + 1], seed=k)])
    order = np.lexsort((h, docs))
    docs, h = docs[order], h[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
        docs, h = docs[keep], h[keep]
    return docs, h, np.bincount(docs, minlength=words.hi - words.lo)


def set_names(docs: np.ndarray, h: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set."""
    bounds = np.searchsorted(docs, np.arange(n + 1))
    out = []
    for s in (2 * seed, 2 * seed + 1):
        with np.errstate(over="ignore"):
            sums = np.zeros(len(h) + 1, K.U64)
            np.cumsum(K.mix(h, 50 + s), out=sums[1:])
            out.append(K.mix(sums[bounds[1:]] - sums[bounds[:-1]], s))
    return out[0], out[1]


def table_bits(size: int) -> int:
    """A bit more for every fourfold input, so that a group of copies that grows with it stands out from the rest."""
    return min(MOST_TABLE_BITS, TABLE_BITS + max(0, size.bit_length() - 30) // 2)


def _named(k: int, seed: int, bits: int) -> Callable:
    names = ["doc_id", "h", "n", "node", "check", "segment", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for w in K.hashed_words(batch["text"], lower=True):
                docs, h, n = shingle_sets(w, k)
                a, b = set_names(docs, h, len(n), seed)
                np.add.at(table, (h >> K.U64(64 - bits)).astype(np.int64), 1)
                rows = len(n)
                yield pa.record_batch([batch["doc_id"].slice(w.lo, rows), batch["h"].slice(w.lo, rows), pa.array(n, pa.int64()), pa.array(K.signed(a)), pa.array(K.signed(b)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        none = pa.nulls(1, pa.int64())
        for part in segments_of(table):
            yield pa.record_batch([none, none, none, none, none, part["segment"], part["counts"]], names=names)

    return K.tidy(run)


def bucket_of(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (h >> K.U64(65 - len(table).bit_length())).astype(np.int64)


def prefix_of(docs: np.ndarray, h: np.ndarray, n: np.ndarray, table: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in the global order with each document's first one, prefix length, l and centrality."""
    load = table[bucket_of(h, table)].astype(np.float64)
    order = np.lexsort((h, load, docs))
    h, load = h[order], load[order]
    mean = float(table.mean())
    extra = np.maximum(load - (mean + 8 * mean**0.5 + 64), 0.0)  # beyond what a bucket has by chance
    sums = np.concatenate([[0.0], np.cumsum(extra)])
    logs = np.concatenate([[0.0], np.cumsum(np.log1p(load))])
    begin = np.searchsorted(docs, np.arange(len(n)))
    shortest = n - (n * num + den - 1) // den + 1
    best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for matches in range(1, MOST_MATCHES + 1):
        size = np.minimum(n, shortest + matches - 1)
        lists = sums[begin + size] - sums[begin]
        now = lists + lists / 2.0 ** (matches - 1) * (1 + n / 8)  # reading the lists, and verifying what is left
        better = (now < cost) & ((matches == 1) | (shortest + matches - 1 <= n))
        best, cost = np.where(better, matches, best), np.where(better, now, cost)
    size = np.where(n > 0, np.minimum(n, shortest + best - 1), 0)
    central = (logs[begin + size] - logs[begin]) / np.maximum(size, 1)
    return h, extra > 0, begin, size, best, central


def parity_sketches(docs: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """int64 matrix (document, 16): every shingle flips one of 1024 bits."""
    out = np.zeros((n, 16), np.int64)
    for lo in range(0, n, 1024):
        i, j = np.searchsorted(docs, [lo, lo + 1024])
        rows = min(1024, n - lo)
        flips = np.bincount((docs[i:j] - lo) * 1024 + (h[i:j] & K.U64(1023)).astype(np.int64), minlength=rows * 1024) & 1
        out[lo : lo + rows] = np.packbits(flips.reshape(rows, 1024).astype(bool), axis=1, bitorder="little").view(np.int64)
    return out


def wide_sketch(h: np.ndarray) -> bytes:
    """As many bits as shingles, or up to twice as many: a power of two."""
    bits = 1 << max(3, len(h).bit_length())
    return np.packbits((np.bincount((h & K.U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded; never more than the sets differ in shingles."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _near_enough(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [sketch_distance(a, b) * (den + num) <= (den - num) * n for a, b, n in zip(batch["wide_a"].to_pylist(), batch["wide_b"].to_pylist(), batch["both"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["a"], batch["b"], batch["need"]], names=["a", "b", "need"]).filter(pa.array(near, pa.bool_()))

    return K.tidy(run)


def _prefixed(k: int, num: int, den: int, seed: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.int64)
        seen: set[int] = set()
        for batch in batches:
            for w in K.hashed_words(batch["text"], lower=True):
                docs, h, n = shingle_sets(w, k)
                names = K.signed(set_names(docs, h, len(n), seed)[0])
                bounds = np.concatenate([[0], np.cumsum(n)])
                wide = {i: wide_sketch(h[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(n > WIDE_FROM).tolist()}
                sketch = parity_sketches(docs, h, len(n))
                h, hot, begin, size, best, central = prefix_of(docs, h, n, table, num, den)
                new = []
                for i, name in enumerate(names.tolist()):
                    if n[i] and name not in seen:
                        seen.add(name)
                        new.append(i)
                if not new:
                    continue
                new = np.array(new)
                at = np.repeat(begin[new] - np.concatenate([[0], np.cumsum(size[new])[:-1]]), size[new]) + np.arange(size[new].sum())
                offsets = pa.array(np.concatenate([[0], np.cumsum(size[new])]), pa.int32())
                yield pa.record_batch(
                    [pa.array(names[new]), pa.array(n[new], pa.int32()), pa.array(best[new], pa.int32()), pa.array((central[new] * 1000).astype(np.int32)), *(pa.array(np.ascontiguousarray(sketch[new, i])) for i in range(16)), pa.array([wide.get(i) for i in new.tolist()], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(K.signed(h[at]))), pa.ListArray.from_arrays(offsets, pa.array(hot[at]))],
                    names=["node", "n", "l", "central", *LONG_SKETCH, "wide", "prefix", "hot"],
                )

    return K.tidy(run)


def _texts(k: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for w in K.hashed_words(batch["text"], lower=True):
                docs, h, n = shingle_sets(w, k)
                names = K.signed(set_names(docs, h, len(n), seed)[0]).tolist()
                new = []
                for i, name in enumerate(names):
                    if n[i] and name not in seen:
                        seen.add(name)
                        new.append(i)
                if new:
                    yield pa.record_batch([pa.array([names[i] for i in new], pa.int64()), batch["text"].take(pa.array([w.lo + i for i in new]))], names=["node", "text"])

    return K.tidy(run)


def _verified(k: int, num: int, den: int) -> Callable:
    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, hashes, counts = [], [], []
        for w in K.hashed_words(column, lower=True):
            docs, h, n = shingle_sets(w, k)
            rows.append(docs + w.lo)
            hashes.append(h)
            counts.append(n)
        return np.concatenate(rows), np.concatenate(hashes), np.concatenate(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                ra, ha, na = sets(batch["text_a"])
                rb, hb, nb = sets(batch["text_b"])
                rows, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                both = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=batch.num_rows)
                linked = pa.array(den * both >= num * (na + nb - both))
                yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(linked)

    return K.tidy(run)


class JaccardJoin:
    """links() and classes() of one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100):
        if k < 1 or not 0 < num <= den:
            raise ValueError("k is at least 1 and the threshold above 0 and at most 1")
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.comps: DataFrame | None = None
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        small_batches(self.spark)

    def _name_sets(self) -> None:
        bits = table_bits(int(self.docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        for seed in range(8):
            rows = written(self.docs.mapInArrow(_named(self.k, seed, bits), "doc_id long, h long, n long, node long, check long, segment int, counts binary"), "sets")
            self.rows = rows.where("segment IS NULL").select("doc_id", "h", "n", "node", "check")
            clash = self.rows.where("n > 0").groupBy("node").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").limit(1)
            if not clash.take(1):
                break
        else:
            raise RuntimeError("different sets had equal names eight times over")
        self.seed = seed
        self.files = file_count(self.spark, self.rows.count())
        table = summed(rows.where("segment IS NOT NULL").select("segment", "counts"), 1 << bits)
        self.table = self.spark.sparkContext.broadcast(table.tobytes())

    def _lists(self) -> None:
        """Prefix shingles that two nodes or more have, by the size of the group: self.small and self.large."""
        sketches = ", ".join(f"{c} long" for c in LONG_SKETCH)
        self.nodes = written(self.docs.select("text").mapInArrow(_prefixed(self.k, self.num, self.den, self.seed, self.table), f"node long, n int, l int, central int, {sketches}, wide binary, prefix array<long>, hot array<boolean>"), "prefixes", most=16 * self.files)
        rows = self.nodes.select("node", F.explode(F.arrays_zip("prefix", "hot")).alias("x")).select(F.col("x.prefix").alias("token"), "node", F.when(F.col("x.hot"), F.pmod(F.hash("node"), F.lit(64)) + 1).otherwise(0).alias("salt"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "token", "salt").dropDuplicates(["token", "salt", "node"])
        # A shingle that the table calls rare has a short list. The others are dealt out and counted after.
        several = F.count("*").over(Window.partitionBy("token", "salt"))
        kept = written(rows.withColumn("several", several).where("salt > 0 OR several > 1"), "lists", most=16 * self.files)
        dealt = kept.where("salt > 0").drop("several")
        sizes = dealt.groupBy("token", "salt").agg(F.count("*").alias("several")).withColumn("several", F.sum("several").over(Window.partitionBy("token")))
        lists = kept.where("salt = 0").select("token", "node", "several").union(dealt.join(sizes, ["token", "salt"]).where("several > 1").select("token", "node", "several"))
        folded = [F.expr(f"s{i} ^ s{i + 4} ^ s{i + 8} ^ s{i + 12}").alias(f"s{i}") for i in range(4)]
        heads = self.nodes.select("node", "n", "l", *folded).dropDuplicates(["node"])
        self.small = written(lists.where(F.col("several") <= SMALL).select("token", "node").join(heads, "node"), "small", most=16 * self.files)
        large = lists.where(F.col("several") > SMALL).withColumn("parts", F.ceil(F.col("several") / PART).cast("int"))
        large = written(large.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) AS int)")), "large", self.files)
        same = large.groupBy("token", "parts").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
        one = same.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.first("parts").alias("parts"))
        one = one.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        heads = self.nodes.select("node", "n", "l", "central", *LONG_SKETCH).dropDuplicates(["node"])
        self.large = written(large.join(one, ["token", "part"], "left_semi").join(heads, "node"), "groups", self.files)

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """node, text of the nodes of pairs. Documents whose hash is in none of them stay where they are."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        hashes = self.rows.where("n > 0").select("node", "h").join(wanted, "node", "left_semi").select("h")
        shared = self.spark.sparkContext.broadcast(bitmap(hashes))
        may = F.arrow_udf(in_bitmap(shared), "boolean")
        named = self.docs.where(may("h")).select("text").mapInArrow(_texts(self.k, self.seed), "node long, text string")
        return written(named.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts", most=16 * self.files)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b), a the pivot: those that link. A pivot's many partners are dealt out in parts."""
        pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(256)))
        texts = self._texts(pairs)
        other = pairs.join(texts, pairs.b == texts.node).select("a", "part", "b", F.col("text").alias("text_b"))
        pivots = pairs.select("a", "part").distinct().join(texts, F.col("a") == texts.node).select("a", "part", F.col("text").alias("text_a"))
        both = other.hint("merge").join(pivots.hint("merge"), ["a", "part"])
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(self.k, self.num, self.den), "a long, b long")

    def _may(self, flipped: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m shingles, whose sketches differ in `flipped` bits, may link."""
        return (self.den * F.least(n, m) >= self.num * F.greatest(n, m)) & (flipped * (self.den + self.num) <= (self.den - self.num) * (n + m))

    def _small_pairs(self) -> DataFrame:
        """All pairs of small groups that may link."""
        groups = self.small.groupBy("token").agg(F.collect_list(F.struct("node", "n", "l", *SKETCH)).alias("g"))  # SMALL rows at most

        def flipped(x: Column, y: Column) -> Column:
            return sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in SKETCH[1:]), F.bit_count(x[SKETCH[0]].bitwiseXOR(y[SKETCH[0]])))

        def with_others(x: Column) -> Column:
            others = F.filter("g", lambda y: (y["node"] > x["node"]) & self._may(flipped(x, y), x["n"], y["n"]))
            return F.transform(others, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.least(x["l"], y["l"]).alias("need"), F.least(x["n"], y["n"]).alias("least"), (x["n"] + y["n"]).alias("both")))

        pairs = groups.select(F.inline(F.flatten(F.transform("g", with_others))))
        return pairs.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("need", "least", "both")))

    def _met(self, most: int | None, comps: DataFrame | None) -> DataFrame:
        """Rows of a pivot (_a) and another node of its group that may link and are not of one component yet."""
        lists = self.large
        whole = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        if comps is not None:
            lists = lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            apart = lists.groupBy("token", "parts").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token", whole)
            lists = written(lists.join(apart, ["token", "part"], "left_semi"), "apart", self.files)
        else:
            lists = lists.withColumn("comp", F.col("node"))
        head = ("node", "comp", "n", "l", "central", *LONG_SKETCH)
        pivots = lists
        if most:
            for key in (("token", "part"), ("token",)):
                place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("central"), F.desc("node")))
                pivots = pivots.withColumn("place", place).where(F.col("place") <= most)
        pivots = pivots.select("token", whole, *(F.col(c).alias(f"{c}_a") for c in head))
        flipped = F.expr(" + ".join(f"bit_count({c} ^ {c}_a)" for c in LONG_SKETCH))
        may = self._may(flipped, F.col("n"), F.col("n_a")) & F.expr("comp != comp_a" + ("" if most else " AND node_a < node"))
        return lists.hint("merge").join(pivots.hint("merge"), (lists.token == pivots.token) & (lists.part == pivots.part) & may)

    def _candidates(self, most: int | None, comps: DataFrame | None, done: DataFrame | None) -> DataFrame:
        """a, b, need: pairs of a pivot and another node under a common shingle that may link and are not linked yet."""
        met = self._met(most, comps)
        pairs = met.groupBy(F.col("node_a").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("met"), F.first(F.least("l", "l_a")).alias("need"), F.first(F.least("n", "n_a")).alias("least"), F.first(F.col("n") + F.col("n_a")).alias("both"))
        if comps is None:  # at first one partner each: that with which it shares most
            pairs = pairs.groupBy("b").agg(F.max_by(F.struct("a", "need", "least", "both"), F.struct("met", "a")).alias("p")).select("b", "p.*")
        pairs = pairs.select("a", "b", "need", "least", "both")
        if comps is None:
            pairs = pairs.union(self._small_pairs())
        if done is not None:
            same = done.select("a", "b").union(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(same, ["a", "b"], "left_anti")
        wides = self.nodes.where("wide IS NOT NULL").groupBy("node").agg(F.first("wide").alias("wide"))
        wa, wb = (wides.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}")) for x in "ab")
        long = pairs.where(F.col("least") > WIDE_FROM).join(wb, "b").join(wa, "a").select("a", "b", "need", "both", "wide_a", "wide_b")
        near = long.mapInArrow(_near_enough(self.num, self.den), "a long, b long, need int")
        return pairs.where(F.col("least") <= WIDE_FROM).select("a", "b", "need").union(near)

    def _multi_matched(self, pairs: DataFrame) -> DataFrame:
        """Of pairs that need more than one shared prefix shingle, those that have them."""
        one, more = pairs.where("need = 1").select("a", "b"), pairs.where("need > 1")
        wanted = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        prefixes = self.nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("prefix").alias("prefix"))
        pa_, pb_ = (prefixes.select(F.col("node").alias(x), F.col("prefix").alias(f"p_{x}")) for x in "ab")
        met = more.join(pb_, "b").join(pa_, "a").where(F.size(F.array_intersect("p_a", "p_b")) >= F.col("need"))
        return one.union(met.select("a", "b"))

    def components(self) -> DataFrame:
        """(node, comp) of every node that links with another."""
        if self.comps is None:
            self.comps = self._components()
        return self.comps

    def _components(self) -> DataFrame:
        self._name_sets()
        self._lists()
        edges = comps = done = None
        for most in ROUNDS:
            pairs = written(self._candidates(most, comps, done), "candidates", self.files)
            if not pairs.take(1):  # pivots may be far from all while others link: only the last round settles that
                if comps is None:
                    comps = self.spark.createDataFrame([], "node long, comp long")
                continue
            matched = written(self._multi_matched(pairs), "matched", self.files)
            links = written(self._verify(matched), "links", self.files)
            done = pairs if done is None else written(done.select("a", "b", "need").union(pairs), "done", self.files)
            edges = links if edges is None else edges.union(links)
            comps = written(components(edges, self.files), "components", self.files)
        return comps

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        comps = self.components()
        least = self.rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
        named = least.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_node = named.select("node", "comp").join(ids, "comp").select("node", "component_id")
        full = self.rows.where("n > 0").join(by_node, "node", "left")
        rows = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return rows.union(self.rows.where("n = 0").select("doc_id", "n", "doc_id"))

    def first_of_each(self) -> DataFrame:
        """doc_id, h (xxhash64 of text) of the row of each component with the least doc_id (null last)."""
        comps = self.components()
        named = self.rows.where("n > 0").select("doc_id", "h", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        first = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"))
        return first.select("first.doc_id", "first.h")


def near_duplicate_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    return JaccardJoin(docs, k, num, den).classes()


def without_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component (the least doc_id; null last), all columns. Documents without words stay."""
    key, id_, h = fresh(docs, "key", "id", "h")
    first = JaccardJoin(docs, k, num, den).first_of_each().select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    words = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    met = keyed.where(words).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(h)))
    one = met.groupBy(id_, h).agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns))  # rows that repeat
    return one.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.where(~words))
