"""Mixture-controlled packing by deficit round-robin.

Every document becomes the ids of its whole text and an end id. Each source is
a queue (beyond MOST_QUEUES sources, sources share queues by hash). In every
round, one window of ``window`` tokens, a queue earns its target proportion of
the window; it sends when its deficit has reached ``least`` tokens, so that
queues with little to send are not cut to crumbs, and what it may not send yet
is carried on. Target proportions are those of the queues' tokens, so that all
queues end together and the whole corpus is packed in its own mixture; or they
are given (targets: a weight for each source, others weigh nothing until those have
ended). A queue that ends early leaves its room to the others, in their proportions.

Credits after any round have a closed form. So a token's place in the packed
stream follows from its place in its queue, and every task can pack its own
documents; places in queues are prefix sums of two levels (within a written
file, and over files). The stream is cut every ``window`` tokens; what is left at
its end is cut into powers of two, which need no padding.

A null or empty text is its end id alone. Null and repeated ids and repeated rows are
documents of their own; a null source is a queue. Extra columns are ignored. An
empty table gives an empty result. Ids of at most 2**16 are stored in two
bytes, larger ones in four.
"""

from __future__ import annotations

import itertools
import os
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches, written

WINDOW, LEAST, END_ID = 2048, 128, 1
MOST_QUEUES = 4096
#: Places of queues in so many parts of the stored ids are broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_BASES = 200_000
#: Words whose ids a worker remembers.
MOST_WORDS = 1_000_000

CUT = tuple(np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (string.digits + string.ascii_lowercase, string.punctuation))

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        kind = "<u2" if found.get_vocab_size(True) <= 1 << 16 else "<u4"
        known = Vocabulary(kind) if _by_words(found) else None
        _tokenizers[path] = found, known, [t.content.encode() for t in found.get_added_tokens_decoder().values()], kind
    return _tokenizers[path]


#: Texts by which a tokenizer shows whether it may be given words one by one.
PROBES = ("Hello, World", "don't", "a.b-c", "x  y", "A\tB\n c", " it's 3.5% ok. ", "été naïve", "日本 語", "end.\n\nNew (line)", "x1_y2", "(a)b")


def _by_words(tokenizer) -> bool:
    """Whether ids of a text are those of its lower-case words, punctuation apart, one after the other."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for text in PROBES:
        w = next(K.hashed_words(pa.array([text]), lower=True, cut=CUT))
        raw = w.data.tobytes()
        if ids(text) != [i for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True) for i in ids(raw[a:b].decode())]:
            return False
    return True


class Vocabulary:
    """Ids of the words met so far: sorted word hashes with places in one array of ids."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted hashes are not known."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return ~known

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Sorted new hashes, and the ids of each word."""
        raw = np.frombuffer(b"".join(ids), self.kind)
        size = np.array([len(x) for x in ids], np.int64) // raw.itemsize
        while self.used + len(raw) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(raw)] = raw
        at = np.searchsorted(self.hashes, hashes)
        self.place = np.insert(self.place, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(raw)

    def spans(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.place[at], self.size[at]


def _encode_words(words: list[bytes], tokenizer, special: list[bytes], kind: str) -> list[bytes]:
    """Ids of each word."""
    mark, out = special[0].decode() if special else "", []
    for lo in range(0, len(words), 1000):
        part = words[lo : lo + 1000]
        if mark:  # one call for many words: a special token stands between them, as it stands in none
            joined = mark.join([w.decode("utf-8", "replace") for w in part])
            found = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, kind)
            ends = np.flatnonzero(found == tokenizer.token_to_id(mark))
            raw, size = found.tobytes(), found.itemsize
            begin, end = ((ends + 1) * size).tolist(), (ends * size).tolist()
            out += [raw[a:b] for a, b in zip([0, *begin], [*end, len(raw)], strict=True)]
        else:
            out += [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
    return out


def encode(texts: pa.Array, path: str) -> tuple[list[bytes], str]:
    """Ids of each text, as bytes of the dtype that is also returned.

    The tokenizer drops white space, lowers case and never joins across white
    space, nor from a letter or digit to punctuation. So ids are remembered by
    lower-case word, punctuation apart (by its 64-bit hash). A text with the string of a special token goes to
    the tokenizer whole, and so do all texts if the tokenizer does not show this on PROBES.
    """
    tokenizer, known, special, kind = _tokenizer(path)
    if known is None:
        whole = texts.fill_null("").cast(pa.string()).to_pylist()
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, kind).tobytes() for t in whole], kind
    out: list[bytes] = []
    for w in K.hashed_words(texts, lower=True, most=1 << 19, cut=CUT):
        if len(known.hashes) > MOST_WORDS:
            known.clear()
        raw = w.data.tobytes()
        hashes, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(known.missing(hashes))
        if len(new):
            spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)
            known.add(hashes[new], _encode_words([raw[a:b] for a, b in spans], tokenizer, special, kind))
        place, size = known.spans(hashes)
        place, size = place[inverse], size[inverse]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = known.ids[np.repeat(place - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[w.offsets].tolist()
        made = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        if any(s in raw for s in special):
            for i in range(w.lo, w.hi):
                text = texts[i].as_py()
                text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""
                if any(s in text.encode().lower() for s in special):
                    made[i - w.lo] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()
        out += made
    return out, kind


def _tokenized(path: str, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sent: dict = {}
        for batch in batches:
            for piece in (batch,):
                ids, kind = encode(piece["text"], path)
                tail = np.array([end], kind).tobytes()
                starts, counts = [], []
                for queue, x in zip(piece["queue"].to_pylist(), ids, strict=True):
                    n = len(x) // len(tail) + 1
                    starts.append(sent.get(queue, 0))
                    counts.append(n)
                    sent[queue] = starts[-1] + n
                yield pa.record_batch(
                    [piece["doc_id"], piece["source"], piece["queue"], pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([x + tail for x in ids], pa.binary())],
                    names=["doc_id", "source", "queue", "part", "start", "tokens", "ids"],
                )
        _tokenizers.clear()  # a worker outlives its task, and what comes next may need the room

    return K.tidy(run)


class Credits:
    """Closed form of the deficit round-robin over queues with `totals` tokens; weights: other proportions than those of the totals."""

    def __init__(self, totals: np.ndarray, window: int = WINDOW, least: int = LEAST, weights: np.ndarray | None = None):
        self.totals, self.window = totals.astype(np.int64), window
        self.all = int(self.totals.sum())
        self.given = weights is not None
        weights = np.asarray(weights, float) if self.given else self.totals
        # Queues without a weight begin when the others are at an end, that is with a share too small to be seen before.
        weights = np.where((weights <= 0) & (self.totals > 0), weights[weights > 0].min(initial=1.0) * 1e-6, weights) if self.given else weights
        self.share = weights / max(weights.sum(), 1e-300 if self.given else 1)
        earned = np.maximum(self.share * window, 1e-9)
        self.every = np.maximum(1, np.ceil(least / earned)).astype(np.int64)  # rounds from one turn to the next
        self.shift = (np.arange(len(totals)) * 7919) % self.every

    def sent(self, queue, turn):
        """Tokens that a queue has sent after so many turns."""
        turn = np.maximum(turn, 0)
        credit = turn * self.every[queue] * float(self.window)
        return np.where((credit >= self.all) & (not self.given), self.totals[queue], np.minimum(self.totals[queue], np.floor(credit * self.share[queue]).astype(np.int64)))

    def turns(self, queue: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Turns of a queue that send its tokens lo..hi-1, with what it has sent before each and after the last."""
        step = self.every[queue] * self.window * self.share[queue]
        first = max(1, int(lo / step) - 1)
        turns = np.arange(first, int(hi / step) + 4)
        sent = self.sent(queue, turns)
        before = self.sent(queue, turns - 1)
        on = (sent > lo) & (before < hi)
        return turns[on], np.append(before[on], sent[on][-1:])

    def places(self, queue: int, turns: np.ndarray) -> np.ndarray:
        """Where in the stream each turn begins."""
        rounds = turns * self.every[queue] - 1 - self.shift[queue]
        every = np.arange(len(self.totals))[None, :]
        done = (rounds[:, None] + 1 + self.shift[None, :]) // self.every[None, :]
        past = (rounds[:, None] + self.shift[None, :]) // self.every[None, :]
        return self.sent(every, np.where(every < queue, done, past)).sum(axis=1)


def tail_cuts(total: int, window: int) -> np.ndarray:
    """Ends of the sequences that hold what is left after the last full window."""
    at, cuts = total - total % window, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return np.array(cuts, np.int64)


def pieces(credits: Credits, tail: np.ndarray, queue: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, start, length, sequence and offset of the pieces of documents that follow one another in a queue."""
    window, lo, hi = credits.window, int(starts[0]), int(starts[-1] + sizes[-1])
    turns, edges = credits.turns(queue, lo, hi)
    places = credits.places(queue, turns)
    begin = np.union1d(edges[:-1].clip(lo), starts)
    length = np.diff(np.append(begin, hi))
    turn = np.searchsorted(edges, begin, "right") - 1
    stream = places[turn] + begin - edges[turn]
    doc = np.searchsorted(starts, begin, "right") - 1
    new = np.ones(len(begin), bool)  # turns that follow one another in the stream are one run
    new[1:] = (stream[1:] != stream[:-1] + length[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    begin, stream, doc, length = begin[at], stream[at], doc[at], np.add.reduceat(length, at)
    full = credits.all - credits.all % window
    cuts = (stream + length - 1) // window - stream // window  # ends of windows within each run
    last = stream + length > full
    cuts[last] = np.maximum(0, np.minimum(full, stream[last] + length[last] - 1) // window - stream[last] // window) + np.searchsorted(tail, stream[last] + length[last] - 1, "right") - np.searchsorted(tail, stream[last], "right")
    row = np.repeat(np.arange(len(begin)), cuts + 1)
    step = np.arange(len(row)) - np.repeat(np.cumsum(cuts + 1) - (cuts + 1), cuts + 1)
    first = stream[row] // window + step  # sequence, were there full windows only
    beyond = first >= full // window
    base = np.minimum(stream // window, full // window) + np.where(stream >= full, np.searchsorted(tail, stream, "right"), 0)
    sequence = np.where(beyond | (stream[row] >= full), base[row] + step, first)
    opens = np.where(sequence < full // window, sequence * window, 0)
    closes = opens + window
    over = sequence >= full // window
    if over.any():
        k = sequence[over] - full // window
        opens[over] = np.concatenate([[full], tail])[k]
        closes[over] = tail[k]
    s = np.maximum(stream[row], opens)
    e = np.minimum(stream[row] + length[row], closes)
    return doc[row], begin[row] + (s - stream[row]) - starts[doc[row]], e - s, sequence, s - opens


def _packed(totals: list[int], window: int, least: int, weights: list[float] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        credits = Credits(np.array(totals, np.int64), window, least, None if weights is None else np.array(weights))
        tail = tail_cuts(credits.all, window)
        for batch in batches:
            queues, at, tokens = (batch[c].to_numpy() for c in ("queue_no", "at", "tokens"))
            order = np.lexsort((at, queues))
            q, lo, n = queues[order], at[order], tokens[order]
            new = np.ones(len(order), bool)
            new[1:] = (q[1:] != q[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
            runs = np.flatnonzero(new).tolist()
            parts = []
            for a, b in zip(runs, [*runs[1:], len(order)], strict=True):
                doc, *rest = pieces(credits, tail, int(q[a]), lo[a:b], n[a:b])
                parts.append((order[a + doc], *rest))
            row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            ids, crc, held, whole = batch["ids"], [], -1, b""
            for i, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if i != held:
                    held, raw = i, ids[i].as_py()
                    whole = np.frombuffer(raw, "<u2" if len(raw) == 2 * tokens[i] else "<u4").astype("<u4").tobytes()
                crc.append(zlib.crc32(whole[4 * a : 4 * (a + m)]))
            index = pa.array(row)
            yield pa.record_batch(
                [batch["doc_id"].take(index), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row].astype(np.int64)), pa.array(sequence), pa.array(offset), batch["source"].take(index)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return K.tidy(run)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, least: int = LEAST, end_id: int = END_ID, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    if window < 1 or least < 1:
        raise ValueError("window and least are positive")
    if targets is not None and (min(targets.values(), default=0) < 0 or not any(targets.values())):
        raise ValueError("targets are weights, one of them positive")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    source = F.col("source").cast("string")
    queues = docs.select(source.alias("source")).distinct().limit(MOST_QUEUES + 1).count()
    if targets is not None and queues > MOST_QUEUES:
        raise ValueError(f"targets need a queue for each source; there are over {MOST_QUEUES}")
    queue = source if queues <= MOST_QUEUES else F.pmod(F.xxhash64(source), F.lit(MOST_QUEUES)).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), queue), F.lit("")).alias("queue"), "text")
    schema = "doc_id long, source string, queue string, part int, start long, tokens long, ids binary"
    stored = written(slim.mapInArrow(_tokenized(tokenizer, end_id), schema), "tokens")
    sums = stored.groupBy("queue", "part").agg(F.sum("tokens").alias("n"))
    totals = sorted((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # at most MOST_QUEUES + 1
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    weights = None if targets is None else [float(next((w for s, w in targets.items() if q == ("" if s is None else f"={s}")), 0.0)) for q, _ in totals]
    numbers = spark.createDataFrame([(q, i) for i, (q, _) in enumerate(totals)], "queue string, queue_no int")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(numbers), "queue").select("queue", "part", "base", "queue_no")
    if bases.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES:  # a row for each queue and part; the ids stay where they are
        bases = F.broadcast(bases)
    placed = stored.join(bases, ["queue", "part"]).withColumn("at", F.col("start") + F.col("base"))
    out = placed.select("doc_id", "source", "queue_no", "at", "tokens", "ids")
    return out.mapInArrow(_packed([n for _, n in totals], window, least, weights), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
