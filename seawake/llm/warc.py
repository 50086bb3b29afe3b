"""WARC archives: a writer and a Spark data source.

Writing: every row becomes a record of WARC/1.1. Record and payload are text, so
Spark's own text writer lays them down (records end in CR LF CR LF, the line
separator given to it), with its commit protocol, on whatever file system the
path names. Of rows with equal payloads of at least LEAST_BYTES, that with the
smallest id is a response and the others are revisit records without payload
that refer to it (rows that tie for the smallest id are responses). Digests are
SHA-256 in lower-case hex. A null payload is empty; a null url has no target
header; ids may be null or repeat: of a group of equal payloads without any id all are responses.

Reading: the data source ``warc`` plans partitions of whole files of about
``split`` bytes, takes filters on record_type and on other header columns,
parses a record's headers first and, if they do not pass, skips its block
without reading it into a string. ``payload`` is "text", "digest" (hash and
length only) or "none" (headers only).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from .storage import new_path, small_batches

LEAST_BYTES = 100
END = "\r\n\r\n"
NAME = "urn:x-page:"
SCHEMA = "record_type string, record_id string, target_uri string, content_type string, refers_to string, declared_digest string, declared_bytes long, payload string, payload_digest string, payload_bytes long"
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "content_type": "content-type", "refers_to": "warc-refers-to", "declared_digest": "warc-payload-digest"}


def _name(column) -> F.Column:
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One column, value: a WARC record of each row of pages (page_id, url, html), without the line ends that close it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    long = rows.where(F.col("bytes") >= least_bytes)
    # Counted before the shuffle; a row of `firsts` for each payload that repeats.
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    ids = long.select("page_id", "digest").join(firsts, "digest").where("first IS NOT NULL AND NOT page_id <=> first")
    revisits = ids.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first").distinct()
    # By id and digest, which is even, not by digest alone, which is not.
    told = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "html", "digest", "bytes", "first")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return told.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", _name(F.col("page_id"))),
            line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
            F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _name(F.col("first"))))).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, compression: str = "none") -> None:
    """compression: none (blocks can be skipped by seeking) or gzip (a third of the size)."""
    records(pages, least_bytes).write.option("lineSep", END).option("compression", compression).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _open(path: str) -> BinaryIO:
    stream = _raw(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if path.endswith(".gz") else stream


def _raw(path: str) -> BinaryIO:
    if path.startswith("file:") or path.startswith("/"):
        return open(re.sub("^file:/*", "/", path), "rb", buffering=1 << 20)
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_stream(inner, buffer_size=1 << 20)


def _skip(stream: BinaryIO, n: int) -> None:
    if stream.seekable() and not isinstance(getattr(stream, "raw", None), gzip.GzipFile):
        stream.seek(n, 1)
        return
    while n:
        n -= len(stream.read(min(n, 1 << 20))) or n


def parse(stream: BinaryIO, wanted=lambda head: True, payload: str = "text") -> Iterator[tuple]:
    """The rows of one archive. wanted(headers) decides before a block is read."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:  # a folded header
                head[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                head[last] = value.strip()
        length = int(head.get("content-length", 0))
        row = {k: head.get(v) for k, v in _HEADERS.items()}
        if not wanted(row):
            _skip(stream, length)
            continue
        body, declared = None, None
        if payload == "none":
            _skip(stream, length)
        else:
            body = stream.read(length)
        if body is not None and (head.get("content-type") or "").startswith("application/http"):
            http, _, body = body.partition(b"\r\n\r\n")
            found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
            declared = int(found[1]) if found else None
        digest = hashlib.sha256(body).hexdigest() if body is not None else None
        yield (*(row[k] for k in _HEADERS), declared, body.decode("utf-8", "replace") if payload == "text" else None, digest, len(body) if body is not None else None)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [f.rsplit("\t", 1) for f in options["files"].split("\n") if f]
        self.split = int(options.get("split", 32 << 20))
        self.payload = options.get("payload", "text")
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo):
                self.filters.append((column, (f.value,)))
            elif column in _HEADERS and isinstance(f, In):
                self.filters.append((column, tuple(f.value)))
            elif column in _HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.filters.append((column, None if isinstance(f, IsNull) else ...))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, largest first, each to a partition that still has room."""
        out: list[list] = []
        room: list[int] = []
        for path, size in sorted(self.files, key=lambda f: -int(f[1])):
            if room and room[-1] >= int(size):
                out[-1].append(path)
                room[-1] -= int(size)
            else:
                out.append([path])
                room.append(self.split - int(size))
        return [Files(p) for p in out] or [Files([])]

    def _wanted(self, head: dict) -> bool:
        for column, values in self.filters:
            value = head[column]
            if (value is not None) if values is None else (value is None) if values is ... else value not in values:
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with _open(path) as stream:
                yield from parse(stream, self._wanted, self.payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "text", split: int = 32 << 20) -> DataFrame:
    """The records of the archives below a folder; filters on header columns reach the parser."""
    if payload not in ("text", "digest", "none"):
        raise ValueError("payload is text, digest or none")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    files = []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not any(x.startswith(("_", ".")) for x in name[len(where.toString()) :].split("/")):
            files.append((name, f.getLen()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", "\n".join(f"{p}\t{n}" for p, n in files)).option("payload", payload).option("split", str(split)).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, of the full
    payload: a revisit's come from its headers, a response's from the payload read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "warc")
    write_warc(pages, path, compression="gzip")
    rows = read_warc(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    again = F.col("record_type") == "revisit"
    return rows.select(
        F.expr(f"try_cast(nullif({_sql_number('record_id')}, '') AS BIGINT)").alias("page_id"),
        F.when(again, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("declared_digest", ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.expr(f"try_cast(nullif({_sql_number('refers_to')}, '') AS BIGINT)").alias("refers_to"),
    )


def _sql_number(column: str) -> str:
    return f"regexp_extract({column}, '{NAME}(-?[0-9]+)>', 1)"
