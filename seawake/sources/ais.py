"""Reading AIS files, dimension tables and test inputs; writing results."""

from __future__ import annotations

import csv
import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AIS_SCHEMA, MissingColumn, require_columns

# AIS ship type codes (first, last, category) and the categories' names.
TYPE_RANGES = (
    (0, 19, 0), (20, 29, 1), (30, 30, 2), (31, 32, 3), (33, 33, 4), (34, 34, 5), (35, 35, 6), (36, 36, 7), (37, 37, 8),
    (38, 39, 0), (40, 49, 9), (50, 50, 10), (51, 51, 11), (52, 52, 12), (53, 53, 18), (54, 54, 13), (55, 55, 14),
    (56, 57, 15), (58, 58, 16), (59, 59, 17), (60, 69, 18), (70, 79, 19), (80, 89, 20), (90, 99, 21), (100, 255, 0),
    (1001, 1002, 2), (1003, 1004, 19), (1005, 1005, 13), (1006, 1006, 21), (1007, 1007, 13), (1008, 1009, 21),
    (1010, 1011, 13), (1012, 1015, 18), (1016, 1016, 19), (1017, 1017, 20), (1018, 1018, 0), (1019, 1019, 8),
    (1020, 1022, 21), (1023, 1024, 20), (1025, 1025, 3),
)
CATEGORY_NAMES = {
    0: "Unknown", 1: "WIG", 2: "Fishing", 3: "Towing", 4: "Dredging", 5: "Diving", 6: "Military", 7: "Sailing", 8: "Pleasure",
    9: "High Speed", 10: "Pilot Vessel", 11: "Search and Rescue vessel", 12: "Tug", 13: "Industrial", 14: "Law Enforcement",
    15: "Spare", 16: "Medical Transport", 17: "Noncombatant", 18: "Passenger", 19: "Cargo", 20: "Tanker", 21: "Other",
}
# Navigational status codes.
STATUS_NAMES = {
    0: "Under way using engine", 1: "At anchor", 2: "Not under command", 3: "Restricted manoeuverability",
    4: "Constrained by her draught", 5: "Moored", 6: "Aground", 7: "Engaged in Fishing", 8: "Under way sailing",
    9: "Reserved for future amendment of Navigational Status for HSC", 10: "Reserved for future amendment of Navigational Status for WIG",
    11: "Reserved for future use", 12: "Reserved for future use", 13: "Reserved for future use", 14: "AIS-SART is active", 15: "Not defined (default)",
}
#: Categories that keep their own group; the others are one, "Other".
OWN_GROUPS, OTHER = (0, 2, 3, 12, 18, 19), 21


def archive_url(base: str, day: datetime.date) -> str:
    return f"{base.rstrip('/')}/{day.year:04d}/AIS_{day.year:04d}_{day.month:02d}_{day.day:02d}.zip"


def archive_filename(day: datetime.date) -> str:
    return f"AIS_{day.year:04d}_{day.month:02d}_{day.day:02d}.csv"


def days(start: datetime.date, end: datetime.date | None = None) -> list[datetime.date]:
    """Both ends included."""
    end = end or start
    return [start + datetime.timedelta(i) for i in range((end - start).days + 1)]


def fetch(base: str, day: datetime.date, folder: str, override: bool = False) -> str:
    """Download and unpack a day's archive unless its file is there. Errors of the server are raised."""
    target = Path(folder, archive_filename(day))
    if override or not target.exists():
        import io
        import urllib.request
        import zipfile

        with urllib.request.urlopen(archive_url(base, day)) as answer:
            zipfile.ZipFile(io.BytesIO(answer.read())).extractall(folder)
    return str(target)


def fetch_all(base: str, start: datetime.date, end: datetime.date, folder: str, override: bool = False) -> list[str]:
    return [fetch(base, day, folder, override) for day in days(start, end)]


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a file, from its first line; only that line is read."""
    first = spark.read.text(path).first()
    return tuple(next(csv.reader([first.value.lstrip("\ufeff")]))) if first else ()


def load_ais(spark: SparkSession, folder: str, start: datetime.date, end: datetime.date | None = None) -> DataFrame:
    """The daily CSV files of a date range as one table.

    Columns are found by the names in each file's first line, whatever their
    number and order: those of AIS_SCHEMA with their types, then all others as
    strings (null where a file lacks them). Lines with more fields than the first
    line go, short lines get nulls, values that do not fit their type are null.
    Files with the same first line are one scan. Rows are not sorted: order is made
    where it matters, inside a trajectory.
    """
    files: dict[tuple[str, ...], list[str]] = {}
    for day in days(start, end):
        path = f"{folder.rstrip('/')}/{archive_filename(day)}"
        files.setdefault(_header(spark, path), []).append(path)
    out = None
    for header, paths in files.items():
        if not header:
            continue
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*(f"c{i}" for i in range(len(header))), "line")])
        raw = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="line", columnPruning=False, quote='"', escape='"').csv(paths)
        # A line with too few or too many fields is kept as it stands; its commas outside quotes tell which. A first field is
        # asked for as well, since no query may read such lines alone.
        fields = F.size(F.split(F.regexp_replace("line", '"([^"]|"")*"', ""), ",", -1))
        raw = raw.where(F.col("line").isNull() | ((fields <= len(header)) & (F.length(F.coalesce("c0", F.lit(""))) >= 0)))
        of = {name.strip().lower(): f"c{i}" for i, name in reversed(list(enumerate(header)))}
        for field in AIS_SCHEMA.fields:
            if field.name.lower() not in of:
                raise MissingColumn(field.name)
        known = []
        for field in AIS_SCHEMA.fields:
            column = F.col(of.pop(field.name.lower()))
            if isinstance(field.dataType, (T.IntegerType, T.LongType)):
                column = F.coalesce(column.try_cast(field.dataType), column.try_cast("double").try_cast(field.dataType))  # 70.0 is 70
            known.append(column.try_cast(field.dataType).alias(field.name))
        others = [F.col(of[n]).alias(name) for n, name in ((x.strip().lower(), x.strip()) for x in header) if n in of and header[int(of[n][1:])].strip() == name]
        part = raw.select(*known, *others)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], AIS_SCHEMA) if out is None else out


def standard_points(df: DataFrame) -> DataFrame:
    """AIS columns under the names of the data model, with the day of each report.

    seq, which settles ties in time, is a hash of the report, so that it stays the same when a task runs again.
    """
    require_columns(df, *AIS_SCHEMA.fieldNames())
    ts = F.col("BaseDateTime").cast("timestamp_ntz")
    return df.select(
        F.col("MMSI").alias("mmsi"), ts.alias("ts"), F.xxhash64(*AIS_SCHEMA.fieldNames()).alias("seq"), F.col("LON").alias("lon"), F.col("LAT").alias("lat"),
        F.col("SOG").alias("sog"), F.col("COG").alias("cog"), F.col("Status").alias("status"), F.col("VesselType").alias("vessel_type"), ts.cast("date").alias("day"),
    )


def vessel_types(spark: SparkSession, path: str | None = None) -> DataFrame:
    """num, category, category_desc of every ship type: from a CSV file with these columns, or the built-in table."""
    if path:
        return spark.read.option("header", True).option("inferSchema", True).csv(path).select(F.col("num").cast("int").alias("num"), F.col("category").cast("int").alias("category"), "category_desc")
    rows = [(n, c, CATEGORY_NAMES[c]) for lo, hi, c in TYPE_RANGES for n in range(lo, hi + 1)]
    return spark.createDataFrame(rows, "num int, category int, category_desc string")


def vessel_groups(spark: SparkSession, path: str | None = None) -> DataFrame:
    """category, description: the groups that trajectories are labelled with."""
    types = vessel_types(spark, path)
    folded = types.withColumn("category", group_of(F.col("category")))
    # A group is named after the first type of that very category.
    names = types.groupBy("category").agg(F.min_by("category_desc", "num").alias("description"))
    return folded.select("category").distinct().join(names, "category")


def group_of(category: Column) -> Column:
    return F.when(category.isin(*OWN_GROUPS), category).otherwise(F.lit(OTHER))


def status_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """code, description of navigational statuses."""
    if path:
        return spark.read.option("header", True).csv(path).select(F.col("code").cast("int").alias("code"), "description")
    return spark.createDataFrame(list(STATUS_NAMES.items()), "code int, description string")


def with_vessel_group(df: DataFrame, column: str = "vessel_type", compat: bool = False) -> DataFrame:
    """Adds category and category_desc to raw ship types. compat: a code is compared with category numbers as it is."""
    code = F.coalesce(F.col(column).cast("int"), F.lit(OTHER if compat else -1))
    if compat:
        category = F.when(code.isin(*OWN_GROUPS, OTHER), code).otherwise(F.lit(OTHER))
    else:
        category = F.lit(OTHER)
        for lo, hi, c in reversed(TYPE_RANGES):
            category = F.when(code.between(lo, hi), F.lit(c if c in OWN_GROUPS else OTHER)).otherwise(category)
        category = F.when(F.col(column).isNull(), F.lit(0)).otherwise(category)
    named = F.element_at(F.create_map(*(F.lit(x) for c in (*OWN_GROUPS, OTHER) for x in (c, CATEGORY_NAMES[c]))), category)
    return df.withColumn("category", category).withColumn("category_desc", named)


def read_events_as_ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test table `events` as position reports: tracks that drift north-east, with jumps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    far = F.when(F.col("event_id") % 7 == 0, F.lit(1.5)).otherwise(F.lit(0.0))
    status = F.create_map(*(F.lit(x) for pair in (("click", 0), ("purchase", 1), ("signup", 5), ("view", 7)) for x in pair))
    return e.withColumn("rn", rn).select(
        F.col("user_id").alias("mmsi"), "ts", F.col("event_id").alias("seq"),
        (F.lit(-120.0) + (F.col("user_id") % 50) + F.lit(0.01) * F.col("rn")).alias("lon"),
        (F.lit(30.0) + (F.col("user_id") % 40) + F.lit(0.01) * F.col("rn") + far).alias("lat"),
        (F.col("value") % F.lit(6.0)).alias("sog"), ((F.col("event_id") * 37) % 360).cast("double").alias("cog"),
        F.try_element_at(status, F.col("event_type")).alias("status"), (F.col("user_id") % 100).cast("int").alias("vessel_type"), F.col("ts").cast("date").alias("day"),
    )


def write_trajectories(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sample_trajectory(spark: SparkSession) -> DataFrame:
    """A fixture of ten points at irregular minutes."""
    minutes = [0, 3, 7, 12, 20, 24, 31, 40, 44, 55]
    base = datetime.datetime(2024, 1, 1)
    points = [(base + datetime.timedelta(minutes=m), i, i * 0.1, (i % 3) * 0.1, 10.0 + i % 4, (i * 35.0) % 360, i % 2) for i, m in enumerate(minutes)]
    return spark.createDataFrame([(1, points)], "mmsi long, points array<struct<ts:timestamp_ntz,seq:long,lon:double,lat:double,sog:double,cog:double,status:int>>")


def diverging_tracks(spark: SparkSession, tracks: int = 10, points: int = 20, angles: tuple[float, ...] = (0, 22.5, 45, 67.5, 90), noise: float = 0.001, seed: int = 7) -> DataFrame:
    """Noisy straight tracks from one place at several angles: traj_id, pos, lat, lon, sog, cog."""
    n = tracks * len(angles)
    at = F.array(*map(F.lit, map(float, angles)))
    rows = spark.range(n * points).select((F.col("id") / points).cast("long").alias("traj_id"), (F.col("id") % points).cast("int").alias("pos"), "id")
    rows = rows.withColumn("angle", at[(F.col("traj_id") / tracks).cast("int")])
    # Noise from a hash of the point, so that it does not depend on partitioning.
    jitter = lambda s: (F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(2001)) / 1000.0 - 1) * noise
    return rows.select("traj_id", "pos", (48 + F.col("pos") * 0.05 * F.cos(F.radians("angle")) + jitter(0)).alias("lat"), (-125 + F.col("pos") * 0.05 * F.sin(F.radians("angle")) + jitter(1)).alias("lon"), F.lit(12.0).alias("sog"), F.col("angle").alias("cog"))
