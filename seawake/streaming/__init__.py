"""Position reports as a stream.

The operators of this library are batch operators. What is here is an addition:
daily report counts per vessel over a folder of AIS files that grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AIS_SCHEMA


def read_reports(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Reports of new CSV files, under the names of the data model."""
    raw = spark.readStream.schema(AIS_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return raw.select(F.col("MMSI").alias("mmsi"), F.col("BaseDateTime").alias("ts"), F.col("LON").alias("lon"), F.col("LAT").alias("lat"), F.col("SOG").alias("sog"), F.col("COG").alias("cog"), F.col("Status").alias("status"))


def daily_counts(reports: DataFrame, late: str = "2 days") -> DataFrame:
    """mmsi, day, n; a day is closed when reports are `late` past it. State is one row per vessel and open day."""
    days = reports.withWatermark("ts", late).groupBy("mmsi", F.window("ts", "1 day").alias("w"))
    return days.agg(F.count("*").alias("n")).select("mmsi", F.col("w.start").cast("date").alias("day"), "n")
