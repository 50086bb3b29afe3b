"""The data model: points, trajectories, and the checks every operator starts with.

A trajectory is a row with one ``points`` array of structs in time order, so
that its parts can never get out of step. Operators pass further columns
through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AIS_SCHEMA = T.StructType(
    [
        T.StructField("MMSI", T.LongType()),
        T.StructField("BaseDateTime", T.TimestampType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("SOG", T.DoubleType()),
        T.StructField("COG", T.DoubleType()),
        T.StructField("VesselType", T.IntegerType()),
        T.StructField("Status", T.IntegerType()),
    ]
)
POINT = "struct<ts:timestamp_ntz,seq:bigint,lon:double,lat:double,sog:double,cog:double,status:int>"
POINT_FIELDS = ("ts", "seq", "lon", "lat", "sog", "cog", "status")


class MissingColumn(KeyError):
    """A column that an operator needs is not there."""


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail when the plan is made, not when it runs."""
    have = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() not in have:
            raise MissingColumn(name)


def require_positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")


def points_of(rows: Iterable[tuple]) -> list[dict]:
    """Point dicts from (ts, lon, lat, sog, cog, status) tuples; for fixtures."""
    return [dict(ts=r[0], seq=i, lon=float(r[1]), lat=float(r[2]), sog=float(r[3]), cog=float(r[4]), status=r[5]) for i, r in enumerate(rows)]


def point_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)
