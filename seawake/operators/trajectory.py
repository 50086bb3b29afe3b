"""Building, validating and unpacking trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_range
from ..schema import POINT_FIELDS, require_columns
from ..sources.ais import with_vessel_group


def build_trajectories(points: DataFrame, min_points: int = 2, by_day: bool = False, compat: bool = False) -> DataFrame:
    """One row per vessel (and day) with at least min_points reports; null keys and rows with a null result go.

    points: mmsi, ts, seq, lon, lat, sog, cog, status, vessel_type (and day).
    One shuffle on the key; lists are gathered per group and sorted within.
    """
    require_columns(points, "mmsi", "vessel_type", *POINT_FIELDS, *(["day"] if by_day else []))
    if min_points < 1:
        raise ValueError("min_points is 1 at least")
    keys = ["mmsi", "day"] if by_day else ["mmsi"]
    first = F.struct("ts", "seq")
    # The vessel type is an attribute of the first report, null included.
    lists = points.where(F.col("mmsi").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*POINT_FIELDS))).alias("points"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").cast("int").alias("point_count"),
        F.min_by(F.struct("vessel_type"), first)["vessel_type"].alias("vessel_type"),
    )
    kept = lists.where(F.col("point_count") >= min_points)
    named = with_vessel_group(kept, "vessel_type", compat)
    return named.na.drop("any", subset=[*keys, "points", "start_time", "end_time", "category_desc"])


def explode_points(trajectories: DataFrame, *columns: str) -> DataFrame:
    """columns, pos (from 0) and the fields of every point."""
    require_columns(trajectories, "points", *columns)
    return trajectories.select(*columns, F.posexplode("points").alias("pos", "point")).select(*columns, "pos", *(F.col(f"point.{f}").alias(f) for f in POINT_FIELDS))


def next_points(points: DataFrame, key: str = "mmsi") -> DataFrame:
    """Adds pos and, as next_*, the successor of every point; null at the end."""
    track = Window.partitionBy(key).orderBy("ts", "seq")
    return points.withColumn("pos", F.row_number().over(track) - 1).withColumns({f"next_{c}": F.lead(c).over(track) for c in ("seq", "lat", "lon", "sog", "cog")})


def bounding_box(trajectories: DataFrame) -> DataFrame:
    """min_lon, min_lat, max_lon, max_lat of every row, from the arrays, without exploding them."""
    require_columns(trajectories, "points")
    part = lambda f: F.transform("points", lambda p: p[f])
    return trajectories.withColumns({f"{g.__name__[6:]}_{f}": g(part(f)) for f in ("lon", "lat") for g in (F.array_min, F.array_max)})


def validate(trajectories: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ok: whether all points lie within -90..90 and -180..180. strict: a row that does not is an error."""
    require_columns(trajectories, "points")
    ok = F.forall("points", lambda p: F.coalesce(in_range(p["lat"], p["lon"]), F.lit(False)))
    if strict:
        return trajectories.where(F.coalesce(F.assert_true(ok, F.lit("a point is out of range")).isNull(), F.lit(True))).withColumn("ok", F.lit(True))
    return trajectories.withColumn("ok", ok)


def elapsed_seconds(points: Column) -> Column:
    """Whole seconds since the first point, of every point."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.transform(points, lambda p: F.floor((micros(p["ts"]) - micros(points[0]["ts"])) / 1e6))
