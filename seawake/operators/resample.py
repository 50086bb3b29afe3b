"""Resampling onto a fixed grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import arc_positions, interpolate_course, point_at
from ..schema import require_columns


def resample_points(points: DataFrame, interval_seconds: int = 300, key: str = "mmsi", full_grid: bool = False, compat: bool = False) -> DataFrame:
    """key, k, t (seconds since the first report), lon, lat, sog, cog, status at every grid time.

    The grid runs from the first report in steps of interval_seconds; its end is
    the last report's time, rounded to the grid (up if over half a step remains).
    Between two reports position and speed are linear, course goes the short way
    round, status is that of the report before. Grid times past the last report
    have no values and are left out (full_grid: kept, with nulls).
    compat: positions are taken along the track by arc length, between the places
    of the two reports on it; a place that the track visits again is its first
    (which costs the square of a track's points, and only then).

    Points and grid meet in one sort per track (an as-of join by window), so a
    long track needs memory for neither.
    """
    require_columns(points, key, "ts", "seq", "lon", "lat", "sog", "cog", "status")
    if interval_seconds < 1:
        raise ValueError("interval_seconds is 1 at least")
    whole = Window.partitionBy(key)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    pts = points.withColumn("t", F.floor((micros - F.min(micros).over(whole)) / 1e6))
    rest = F.col("last") % interval_seconds
    end = F.when(rest * 2 > interval_seconds, F.col("last") - rest + interval_seconds).otherwise(F.col("last") - rest)
    grid = pts.groupBy(key).agg(F.max("t").alias("last")).select(key, "last", F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(interval_seconds).cast("long"))).alias("t"))
    value = F.struct("t", "lon", "lat", "sog", "cog", "status")
    if compat:
        line = F.sort_array(F.collect_list(F.struct("t", "seq", F.struct("lon", "lat").alias("p"))))
        lines = pts.groupBy(key).agg(F.transform(line, lambda x: x["p"]).alias("_line"), F.transform(line, lambda x: x["seq"]).alias("_seqs"))
        lines = lines.withColumn("_arcs", arc_positions(F.col("_line")))
        arcs = lines.select(key, F.inline(F.arrays_zip(F.col("_seqs").alias("seq"), F.col("_arcs").alias("_arc"))))
        pts = pts.join(arcs, [key, "seq"])
        value = F.struct("t", "lon", "lat", "sog", "cog", "status", "_arc")
    both = (
        pts.select(key, "t", "seq", value.alias("p"), F.lit(None).cast("long").alias("last"))
        .unionByName(grid.select(key, "t", F.lit(None).cast("long").alias("seq"), F.lit(None).cast(pts.select(value.alias("p")).schema["p"].dataType).alias("p"), "last"))
    )
    # next: first report at or after the grid time; prev: the one before it, which is earlier.
    # Both look back, in opposite orders: a frame that only grows costs one step a row.
    after = Window.partitionBy(key).orderBy(F.col("t").desc(), F.col("seq").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(F.col("t"), F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("n", F.last("p", ignorenulls=True).over(after)).withColumn("b", F.last("p", ignorenulls=True).over(before)).where("p IS NULL")
    f = F.try_divide(F.col("t") - F.col("b.t"), F.col("n.t") - F.col("b.t"))
    start = F.col("t") == 0

    def lerp(c: str):
        return F.when(start, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}") + (F.col(f"n.{c}") - F.col(f"b.{c}")) * f)

    out = met.select(
        key, (F.col("t") / interval_seconds).cast("long").alias("k"), "t", lerp("lon").alias("lon"), lerp("lat").alias("lat"), lerp("sog").alias("sog"),
        F.when(start, F.col("n.cog")).otherwise(interpolate_course(F.col("b.cog"), F.col("n.cog"), f)).alias("cog"),
        F.when(start, F.col("n.status")).otherwise(F.col("b.status")).alias("status"), F.col("n").isNull().alias("_past"),
    )
    if compat:
        at = met.select(key, (F.col("t") / interval_seconds).cast("long").alias("_k"), F.when(start, F.col("n._arc")).otherwise(F.col("b._arc") + (F.col("n._arc") - F.col("b._arc")) * f).alias("_at"))
        places = at.where("_at IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("_k", "_at")).alias("_ats")).join(lines.select(key, "_line"), key)
        moved = places.select(key, F.inline(F.transform("_ats", lambda x: F.struct(x["_k"].alias("k"), point_at(F.col("_line"), x["_at"]).alias("_place")))))
        out = out.join(moved, [key, "k"], "left").withColumns({c: F.when(F.col("t") == 0, F.col(c)).otherwise(F.col(f"_place.{c}")) for c in ("lon", "lat")}).drop("_place")
    if full_grid:
        return out.drop("_past")
    return out.where("NOT _past").drop("_past")


def resample_trajectories(trajectories: DataFrame, interval_minutes: float = 5, key: str = "mmsi", compat: bool = False) -> DataFrame:
    """Trajectory rows in and out: points on the grid (ts from the first report on)."""
    from .trajectory import explode_points

    require_columns(trajectories, key, "points")
    grid = resample_points(explode_points(trajectories, key), round(interval_minutes * 60), key, compat=compat)
    lists = grid.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "lon", "lat", "sog", "cog", "status"))).alias("_grid"))
    first = F.col("points")[0]["ts"]
    made = F.transform("_grid", lambda g, i: F.struct(F.timestamp_micros(F.unix_micros(first.cast("timestamp")) + g["t"] * 1000000).cast("timestamp_ntz").alias("ts"), i.cast("long").alias("seq"), g["lon"].alias("lon"), g["lat"].alias("lat"), g["sog"].alias("sog"), g["cog"].alias("cog"), g["status"].alias("status")))
    return trajectories.withColumnRenamed("point_count", "original_points").join(lists, key).withColumn("points", made).withColumn("point_count", F.size("points")).drop("_grid")
