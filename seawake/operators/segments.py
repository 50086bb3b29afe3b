"""Segmentation by navigational status: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns, require_positive


def segment_points(points: DataFrame, split_statuses: tuple[int, ...], default_status: int = 0, min_segment_length: int | None = None, key: str = "mmsi", line: bool = True) -> DataFrame:
    """Adds segment (from 0, in time order); points of a split status go.

    Segments shorter than min_segment_length go, but only from tracks that were
    split. line: a segment must have two points to be a line.
    """
    require_columns(points, key, "ts", "seq", "status")
    if not split_statuses:
        raise ValueError("split_statuses is empty")
    if min_segment_length is not None and min_segment_length < 1:
        raise ValueError("min_segment_length is 1 at least")
    least = max(min_segment_length or 1, 2 if line else 1)
    track = Window.partitionBy(key).orderBy("ts", "seq")
    status = F.coalesce(F.nanvl(F.col("status").cast("double"), F.lit(None).cast("double")).cast("int"), F.lit(default_status))
    df = points.withColumn("status", status).withColumn("_split", F.col("status").isin(*split_statuses))
    df = df.withColumn("_island", F.sum(F.col("_split").cast("int")).over(track.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_splits", F.sum(F.col("_split").cast("int")).over(Window.partitionBy(key)))
    kept = df.where(~F.col("_split")).withColumn("_n", F.count("*").over(Window.partitionBy(key, "_island")))
    kept = kept.where((F.col("_splits") == 0) | (F.col("_n") >= least))
    return kept.withColumn("segment", (F.dense_rank().over(Window.partitionBy(key).orderBy("_island")) - 1).cast("int")).drop("_split", "_island", "_splits", "_n")


def segment_by_status(trajectories: DataFrame, split_statuses: tuple[int, ...], default_status: int = 0, min_segment_length: int | None = None, point_count_column: str | None = "point_count", n_processes: int | None = None) -> DataFrame:
    """Trajectory rows in, a row per segment out; other columns are copied and the point count is made anew. No shuffle.

    A point count column by another name than point_count must be there. n_processes is checked and otherwise without effect.
    """
    require_columns(trajectories, "points", *([point_count_column] if point_count_column not in (None, "point_count") else []))
    if not split_statuses:
        raise ValueError("split_statuses is empty")
    if min_segment_length is not None and min_segment_length < 1:
        raise ValueError("min_segment_length is 1 at least")
    if n_processes is not None:
        require_positive(n_processes=n_processes)
    least = max(min_segment_length or 1, 2)
    filled = F.transform("points", lambda p: p.withField("status", F.coalesce(p["status"], F.lit(default_status))))
    none = F.array().cast("array<array<struct<ts:timestamp_ntz,seq:bigint,lon:double,lat:double,sog:double,cog:double,status:int>>>")

    def step(runs, p):
        ended = p["status"].isin(*split_statuses)
        last = F.element_at(runs, -1)
        return F.when(ended, F.concat(runs, F.array(F.array().cast(none_run)))).otherwise(F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.concat(last, F.array(p)))))

    none_run = "array<struct<ts:timestamp_ntz,seq:bigint,lon:double,lat:double,sog:double,cog:double,status:int>>"
    runs = F.aggregate("_points", F.concat(none, F.array(F.array().cast(none_run))), step)
    out = trajectories.withColumn("_points", filled).withColumn("_runs", runs)
    unsplit = F.size("_runs") == 1
    kept = F.filter("_runs", lambda r: (F.size(r) > 0) & (unsplit | (F.size(r) >= least)))
    out = out.select("*", F.posexplode(kept).alias("segment", "_run")).withColumn("points", F.col("_run")).drop("_points", "_runs", "_run")
    return out.withColumn(point_count_column, F.size("points")) if point_count_column else out
