"""Outlier removal: tracks are cut where they jump, and the parts joined to boats again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import point_seconds, require_columns, require_positive

PARTITION = {"sog": 5.0, "km": 50.0}
ASSOCIATION = {"sog": 15.0, "km": 50.0}
KM_PER_KNOT = 1.852


def partition_points(points: DataFrame, key: str = "mmsi", threshold_sog: float = PARTITION["sog"], threshold_km: float = PARTITION["km"], strict: bool = False, sog_unit: str = "as_is") -> DataFrame:
    """Adds subtrack (from 0): a new one begins where the speed between two reports differs from the reported one
    by more than threshold_sog, or their distance exceeds threshold_km.

    Reported speed is compared as it stands; sog_unit="knots" turns it to km/h first.
    """
    require_columns(points, key, "ts", "seq", "lat", "lon", "sog")
    require_positive(threshold_sog=threshold_sog, threshold_km=threshold_km)
    track = Window.partitionBy(key).orderBy("ts", "seq")
    before = {f"_{c}": F.lag(c).over(track) for c in ("ts", "lat", "lon")}
    df = points.withColumns(before).withColumn("_km", geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"), strict))
    seconds = point_seconds(F.col("ts"), F.col("_ts"))
    speed = geo.speed(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"), seconds, strict, F.col("_km"))
    sog = F.col("sog") * KM_PER_KNOT if sog_unit == "knots" else F.col("sog")
    cut = F.coalesce((F.abs(speed - sog) > threshold_sog) | (F.col("_km") > threshold_km), F.lit(False))
    return df.withColumn("subtrack", F.sum(cut.cast("int")).over(track.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_ts", "_lat", "_lon", "_km")


def _end(p: Column) -> Column:
    return F.struct(p["ts"].alias("ts"), p["lat"].alias("lat"), p["lon"].alias("lon"))


def _boats(subtracks: Column, threshold_sog: float, threshold_km: float, completeness: int, strict: bool) -> Column:
    """First-fit fold: each subtrack goes to the earliest boat whose tail accepts it, or begins a boat.

    That equals taking the first subtrack, absorbing what follows in order, and
    beginning again with the rest. The last boat, if it is one subtrack among
    several, is dropped.
    """

    def accepts(boat: Column, x: Column) -> Column:
        tail, head = boat["tail"], x["head"]
        km = geo.haversine(tail["lat"], tail["lon"], head["lat"], head["lon"], strict)
        fast = geo.speed(tail["lat"], tail["lon"], head["lat"], head["lon"], point_seconds(head["ts"], tail["ts"]), strict, km)
        return F.coalesce((fast < threshold_sog) & (km < threshold_km), F.lit(False))

    def boat(tail: Column, parts: Column, size: Column) -> Column:
        return F.struct(tail.alias("tail"), parts.alias("parts"), size.alias("size"))

    def step(boats: Column, x: Column) -> Column:
        fits = F.transform(boats, lambda b: accepts(b, x))
        at = F.array_position(fits, F.lit(True))
        grown = F.transform(boats, lambda b, i: F.when(i == at - 1, boat(x["tail"], F.concat(b["parts"], F.array(x["subtrack"])), b["size"] + x["n"])).otherwise(b))
        return F.when(at > 0, grown).otherwise(F.concat(boats, F.array(boat(x["tail"], F.array(x["subtrack"]), x["n"]))))

    start = F.array().cast("array<struct<tail:struct<ts:timestamp_ntz,lat:double,lon:double>,parts:array<int>,size:bigint>>")
    boats = F.aggregate(subtracks, start, step)
    last = F.size(boats)
    lone = (F.size(subtracks) > 1) & (F.size(F.element_at(boats, -1)["parts"]) == 1)
    kept = F.when(last == 0, boats).otherwise(F.slice(boats, F.lit(1), F.when(lone, last - 1).otherwise(last)))
    return F.filter(kept, lambda b: b["size"] >= completeness)


def associate(cut_points: DataFrame, key: str = "mmsi", threshold_sog: float = ASSOCIATION["sog"], threshold_km: float = ASSOCIATION["km"], threshold_completeness: int = 100, strict: bool = False) -> DataFrame:
    """(key, boat, subtrack) of the subtracks that belong to a complete boat."""
    require_columns(cut_points, key, "subtrack")
    require_positive(threshold_sog=threshold_sog, threshold_km=threshold_km, threshold_completeness=threshold_completeness)
    order = F.struct("ts", "seq")
    point = F.struct("ts", "lat", "lon")
    parts = cut_points.groupBy(key, "subtrack").agg(F.min_by(point, order).alias("head"), F.max_by(point, order).alias("tail"), F.count("*").alias("n"))
    lists = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("subtrack", "head", "tail", "n"))).alias("subtracks"))
    boats = lists.select(key, F.posexplode(_boats(F.col("subtracks"), threshold_sog, threshold_km, threshold_completeness, strict)).alias("boat", "b"))
    return boats.select(key, "boat", F.explode("b.parts").alias("subtrack"))


def remove_outliers(
    points: DataFrame,
    key: str = "mmsi",
    threshold_partition_sog: float = PARTITION["sog"],
    threshold_partition_distance: float = PARTITION["km"],
    threshold_association_sog: float = ASSOCIATION["sog"],
    threshold_association_distance: float = ASSOCIATION["km"],
    threshold_completeness: int = 100,
    strict: bool = False,
    n_processes: int | None = None,
) -> DataFrame:
    """The points of complete boats, with boat and subtrack. n_processes is checked and otherwise without effect: tasks are Spark's."""
    if n_processes is not None:
        require_positive(n_processes=n_processes)
    cut = partition_points(points, key, threshold_partition_sog, threshold_partition_distance, strict)
    boats = associate(cut, key, threshold_association_sog, threshold_association_distance, threshold_completeness, strict)
    return cut.join(boats, [key, "subtrack"])


def remove_outliers_rows(trajectories: DataFrame, *thresholds, additional_columns: tuple[str, ...] = (), **named) -> DataFrame:
    """Trajectory rows in, a row per boat out: points are the boat's, other columns are copied.

    additional_columns are further arrays, one value a point, that are cut alike.
    boat_start_time, boat_end_time and boat_point_count are those of the boat.
    """
    require_columns(trajectories, "points", *additional_columns)
    from ..scratch import new_path
    from .trajectory import explode_points

    # Rows are numbered once and written: numbers that a task makes anew might differ between the two sides of the join.
    path = new_path(trajectories.sparkSession, "rows")
    trajectories.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = trajectories.sparkSession.read.parquet(path)

    boats = remove_outliers(explode_points(rows, "_row"), "_row", *thresholds, **named)
    at = boats.groupBy("_row", "boat").agg(F.sort_array(F.collect_list("pos")).alias("_at"))
    met = rows.join(at, "_row")

    def of(column: str) -> Column:
        return F.transform("_at", lambda i: F.get(F.col(column), i))

    taken = {c: of(c) for c in ("points", *additional_columns)}
    out = met.withColumns(taken)
    return out.withColumns({"boat_start_time": F.array_min(F.transform("points", lambda p: p["ts"])), "boat_end_time": F.array_max(F.transform("points", lambda p: p["ts"])), "boat_point_count": F.size("points")}).drop("_row", "_at")
