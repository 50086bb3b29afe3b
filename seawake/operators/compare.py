"""Comparing trajectories: alignment of pairs, and evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.align import dtw, frechet
from ..schema import require_columns

REDUCTIONS = ("none", "mean", "sum")


def _latlon(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lat"], p["lon"]))


def _lonlat(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def _matrix(x) -> np.ndarray:
    return np.array([list(r) for r in x], float).reshape(-1, 2)


def dtw_column(a: Column, b: Column, cost: str = "haversine", radius: int | None = 1) -> Column:
    """DTW distance of two arrays of [lat, lon] as a vectorised UDF: a row's arrays cross to Python once, as Arrow."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([dtw(_matrix(p), _matrix(q), cost, radius)[0] if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(x, y, strict=True)], dtype=float)

    return distance(a, b)


def pair_trajectories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Trajectories of two tables by trajectory_id; missing partners or unequal mmsi are errors."""
    require_columns(left, "trajectory_id", "mmsi", "points")
    require_columns(right, "trajectory_id", "mmsi", "points")
    both = left.select("trajectory_id", F.col("mmsi"), F.col("points").alias("points_1")).join(right.select("trajectory_id", F.col("mmsi").alias("mmsi_2"), F.col("points").alias("points_2")), "trajectory_id", "full_outer")
    same = F.coalesce(F.col("mmsi") == F.col("mmsi_2"), F.lit(False))
    return both.withColumn("mmsi", F.when(same, F.col("mmsi")).otherwise(F.raise_error(F.lit("the tables hold different trajectories")).cast("long"))).drop("mmsi_2")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """trajectory_id, mmsi, original_points, resampled_points and path_length_ratio, the relative difference of the point counts."""
    n1, n2 = F.size("points_1"), F.size("points_2")
    return pairs.select("trajectory_id", "mmsi", n1.alias("original_points"), n2.alias("resampled_points"), F.try_divide(F.abs(n1 - n2), F.greatest(n1, n2)).cast("double").alias("path_length_ratio"))


def compare_trajectory_pairs(left: DataFrame, right: DataFrame, radius: int | None = 1, n_processes: int = 1) -> DataFrame:
    """mmsi, trajectory_id, dtw_distance, avg_point_distance, path_length_ratio, original_points, resampled_points."""
    if n_processes < 1:
        raise ValueError("n_processes is positive")
    pairs = pair_trajectories(left, right).withColumn("dtw_distance", dtw_column(_latlon(F.col("points_1")), _latlon(F.col("points_2")), radius=radius))
    n1, n2 = F.size("points_1"), F.size("points_2")
    return pairs.select("mmsi", "trajectory_id", "dtw_distance", (F.col("dtw_distance") / F.greatest(n1, n2)).alias("avg_point_distance"), F.try_divide(F.abs(n1 - n2), F.greatest(n1, n2)).cast("double").alias("path_length_ratio"), n1.alias("original_points"), n2.alias("resampled_points"))


def top_dissimilar(compared: DataFrame, n: int = 10) -> DataFrame:
    return compared.orderBy(F.desc("dtw_distance"), "trajectory_id").limit(n)


def haversine_list(a: Column, b: Column, strict: bool = False) -> Column:
    """Kilometres between the points of two equally long arrays, by place."""
    return F.zip_with(a, b, lambda p, q: geo.haversine(p["lat"], p["lon"], q["lat"], q["lon"], strict))


def reduced_haversine(df: DataFrame, true: str, predicted: str, trajectory_reduction: str | None = "mean", batch_reduction: str | None = "mean") -> DataFrame:
    """Kilometres per row and place, reduced along the trajectory, then over the rows.

    Anything but "mean" and "sum" leaves an axis as it is: with both axes left
    the result is a row per input row with an array, with the batch alone
    reduced a row per place (pos), with the trajectory alone a row per input row.
    """
    km = df.withColumn("km", haversine_list(F.col(true), F.col(predicted)))
    total = F.aggregate("km", F.lit(0.0), lambda a, x: a + x)
    along = {"sum": total, "mean": F.try_divide(total, F.size("km"))}.get(trajectory_reduction or "none")
    over = {"sum": F.sum, "mean": F.avg}.get(batch_reduction or "none")
    if along is not None:
        km = km.withColumn("km", along)
        return km if over is None else km.agg(over("km").alias("km"))
    if over is None:
        return km
    return km.select(F.posexplode("km").alias("pos", "km")).groupBy("pos").agg(over("km").alias("km"))


def _to_segments(p: Column, points: Column) -> Column:
    """Planar distance of a point to the nearest segment of a line."""
    n = F.size(points)

    def one(i: Column) -> Column:
        a, b = points[i], points[F.least(i + 1, n - 1)]
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        t = F.coalesce(F.try_divide((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        x, y = a["lon"] + t * dx - p["lon"], a["lat"] + t * dy - p["lat"]
        return F.sqrt(x * x + y * y)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), one))


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete Hausdorff distance of two lines, in degrees: vertices of either to segments of the other."""
    one = lambda x, y: F.array_max(F.transform(x, lambda p: _to_segments(p, y)))
    return F.greatest(one(a, b), one(b, a))


def frechet_column(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of two lines, in degrees."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([frechet(_matrix(p), _matrix(q)) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(x, y, strict=True)], dtype=float)

    return distance(_lonlat(a), _lonlat(b))


def trajectory_metric(df: DataFrame, distance: Callable[[Column, Column], Column], true: str, predicted: str, reduction: str = "none") -> DataFrame:
    """distance of two columns per row (value), or its mean or sum over rows."""
    if reduction not in REDUCTIONS:
        raise ValueError(f"reduction is one of {REDUCTIONS}")
    out = df.withColumn("value", distance(F.col(true), F.col(predicted)))
    return out if reduction == "none" else out.agg((F.avg if reduction == "mean" else F.sum)("value").alias("value"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """column, n, mean, std, min, q25, q50, q75, max, with exact quartiles."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), *(F.percentile(x, q).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max(x).alias("max")).select(F.lit(c).alias("column"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
