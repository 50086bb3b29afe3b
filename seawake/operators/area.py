"""Filters by an area of interest: a ring of (lon, lat) corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import require_columns


def _segments(points: Column) -> Column:
    """Pairs of consecutive points."""
    return F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda p, q: F.struct(p["lon"].alias("px"), p["lat"].alias("py"), q["lon"].alias("qx"), q["lat"].alias("qy")))


def _covered(lon: Column, lat: Column, ring) -> Column:
    return geo.in_ring(lon, lat, ring) | geo.on_boundary(lon, lat, ring)


def _middles(s: Column, ring) -> Column:
    """The middles of the parts into which the ring cuts a segment."""
    cuts = geo.segment_cuts(s["px"], s["py"], s["qx"], s["qy"], ring)
    return F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct((s["px"] + (s["qx"] - s["px"]) * (a + b) / 2).alias("lon"), (s["py"] + (s["qy"] - s["py"]) * (a + b) / 2).alias("lat")))


def contained(points: Column, ring: list[tuple[float, float]]) -> Column:
    """The whole line lies in the area, and not on its boundary alone."""
    x0, y0, x1, y1 = geo.bounds(ring)
    box = F.forall(points, lambda p: p["lon"].between(x0, x1) & p["lat"].between(y0, y1))
    inside = F.exists(points, lambda p: geo.in_ring(p["lon"], p["lat"], ring)) | F.exists(_segments(points), lambda s: F.exists(_middles(s, ring), lambda m: geo.in_ring(m["lon"], m["lat"], ring)))
    within = F.forall(points, lambda p: _covered(p["lon"], p["lat"], ring))
    if not geo.convex(ring):
        within = within & F.forall(_segments(points), lambda s: F.forall(_middles(s, ring), lambda m: _covered(m["lon"], m["lat"], ring)))
    return box & within & inside


def intersecting(points: Column, ring: list[tuple[float, float]]) -> Column:
    """The line shares a point with the area, its boundary included."""
    x0, y0, x1, y1 = geo.bounds(ring)
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    near = (F.array_min(lons) <= x1) & (F.array_max(lons) >= x0) & (F.array_min(lats) <= y1) & (F.array_max(lats) >= y0)

    def meets(s: Column) -> Column:
        cuts = geo.segment_cuts(s["px"], s["py"], s["qx"], s["qy"], ring)
        return (F.size(cuts) > 2) | F.exists(_middles(s, ring), lambda m: _covered(m["lon"], m["lat"], ring))

    return near & (F.exists(points, lambda p: _covered(p["lon"], p["lat"], ring)) | F.exists(_segments(points), meets))


def filter_area(trajectories: DataFrame, ring: list[tuple[float, float]], only_inside: bool = True) -> DataFrame:
    """Rows whose line lies in the area, or (only_inside=False) meets it."""
    if "points" not in trajectories.columns:
        raise ValueError("trajectories need a points column")
    require_columns(trajectories, "points")
    points = F.col("points")
    return trajectories.where((F.size(points) > 0) & (contained(points, ring) if only_inside else intersecting(points, ring)))
