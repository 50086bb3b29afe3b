"""Geodesy and planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def haversine(lat1, lon1, lat2, lon2, strict: bool = False) -> Column:
    """Great-circle kilometres. strict: a coordinate out of range is an error."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    km = 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
    if strict:
        ok = in_range(lat1, lon1) & in_range(lat2, lon2)
        km = F.when(ok, km).otherwise(F.raise_error(F.lit("latitude or longitude out of range")).cast("double"))
    return km


def speed(lat1, lon1, lat2, lon2, seconds, strict: bool = False, km: Column | None = None) -> Column:
    """km/h between two points; 0 for the same point or no time. strict: negative time is an error."""
    lat1, lon1, lat2, lon2, seconds = map(_col, (lat1, lon1, lat2, lon2, seconds))
    km = haversine(lat1, lon1, lat2, lon2, strict) if km is None else km
    still = ((lat1 == lat2) & (lon1 == lon2)) | (seconds == 0)
    moving = km / (seconds + F.lit(1e-10)) * 3600
    out = F.when(still, F.lit(0.0)).otherwise(moving)
    if strict:
        out = F.when(seconds < 0, F.raise_error(F.lit("time runs backwards")).cast("double")).otherwise(out)
    return out


def azimuth(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    turn = F.radians(lon2 - lon1)
    x = F.sin(turn) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def course_difference(a: Column, b: Column) -> Column:
    """Degrees between two courses, the short way."""
    return F.least(F.abs(a - b), 360 - F.abs(a - b))


def interpolate_course(a: Column, b: Column, f: Column) -> Column:
    """Course at fraction f from a to b, the short way; exactly opposite courses turn to the left."""
    a, b, f = map(_col, (a, b, f))
    full = F.lit(360.0)
    turn = F.pmod(F.pmod(b, full) - F.pmod(a, full) + 180, full) - 180
    return F.pmod(F.pmod(a, full) + turn * f, full)


def cross(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p: positive where p lies left of a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    if len(ring) < 3:
        raise ValueError("a ring has three corners at least")
    open_ring = ring[:-1] if ring[0] == ring[-1] else ring
    return [(*a, *b) for a, b in zip(open_ring, [*open_ring[1:], open_ring[0]], strict=True)]


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def on_boundary(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    return _any([(cross(F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by), x, y) == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)) for ax, ay, bx, by in _edges(ring)])


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Strictly inside, by the number of edges to the right (points on the boundary apart)."""
    hits = F.lit(0)
    for ax, ay, bx, by in _edges(ring):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)
            hits = hits + crosses.cast("int")
    return (hits % 2 == 1) & ~on_boundary(x, y, ring)


def segment_cuts(px: Column, py: Column, qx: Column, qy: Column, ring: list[tuple[float, float]]) -> Column:
    """Sorted fractions at which a segment meets the ring's edges, with 0 and 1."""
    cuts = [F.lit(0.0), F.lit(1.0)]
    for ax, ay, bx, by in _edges(ring):
        dx, dy, ex, ey = qx - px, qy - py, F.lit(bx - ax), F.lit(by - ay)
        det = dx * ey - dy * ex
        t = F.try_divide((F.lit(ax) - px) * ey - (F.lit(ay) - py) * ex, det)
        u = F.try_divide((F.lit(ax) - px) * dy - (F.lit(ay) - py) * dx, det)
        cuts.append(F.when((det != 0) & t.between(0.0, 1.0) & u.between(0.0, 1.0), t))
        for cx, cy in ((ax, ay), (bx, by)):  # a segment along an edge is cut at its corners
            size = dx * dx + dy * dy
            s = F.try_divide((F.lit(cx) - px) * dx + (F.lit(cy) - py) * dy, size)
            cuts.append(F.when((det == 0) & (cross(px, py, qx, qy, F.lit(cx), F.lit(cy)) == 0) & s.between(0.0, 1.0), s))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts))))


def convex(ring: list[tuple[float, float]]) -> bool:
    turns = []
    edges = _edges(ring)
    for (ax, ay, bx, by), (_, _, cx, cy) in zip(edges, [*edges[1:], edges[0]], strict=True):
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def bounds(ring: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    return min(x for x, _ in ring), min(y for _, y in ring), max(x for x, _ in ring), max(y for _, y in ring)


def _planar(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(q["lon"] - p["lon"], F.lit(2.0)) + F.pow(q["lat"] - p["lat"], F.lit(2.0)))


def point_at(line: Column, distance: Column) -> Column:
    """The point (lon, lat) of a line of points at a planar distance, in degrees, from its start; its ends beyond them."""

    def step(state: Column, q: Column) -> Column:
        length = _planar(state["at"], q)
        on = state["found"].isNull() & (state["left"] <= length) & (length > 0)
        f = state["left"] / length
        between = F.struct((state["at"]["lon"] + (q["lon"] - state["at"]["lon"]) * f).alias("lon"), (state["at"]["lat"] + (q["lat"] - state["at"]["lat"]) * f).alias("lat"))
        return F.struct(_place(q).alias("at"), (state["left"] - length).alias("left"), F.when(on, between).otherwise(state["found"]).alias("found"))

    first = _place(line[0])
    begun = F.struct(first.alias("at"), distance.cast("double").alias("left"), F.when(distance <= 0, first).alias("found"))
    return F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), begun, step, lambda s: F.coalesce(s["found"], s["at"]))


def _place(p: Column) -> Column:
    return F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat"))


def arc_positions(line: Column) -> Column:
    """Where each point of a line lies on it, in degrees from its start: at the first of the places nearest to it.

    So a point that the line passes through earlier has the earlier position.
    """

    def position(p: Column) -> Column:
        def step(state: Column, q: Column) -> Column:
            a = state["at"]
            dx, dy = q["lon"] - a["lon"], q["lat"] - a["lat"]
            length = F.sqrt(dx * dx + dy * dy)
            r = F.when(length > 0, ((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy) / (length * length)).otherwise(F.lit(0.0))
            across = F.abs((p["lon"] - a["lon"]) * dy - (p["lat"] - a["lat"]) * dx) / length
            away = F.when(r <= 0, _planar(a, p)).when(r >= 1, _planar(q, p)).otherwise(across)
            nearer = away < state["best"]
            here = state["length"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)) * length
            return F.struct(_place(q).alias("at"), (state["length"] + length).alias("length"), F.when(nearer, away).otherwise(state["best"]).alias("best"), F.when(nearer, here).otherwise(state["arc"]).alias("arc"))

        begun = F.struct(_place(line[0]).alias("at"), F.lit(0.0).alias("length"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("arc"))
        return F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), begun, step, lambda s: s["arc"])

    return F.transform(line, position)
