"""Operators on small fixtures with known results."""

import datetime
import math
import random
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException  # noqa: F401

from seawake import schema
from seawake.functions import align, encode, geo
from seawake.operators import area, compare, features, outliers, resample, search, segments, trajectory
from seawake.sources import ais

BASE = datetime.datetime(2024, 1, 1, 12)
POINTS = "points array<struct<ts:timestamp_ntz,seq:long,lon:double,lat:double,sog:double,cog:double,status:int>>"


def track(*points, minutes=60, sog=10.0, cog=0.0, status=None):
    """Points from (lon, lat), some with their minute."""
    out = []
    for i, p in enumerate(points):
        m = p[2] if len(p) > 2 else i * minutes
        out.append((BASE + datetime.timedelta(minutes=m), i, float(p[0]), float(p[1]), float(sog[i] if isinstance(sog, list) else sog), float(cog[i] if isinstance(cog, list) else cog), status[i] if isinstance(status, list) else status))
    return out


def table(spark, tracks, more="", values=()):
    return spark.createDataFrame([(i, t, *values) for i, t in enumerate(tracks)], f"mmsi long, {POINTS}{more}")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("args", "km", "tolerance"),
    [((0, 0, 0, 0), 0, 1e-9), ((0, 0, 0.9, 0), 100, 1), ((40.7128, -74.006, 51.5074, -0.1278), 5570, 50), ((0, 0, 0, 180), 20015, 50), ((90, 0, 0, 0), 10007.5, 50), ((0, 179, 0, -179), 222.4, 10)],
)
def test_haversine(spark, args, km, tolerance):
    assert abs(value(spark, geo.haversine(*args)) - km) <= tolerance
    assert abs(align.haversine_matrix(np.array([args[:2]]), np.array([args[2:]]))[0, 0] - km) <= tolerance


@pytest.mark.parametrize("args", [(91, 0, 0, 0), (0, 181, 0, 0)])
def test_haversine_out_of_range(spark, args):
    with pytest.raises(Exception, match="out of range"):
        value(spark, geo.haversine(*args, strict=True))


@pytest.mark.parametrize(("seconds", "speed"), [(3600, 10), (1800, 20), (900, 40)])
def test_speed(spark, seconds, speed):
    assert abs(value(spark, geo.speed(0, 0, 0.09, 0, seconds)) - speed) < 0.1


def test_speed_at_rest_and_backwards(spark):
    assert value(spark, geo.speed(1, 1, 1, 1, 10)) == 0 and value(spark, geo.speed(1, 1, 2, 2, 0)) == 0
    with pytest.raises(Exception, match="backwards"):
        value(spark, geo.speed(0, 0, 1, 1, -1, strict=True))


@pytest.mark.parametrize(("lat", "lon", "degrees"), [(1, 0, 0), (0, 1, 90), (-1, 0, 180), (0, -1, 270), (1, 1, 45), (-1, 1, 135), (-1, -1, 225), (1, -1, 315)])
def test_azimuth(spark, lat, lon, degrees):
    assert abs(value(spark, geo.azimuth(0, 0, lat, lon)) - degrees) <= 0.1


@pytest.mark.parametrize(("a", "b", "f", "course"), [(0, 90, 0.5, 45), (350, 10, 0.5, 0), (-90, 90, 0.5, 180), (0, 90, 0.25, 22.5), (0, 360, 0.5, 0)])
def test_interpolated_courses(spark, a, b, f, course):
    assert abs(value(spark, geo.interpolate_course(a, b, f)) - course) < 1e-9


AREA = [(-1, -1), (-1, 3), (3, 3), (3, -1)]
LINES = [[(0, 0), (4, 4)], [(2, 2), (3, 3), (4, 4)], [(4, 4), (5, 5)], [(-0.5, -0.5), (-0.5, 1), (0, 0), (1, 1), (2, 2)], [(1, 4), (2, 7), (3, 5)], [(-2, -2), (-1, -2), (0, -2)], [(0, 0), (1, 1), (2, 2)]]


def test_area_filter(spark):
    df = table(spark, [track(*x) for x in LINES])
    assert sorted(r.mmsi for r in area.filter_area(df, AREA).collect()) == [3, 6]
    assert sorted(r.mmsi for r in area.filter_area(df, AREA, only_inside=False).collect()) == [0, 1, 3, 6]


def test_area_that_is_not_convex(spark):
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    lines = [[(0.2, 3), (3.8, 3)], [(0.5, 0.5), (3.5, 0.5)], [(0, 0), (4, 0)], [(1, 0), (2, 0.5)], [(2, 3), (2, 2)], [(-1, 2), (5, 2)]]
    df = table(spark, [track(*x) for x in lines])
    assert sorted(r.mmsi for r in area.filter_area(df, notch).collect()) == [1, 3]
    assert sorted(r.mmsi for r in area.filter_area(df, notch, False).collect()) == [0, 1, 2, 3, 5]
    with pytest.raises(ValueError, match="points"):
        area.filter_area(spark.range(1), notch)


def cut(spark, points, **named):
    df = trajectory.explode_points(table(spark, [points]), "mmsi")
    return [r.subtrack for r in outliers.partition_points(df, **named).orderBy("seq").collect()]


def test_partition(spark):
    straight = [(0, 0), (0, 0.1), (0, 0.2), (0, 0.3)]
    assert cut(spark, track(*straight), threshold_sog=15, threshold_km=100) == [0, 0, 0, 0]
    assert len(set(cut(spark, track((0, 0), (0, 0.1), (0, 1.1), (0, 1.2)), threshold_sog=15, threshold_km=50))) > 1
    quick = [(0, 0, 0), (0, 0.1, 60), (0, 0.2, 61), (0, 0.3, 180)]
    assert len(set(cut(spark, track(*quick), threshold_sog=5, threshold_km=100))) > 1
    assert cut(spark, track((0, 0))) == [0]
    for bad in ({"threshold_sog": -5}, {"threshold_km": 0}):
        with pytest.raises(ValueError, match="positive"):
            cut(spark, track((0, 0)), **bad)


def boats(spark, parts, completeness, sog=15.0, km=50.0):
    """parts: lists of (lat, minute)."""
    rows = [(1, BASE + datetime.timedelta(minutes=m), s * 1000 + i, 0.0, float(lat), s) for s, part in enumerate(parts) for i, (lat, m) in enumerate(part)]
    df = spark.createDataFrame(rows, "mmsi long, ts timestamp_ntz, seq long, lon double, lat double, subtrack int")
    out = {}
    for r in outliers.associate(df, threshold_sog=sog, threshold_km=km, threshold_completeness=completeness).collect():
        out.setdefault(r.boat, []).append(r.subtrack)
    return sorted(sorted(b) for b in out.values())


def test_association(spark):
    chain = [[((s * 4 + i) * 0.02, (s * 4 + i) * 15) for i in range(4)] for s in range(3)]
    assert boats(spark, chain, 12) == [[0, 1, 2]]
    assert boats(spark, [[(0, 0), (0.1, 60)], [(1.0, 70), (1.1, 130)]], 2) == [[0]]  # the last one, alone, goes
    assert boats(spark, [[(0, 0), (0.1, 60)], [(2.0, 70), (2.1, 130)]], 2) == [[0]]
    assert boats(spark, [[(0, 0), (0.1, 60)]], 3) == []
    assert boats(spark, [[(0, 0), (0.1, 60)]], 2) == [[0]]


def greedy(parts, accepts):
    """Take the first part, absorb what fits in order, begin again with the rest; a last one that is alone goes."""
    left, out = list(range(len(parts))), []
    if len(left) == 1:
        return [[0]]
    while len(left) > 1:
        boat, rest = [left[0]], []
        for i in left[1:]:
            if accepts(boat[-1], i):
                boat.append(i)
            else:
                rest.append(i)
        out.append(boat)
        left = rest
    return out


def test_association_equals_the_greedy_loop(spark):
    rng = random.Random(1)
    for _ in range(6):
        parts = [[(rng.uniform(0, 1), s * 100 + i * 30) for i in range(2)] for s in range(9)]

        def accepts(a, b, parts=parts):
            (la, ta), (lb, tb) = parts[a][-1], parts[b][0]
            km = 6371 * math.radians(abs(lb - la))
            return km / ((tb - ta) * 60 + 1e-10) * 3600 < 15 and km < 50

        assert boats(spark, parts, 1) == sorted(greedy(parts, accepts))


def test_remove_outliers_rows(spark):
    far = track((0, 0), (0, 0.1), (0, 0.2), (0, 5.0), (0, 0.3, 240), sog=10.0)
    df = spark.createDataFrame([(7, far, ["a", "b", "c", "d", "e"], 1.5, True)], f"vessel long, {POINTS}, tags array<string>, weight double, flag boolean")
    out = outliers.remove_outliers_rows(df, threshold_completeness=3, threshold_association_sog=30.0, threshold_partition_sog=15.0, additional_columns=("tags",))
    rows = out.collect()
    assert len(rows) == 1 and rows[0].tags == ["a", "b", "c", "e"] and rows[0].boat_point_count == 4
    assert (rows[0].vessel, rows[0].weight, rows[0].flag) == (7, 1.5, True)
    with pytest.raises(KeyError):
        outliers.remove_outliers_rows(df, additional_columns=("nonexistent",))
    with pytest.raises(ValueError, match="positive"):
        outliers.remove_outliers(df, n_processes=0)


@pytest.mark.parametrize(
    ("statuses", "split", "least", "segments_"),
    [([1, 1, 1, 2, 1, 1], (2,), None, [[0, 1, 2], [4, 5]]), ([1, 1, 1], (2,), None, [[0, 1, 2]]), ([2, 2, 2], (2,), None, []), ([1, 1, 2, 1], (2,), 3, []), ([None, 1, 2], (2,), None, [[0, 1]]), ([1, 1, 2, 3, 1, 1], (2, 3), None, [[0, 1], [4, 5]]), ([1, 1, 1, 2, 1, 1], (2,), 3, [[0, 1, 2]])],
)
def test_segments(spark, statuses, split, least, segments_):
    df = table(spark, [track(*[(i, i) for i in range(len(statuses))], status=statuses)], ", point_count int, unchanged string", (9, "u"))
    rows = segments.segment_by_status(df, split, 1, least).orderBy("segment").collect()
    assert [[p.seq for p in r.points] for r in rows] == segments_
    assert all(r.point_count == len(r.points) and r.unchanged == "u" and all(p.status is not None for p in r.points) for r in rows)
    flat = segments.segment_points(trajectory.explode_points(df, "mmsi"), split, 1, least).orderBy("segment", "seq").collect()
    found = {}
    for r in flat:
        found.setdefault(r.segment, []).append(r.seq)
    assert [found[k] for k in sorted(found)] == segments_


def test_segments_need_statuses(spark):
    with pytest.raises(ValueError, match="empty"):
        segments.segment_by_status(table(spark, [track((0, 0))]), ())
    with pytest.raises(KeyError):
        segments.segment_by_status(spark.range(1), (1,))


def test_resampling(spark):
    df = table(spark, [track((0, 0, 0), (1, 1, 3), (2, 2, 6), sog=[10.0, 12.0, 14.0], cog=[0.0, 45.0, 90.0], status=1)], ", point_count int", (3,))
    rows = resample.resample_points(trajectory.explode_points(df, "mmsi"), 180).orderBy("t").collect()
    assert [r.t for r in rows] == [0, 180, 360] and rows[0].lon == 0 and rows[-1].lon == 2
    finer = resample.resample_points(trajectory.explode_points(df, "mmsi"), 60).orderBy("t").collect()
    assert [round(r.lon, 9) for r in finer] == [round(i / 3, 9) for i in range(7)] and [round(r.cog) for r in finer] == [0, 15, 30, 45, 60, 75, 90]
    whole = resample.resample_trajectories(df, 1).first()
    assert whole.point_count == 7 and whole.original_points == 3 and whole.points[1].ts == BASE + datetime.timedelta(minutes=1)
    late = table(spark, [track((0, 0, 0), (5, 5, 500 / 60))])
    grid = lambda **k: [r.t for r in resample.resample_points(trajectory.explode_points(late, "mmsi"), 300, **k).orderBy("t").collect()]
    assert grid() == [0, 300] and grid(full_grid=True) == [0, 300, 600]


def test_dtw():
    a, b = [(0, 0), (0, 1), (0, 2)], [(0.1, 0), (0.1, 1), (0.1, 2)]
    assert align.dtw(a, b)[0] > 0 and align.dtw(a, a)[0] == 0 and align.dtw([(0, 0)], [(1, 1)])[0] > 0
    assert abs(align.dtw(a, b)[0] - align.dtw(b, a)[0]) < 1e-6
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.normal(size=(rng.integers(1, 40), 2)), rng.normal(size=(rng.integers(1, 40), 2))
        c = align.euclidean_matrix(x, y)
        d = np.full((len(x) + 1, len(y) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(x)):
            for j in range(len(y)):
                d[i + 1, j + 1] = c[i, j] + min(d[i, j], d[i, j + 1], d[i + 1, j])
        exact, path = align.dtw(x, y, "euclidean", None)
        assert abs(exact - d[-1, -1]) < 1e-9 and abs(sum(c[i, j] for i, j in path) - exact) < 1e-9
        fast, path = align.dtw(x, y, "euclidean", 1)
        assert fast >= exact - 1e-9 and path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1)
        assert abs(align.dtw(x, y, "euclidean", 50)[0] - exact) < 1e-9


def test_comparison(spark):
    make = lambda ids, shift: spark.createDataFrame([(i, m, track((0, 0), (1, 1), (2, 2 + shift))) for i, m in ids], f"trajectory_id long, mmsi long, {POINTS}")
    rows = compare.compare_trajectory_pairs(make([(0, 1234), (1, 5678)], 0), make([(0, 1234), (1, 5678)], 0)).collect()
    assert rows[0].__fields__ == ["mmsi", "trajectory_id", "dtw_distance", "avg_point_distance", "path_length_ratio", "original_points", "resampled_points"]
    assert all(round(r.dtw_distance, 10) == 0 and r.original_points == 3 and r.path_length_ratio == 0 for r in rows)
    for other in ([(0, 1234)], [(0, 1234), (1, 1)]):
        with pytest.raises(Exception, match="different trajectories"):
            compare.compare_trajectory_pairs(make([(0, 1234), (1, 5678)], 0), make(other, 0)).collect()
    assert [r.trajectory_id for r in compare.top_dissimilar(compare.compare_trajectory_pairs(make([(0, 1), (1, 2)], 0), make([(0, 1), (1, 2)], 1)), 1).collect()] == [0]


@pytest.mark.parametrize("along", ["sum", "mean", "none", None])
@pytest.mark.parametrize("over", ["sum", "mean", "none"])
def test_haversine_reductions(spark, along, over):
    t = track((0, 0), (1, 0), (2, 1))
    df = spark.createDataFrame([(t, t), (t, track((0, 1), (1, 0), (2, 1)))], f"{POINTS.replace('points', 'a')}, {POINTS.replace('points', 'b')}")
    km = np.array([[0, 0, 0], [6371 * math.radians(1), 0, 0]])
    out = compare.reduced_haversine(df, "a", "b", along, over).collect()
    want = {"sum": km.sum(axis=1), "mean": km.mean(axis=1)}.get(along, km)
    want = {"sum": want.sum(axis=0), "mean": want.mean(axis=0)}.get(over, want)
    got = [r.km for r in sorted(out, key=lambda r: r.pos)] if "pos" in out[0] else [r.km for r in out]
    assert np.allclose(np.array(got).ravel(), np.array(want).ravel(), atol=1e-6)


def test_line_distances(spark):
    df = spark.createDataFrame([(track((0, 0), (1, 0), (2, 0)), track((0, 1), (2, 1)))], f"{POINTS.replace('points', 'a')}, {POINTS.replace('points', 'b')}")
    assert abs(df.select(compare.hausdorff(F.col("a"), F.col("b")).alias("v")).first().v - 1) < 1e-12
    assert abs(compare.trajectory_metric(df, compare.frechet_column, "a", "b", "mean").first().value - math.sqrt(2)) < 1e-12
    with pytest.raises(ValueError, match="reduction"):
        compare.trajectory_metric(df, compare.hausdorff, "a", "b", "median")


def sailing(n, sog=10.0):
    return track(*[(i, i) for i in range(n)], minutes=5, sog=sog, cog=45.0)


def test_supervised_features(spark):
    df = table(spark, [sailing(10), sailing(2)])
    rows = {r.mmsi: r for r in features.to_supervised(df, 3, 5).collect()}
    assert len(rows[0].X) == 5 and len(rows[0].y) == 3 and len(rows[0].X[0]) == 6 and rows[1].X is None
    assert abs(rows[0].y[-1][5] - math.log1p(2700) / math.log(86400)) < 1e-12
    raw = features.to_supervised(df, 3, None, normalize=False, orientation=False).where("mmsi = 0").first()
    assert len(raw.X) == 7 and raw.X[2] == [2.0, 2.0, 10.0, 600.0]
    right = features.to_supervised(df, 0, None, axis_order="lonlat").where("mmsi = 0").first()
    assert right.X[9][:2] == [9 / 180, 9 / 90]


@pytest.mark.parametrize(("probabilities", "n"), [((1.0, 0.0, 0.0), 7), ((0.0, 1.0, 0.0), 40), ((0.0, 0.0, 1.0), 25)])
def test_masks(spark, probabilities, n):
    df = table(spark, [sailing(50)])
    names = dict(zip(("prob_random", "prob_consecutive", "prob_end"), probabilities))
    r = features.masked_dataset(df, 100, **names).first()
    masked, attention, target = (np.array(x) for x in (r.masked, r.attention, r.target))
    assert masked.shape == target.shape == (100, 6) and attention.sum() == 50 and attention[:50].all()
    assert (target[50:] == -999).all() and (masked[50:] == -999).all()
    hidden = (masked == -1).all(axis=1)
    assert hidden.sum() == n == sum(r.mask)
    if probabilities[1]:
        assert np.diff(np.flatnonzero(hidden)).max() == 1
    if probabilities[2]:
        assert hidden[25:50].all()


def test_long_sequences_keep_their_end(spark):
    r = features.masked_dataset(table(spark, [sailing(150)]), 100).first()
    assert abs(r.target[0][0] - 50 / 90) < 1e-6 and all(r.attention)
    for bad in ({"prob_random": 0.5}, {"prob_random": -0.1, "prob_consecutive": 0.6}):
        with pytest.raises(ValueError, match="probabilities"):
            features.masked_dataset(table(spark, [sailing(5)]), 10, **bad)


def test_mask_strategies_are_drawn_in_proportion(spark):
    points = F.lit(0)
    df = spark.range(4000).withColumn("mmsi", F.col("id") + points)
    u = df.select(features._uniform(F.col("mmsi"), F.lit(0)).alias("u")).toPandas().u
    assert abs((u < 0.2).mean() - 0.2) < 0.03 and abs((u < 0.5).mean() - 0.5) < 0.03


def test_masked_loss(spark):
    df = features.masked_dataset(table(spark, [sailing(20)]), 30, prob_random=0.0, prob_consecutive=0.0, prob_end=1.0)
    r = df.first()
    want = np.mean((np.array(r.target)[10:20] + 1) ** 2)
    for compat in (False, True):
        assert abs(features.masked_mse(df.withColumn("predicted", F.col("masked")), compat=compat).first().loss - want) < 1e-6
    assert features.masked_mse(df.withColumn("predicted", F.col("masked")).withColumn("mask", F.transform("mask", lambda _: F.lit(False)))).first().loss is None


def test_pair_windows(spark):
    rows = [(t, i, 1.0, float(i * (t + 1))) for t, n in enumerate((6, 5, 2)) for i in range(n)]
    d = features.pair_differences(spark.createDataFrame(rows, "traj_id long, pos int, lat double, lon double"), 2)
    fitted = features.fit_minmax(d)
    windows = features.pair_windows(features.scale_minmax(d, fitted), 2).collect()
    assert sorted((r.i, r.j, r.k) for r in windows) == [(0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1)]
    assert all(0 <= x.dlon <= 1 and x.dlat == 0 for r in windows for x in [*r.seq, r.target])
    assert fitted.first().dlat_range == 1.0
    with pytest.raises(ValueError, match="positive"):
        features.pair_differences(d.withColumnsRenamed({"i": "traj_id", "dlat": "lat", "dlon": "lon"}), 0)


def db(spark, *tracks):
    rows = [(i, [dict(ts=None, seq=k, lon=float(p[1]), lat=float(p[0]), sog=float(p[2]), cog=float(p[3]), status=None) for k, p in enumerate(t)]) for i, t in enumerate(tracks)]
    return spark.createDataFrame(rows, f"traj_id long, {POINTS}")


def test_tssp(spark):
    history = db(spark, [(48 + i / 10, -125.1, 10, 180) for i in range(5)])
    target = db(spark, [(48 + i / 10, -125.0, 10, 180) for i in range(3)]).withColumnRenamed("traj_id", "target_id")
    two = search.TSSP(history).predict(target, 2).orderBy("step").collect()
    assert [(round(r.lat, 6), round(r.lon, 6)) for r in two] == [(48.3, -125.0), (48.4, -125.0)]
    assert search.TSSP(history).predict(target, 10).count() == 2


def test_tssp_weights_and_ties(spark):
    west = [(48.0, -125 - i / 10, 5, 270) for i in range(10)]
    north = [(48 + i / 10, -125.0, 20, 0) for i in range(10)]
    east = [(48.0, -125 + i / 10, 15, 90) for i in range(10)]
    history = db(spark, west, north, east, west)
    target = db(spark, [(48.0, -125 - i / 10, 15, 270) for i in range(5)]).withColumnRenamed("traj_id", "target_id")
    pick = lambda *w: search.nearest_trajectories(target, history, w).first().traj_id
    assert (pick(1, 0, 0), pick(0, 1, 0), pick(0, 0, 1)) == (0, 2, 0)
    still = db(spark, [(1, 1, 0, 0), (1, 2, 0, 0)])
    assert search.nearest_trajectories(still.withColumnRenamed("traj_id", "target_id"), still).count() == 0


def test_pssp(spark):
    rows = [(t, i, 48 + i * 0.1 + t, -125 + i * 0.1 - t, 10.0, 45.0) for t in range(2) for i in range(4)]
    history = spark.createDataFrame(rows, "traj_id long, pos int, lat double, lon double, sog double, cog double")
    target = spark.createDataFrame([(1, 48.05, -124.95, 10.0, 45.0)], "target_id long, lat double, lon double, sog double, cog double")
    model = search.PSSP(history)
    steps = model.predict(target, 3).orderBy("step").collect()
    assert 1 <= len(steps) <= 3 and all(r.traj_id == 0 for r in steps)
    assert model.predict(target, 0).count() == 0
    assert search.PSSP(history.where("pos = 0 AND traj_id = 0")).predict(target, 3).count() == 0
    with pytest.raises(ValueError, match="empty"):
        search.PSSP(history.limit(0))
    with pytest.raises(KeyError):
        model.predict(target.drop("cog"), 1)


def test_extrapolation(spark):
    rows = search.extrapolate(table(spark, [track((0, 0), (1, 2)), track((5, 5))]), 2).orderBy("step").collect()
    assert [(r.mmsi, r.step, r.lon, r.lat) for r in rows] == [(0, 1, 2.0, 4.0), (0, 2, 3.0, 6.0)]


def test_building(spark):
    rows = [(1, BASE + datetime.timedelta(hours=h), s, 1.0 * h, 2.0, 3.0, 4.0, None, v, BASE.date()) for h, s, v in [(2, 0, 70), (0, 1, 52), (0, 2, 30)]]
    rows += [(None, BASE, 9, 0.0, 0.0, 0.0, 0.0, 1, 70, BASE.date()), (2, BASE, 3, 0.0, 0.0, 0.0, 0.0, 1, None, BASE.date())]
    df = spark.createDataFrame(rows, "mmsi long, ts timestamp_ntz, seq long, lon double, lat double, sog double, cog double, status int, vessel_type int, day date")
    built = trajectory.build_trajectories(df, 2).collect()
    assert [(r.mmsi, [p.seq for p in r.points], r.point_count, r.category_desc) for r in built] == [(1, [1, 2, 0], 3, "Tug")]
    one = {r.mmsi: r.category_desc for r in trajectory.build_trajectories(df, 1, by_day=True).collect()}
    assert one == {1: "Tug", 2: "Unknown"}
    assert trajectory.build_trajectories(df, 2, compat=True).first().category_desc == "Other"
    assert trajectory.build_trajectories(df.limit(0)).count() == 0
    with pytest.raises(schema.MissingColumn):
        trajectory.build_trajectories(df.drop("sog"))


def test_validation(spark):
    df = table(spark, [track((0, 0)), track((0, 91))])
    assert [r.ok for r in trajectory.validate(df).orderBy("mmsi").collect()] == [True, False]
    with pytest.raises(Exception, match="out of range"):
        trajectory.validate(df, strict=True).collect()


def test_loading_daily_files(spark, tmp_path):
    head = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselType,Status\n"
    (tmp_path / "AIS_2024_01_01.csv").write_text(head + "2,2024-01-01T10:00:00,1,2,3,4,70,0\n1,2024-01-01T09:00:00,1,2,3,4,,\n1,2024-01-01T09:00:00,1,2,3,4,70,0,extra\n1,2024-01-01T11:00:00,1\n")
    (tmp_path / "AIS_2024_01_02.csv").write_text(head + "1,2024-01-02T09:00:00,1,2,3,4,52,5\n")
    df = ais.load_ais(spark, str(tmp_path), datetime.date(2024, 1, 1), datetime.date(2024, 1, 2))
    points = ais.standard_points(df).orderBy("mmsi", "ts").collect()
    assert [(r.mmsi, r.ts.day, r.ts.hour, r.lon) for r in points] == [(1, 1, 9, 2.0), (1, 1, 11, None), (1, 2, 9, 2.0), (2, 1, 10, 2.0)]
    assert ais.archive_url("http://x/", datetime.date(2024, 3, 9)) == "http://x/2024/AIS_2024_03_09.zip"
    assert len(ais.days(datetime.date(2024, 2, 28), datetime.date(2024, 3, 1))) == 3
    assert [r.day.day for r in encode.date_range(spark, "2024-02-28", "2024-03-01").collect()] == [28, 29, 1]


def test_loading_files_by_their_column_names(spark, tmp_path):
    one = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,VesselType,Status\n"
    two = "\ufeffStatus,VesselType,COG,SOG,LON,LAT,BaseDateTime,MMSI,Draft\n"
    (tmp_path / "AIS_2024_01_01.csv").write_text(one + '2,2024-01-01T10:00:00,1,2,3,4,511,"A, ""B""",70,0\n2,2024-01-01T11:00:00,1,2,3,4,511,X,70.0,0\n2,2024-01-01T12:00:00,1,2,3,4,511,X,70,0,\n2,2024-01-01T13:00:00,x\n')
    (tmp_path / "AIS_2024_01_02.csv").write_text(two + "5,52,40,30,20,10,2024-01-02T09:00:00,7,\n")
    df = ais.load_ais(spark, str(tmp_path), datetime.date(2024, 1, 1), datetime.date(2024, 1, 2))
    assert df.count() == 4 and df.columns[:8] == ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "VesselType", "Status"] and set(df.columns[8:]) == {"Heading", "VesselName", "Draft"}
    rows = df.orderBy("BaseDateTime").collect()
    assert [(r.MMSI, r.LAT, r.VesselType, r.Status, r.VesselName) for r in rows] == [(2, 1.0, 70, 0, 'A, "B"'), (2, 1.0, 70, 0, "X"), (2, None, None, None, None), (7, 10.0, 52, 5, None)]
    (tmp_path / "AIS_2024_01_03.csv").write_text("MMSI,LAT\n1,2\n")
    with pytest.raises(KeyError):
        ais.load_ais(spark, str(tmp_path), datetime.date(2024, 1, 3))
    (tmp_path / "AIS_2024_01_04.csv").write_text("")
    assert ais.load_ais(spark, str(tmp_path), datetime.date(2024, 1, 4)).count() == 0


def test_fetching_archives(tmp_path):
    served, kept = tmp_path / "served" / "2024", tmp_path / "kept"
    served.mkdir(parents=True)
    kept.mkdir()
    for day in (1, 2):
        with zipfile.ZipFile(served / f"AIS_2024_01_0{day}.zip", "w") as z:
            z.writestr(f"AIS_2024_01_0{day}.csv", f"day {day}")
    base = served.parent.as_uri()
    paths = ais.fetch_all(base, datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), str(kept))
    assert [Path(p).read_text() for p in paths] == ["day 1", "day 2"]
    Path(paths[0]).write_text("mine")
    assert Path(ais.fetch(base, datetime.date(2024, 1, 1), str(kept))).read_text() == "mine"
    assert Path(ais.fetch(base, datetime.date(2024, 1, 1), str(kept), override=True)).read_text() == "day 1"
    with pytest.raises(OSError):
        ais.fetch(base, datetime.date(2024, 1, 9), str(kept))


def test_places_along_a_line(spark):
    line = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0), (2.0, -2.0), (4.0, 0.0), (4.0, 0.0)]
    df = spark.createDataFrame([([dict(lon=x, lat=y) for x, y in line],)], "line array<struct<lon:double,lat:double>>")
    # The fifth point lies on the first stretch, the last two are the second point again.
    assert df.select(geo.arc_positions(F.col("line"))).first()[0] == pytest.approx([0, 4, 6, 8, 2, 12, 4, 4])
    for d, want in ((-1, (0, 0)), (0, (0, 0)), (3, (3, 0)), (5, (4, 1)), (7, (3, 2)), (99, (4, 0))):
        got = df.select(geo.point_at(F.col("line"), F.lit(d))).first()[0]
        assert (got.lon, got.lat) == pytest.approx(want)
    one = spark.createDataFrame([([dict(lon=1.0, lat=2.0)],)], "line array<struct<lon:double,lat:double>>")
    assert one.select(geo.arc_positions(F.col("line"))).first()[0] == [0.0] and tuple(one.select(geo.point_at(F.col("line"), F.lit(3))).first()[0]) == (1.0, 2.0)


def test_resampling_along_a_track_that_crosses_itself(spark):
    base = datetime.datetime(2024, 1, 1)
    line = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0), (2.0, -2.0)]
    rows = [(1, base + datetime.timedelta(seconds=10 * i), i, x, y, 1.0, 0.0, 0) for i, (x, y) in enumerate(line)]
    points = spark.createDataFrame(rows, "mmsi long, ts timestamp_ntz, seq long, lon double, lat double, sog double, cog double, status int")
    got = {r.t: (r.lon, r.lat) for r in resample.resample_points(points, 5, compat=True).collect()}
    # From (2, 2), 8 along, to (2, 0), which the track passed 2 along: halfway is 5 along. From there to (2, -2), 12 along: halfway is 7 along.
    want = {0: (0, 0), 5: (2, 0), 10: (4, 0), 15: (4, 1), 20: (4, 2), 25: (3, 2), 30: (2, 2), 35: (4, 1), 40: (2, 0), 45: (3, 2), 50: (2, -2)}
    assert {t: pytest.approx(p) for t, p in got.items()} == want
    plain = {r.t: (r.lon, r.lat) for r in resample.resample_points(points, 5).collect()}
    assert plain[35] == (2, 1) and plain[45] == (2, -1)


def test_resampling_takes_linear_time(spark):
    def seconds(n: int) -> float:
        at = spark.range(n).select(F.lit(1).alias("mmsi"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), (F.col("id") / n).alias("lon"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("sog"), F.lit(2.0).alias("cog"), F.lit(0).alias("status"))
        began = time.perf_counter()
        resample.resample_points(at, 60).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 2


def test_segment_arguments(spark):
    df = table(spark, [track((0, 0)), track((0, 91))])
    for bad in (0, -3):
        with pytest.raises(ValueError):
            segments.segment_by_status(df, (1,), min_segment_length=bad)
        with pytest.raises(ValueError):
            segments.segment_by_status(df, (1,), n_processes=bad)
    with pytest.raises(KeyError):
        segments.segment_by_status(df, (1,), point_count_column="no such column")


def test_dimensions(spark):
    groups = {r.category: r.description for r in ais.vessel_groups(spark).collect()}
    assert groups == {0: "Unknown", 2: "Fishing", 3: "Towing", 12: "Tug", 18: "Passenger", 19: "Cargo", 21: "Other"}
    assert ais.vessel_types(spark).count() == 281 and ais.status_codes(spark).count() == 16


def test_fixtures(spark, tmp_path):
    sample = ais.sample_trajectory(spark)
    assert len(sample.first().points) == 10
    ais.write_trajectories(sample, str(tmp_path / "t"))
    assert ais.read_trajectories(spark, str(tmp_path / "t")).collect() == sample.collect()
    tracks = ais.diverging_tracks(spark, 2, 5)
    assert tracks.count() == 50 and tracks.select("traj_id").distinct().count() == 10
    ais.write_csv(tracks, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 50
    box = trajectory.bounding_box(sample).first()
    assert (box.min_lon, round(box.max_lon, 6)) == (0.0, 0.9)


def test_description(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = compare.describe(df, "x").first()
    assert (r.n, r.mean, r["min"], r.q25, r.q50, r.q75, r["max"]) == (4, 2.5, 1, 1.75, 2.5, 3.25, 4)
