"""Pairs by blocks give what the long table of differences gives, and write no pair on the way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seawake.functions import encode
from seawake.operators import features, pairs

POINTS = "points array<struct<lat:double,lon:double>>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tracks(spark, holes=False):
    lengths = (9, 6, 3, 12, 4, 7, 5)
    value = lambda t, k: None if holes and (t + k) % 4 == 0 else ((t * 7919 + k * 104729) % 1009) / 64
    return spark.createDataFrame([(t, [(value(t, k), value(t + 50, 2 * k)) for k in range(n)]) for t, n in enumerate(lengths)], f"traj_id long, {POINTS}")


def long_form(df, length):
    points = df.select("traj_id", F.posexplode("points").alias("pos", "p")).select("traj_id", "pos", "p.lat", "p.lon")
    return features.pair_differences(points, length)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("length", [1, 2, 4])
def test_window_sums(spark, length):
    df = tracks(spark)
    total = F.aggregate(F.transform("seq", lambda d: d["dlat"]), F.lit(0.0), lambda a, x: a + x)
    want = features.pair_windows(long_form(df, length), length).groupBy("i", "j").agg(F.count("*"), F.max("k"), F.sum(total), F.sum("target.dlon"))
    assert rows(pairs.window_sums(df, length)) == rows(want)


def test_window_sums_with_holes(spark):
    """Missing numbers are left out of the sums, as SQL does."""
    df, length = tracks(spark, holes=True), 2
    got = {(r.i, r.j): r for r in pairs.window_sums(df, length).collect()}
    data = {r.traj_id: r.points for r in df.collect()}
    long = sum(len(p) > length + 1 for p in data.values())
    assert len(got) == long * (long - 1)
    for (i, j), r in got.items():
        m = min(len(data[i]), len(data[j]))
        d = [(None if x.lat is None or y.lat is None else x.lat - y.lat, None if x.lon is None or y.lon is None else x.lon - y.lon) for x, y in zip(data[i][:m], data[j][:m])]
        seq = [d[k + u][0] for k in range(m - length - 1) for u in range(length) if d[k + u][0] is not None]
        target = [d[k + length][1] for k in range(m - length - 1) if d[k + length][1] is not None]
        assert (r.n, r.last_k) == (m - length - 1, m - length - 2)
        assert r.seq_dlat == (sum(seq) if seq else None) and r.target_dlon == (sum(target) if target else None)


def test_pair_windows_shuffles_no_pair(spark, small):
    plan = plan_of(entry.queries()["pair_windows"](spark, small))
    assert "CartesianProduct" in plan and "hashpartitioning(i" not in plan and "Window [collect_list" not in plan


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("length", [1, 4])
def test_difference_sums(spark, length, holes):
    df = tracks(spark, holes)
    want = long_form(df, length).groupBy("i", "j").agg(F.count("*"), F.sum("dlat"), F.sum("dlon"))
    assert rows(pairs.difference_sums(df, length)) == rows(want)


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("length", [1, 4])
def test_scaled_extremes(spark, length, holes):
    df = tracks(spark, holes)
    d = long_form(df, length)
    assert rows(pairs.fit_minmax(df, length)) == rows(features.fit_minmax(d))
    want = features.scale_minmax(d, features.fit_minmax(d)).groupBy("i", "j").agg(F.min("dlat"), F.max("dlon"))
    assert rows(features.scale_minmax(pairs.difference_extremes(df, length), pairs.fit_minmax(df, length))) == rows(want)


def test_extremes_of_equal_tracks(spark):
    df = spark.createDataFrame([(t, [(1.0, 2.0)] * 4) for t in (1, 2)], f"traj_id long, {POINTS}")
    assert rows(pairs.fit_minmax(df, 1)) == [(0.0, 1.0, 0.0, 1.0)]
    assert rows(pairs.fit_minmax(df.where("traj_id = 1"), 1)) == [(None, None, None, None)]


@pytest.mark.parametrize("name", ["pair_diffs", "minmax_scaled_diffs"])
def test_pairs_are_not_shuffled(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" in plan and "hashpartitioning(i" not in plan


@pytest.mark.parametrize("length", [1, 3])
def test_scaled_windows(spark, length):
    """Every window of the long form, and none is written."""
    df = tracks(spark)
    d = long_form(df, length)
    scale = features.fit_minmax(d).first().asDict()
    steps = [F.col("seq")[i] for i in range(length)] + [F.col("target")]
    want = features.pair_windows(features.scale_minmax(d, features.fit_minmax(d)), length).select(*(s[c] for s in steps for c in ("dlat", "dlon")))
    got = pairs.scaled_windows(df, length, scale)
    assert rows(got) == rows(want) and pairs.count_windows(df, length) == want.count() and "hashpartitioning(i" not in plan_of(got)


@pytest.mark.parametrize("digits", [0, 4, 6])
def test_rounded_is_round(spark, digits):
    """To the bit, next to halves too, and without decimals in the usual case."""
    rng = np.random.default_rng(1)
    halves = (rng.integers(-(10**7), 10**7, 3000) + 0.5) / 10.0**digits
    values = [*halves, *np.nextafter(halves, np.inf), *np.nextafter(halves, -np.inf), *rng.normal(0, 100, 3000), *rng.normal(0, 1e-6, 100), *rng.normal(0, 1e10, 500), *rng.normal(0, 1e17, 100)]
    values += [0.0, -0.0, -1e-9, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 5e-324, 0.5, 1.5, 2.5, -0.5, 1.0000005, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").select("x", encode.rounded(F.col("x"), digits).alias("got"), F.round("x", digits).alias("want"))
    assert df.count() == len(values) and df.where("NOT (hex(cast(got AS string)) <=> hex(cast(want AS string)))").collect() == []


@pytest.mark.parametrize("name", ["pair_diffs", "pair_windows", "minmax_scaled_diffs"])
def test_pair_queries_round_by_doubles(spark, small, name):
    assert "rint" in plan_of(entry.queries()[name](spark, small)).lower()


def test_running_sums_of_a_block_are_made_once(spark, monkeypatch):
    """However many turns a pair of blocks takes."""
    monkeypatch.setattr(pairs, "PAIRS_A_TURN", 4)
    monkeypatch.setattr(pairs, "map_blocks", lambda trajectories, length, f, *a, **b: f)
    t = pa.StructArray.from_arrays([pa.array(range(9)), *[pa.array([[float(i * k) for k in range(9)] for i in range(9)])] * 2], names=["id", "lat", "lon"])
    block, made = pairs.Block(t), []
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **b: made.append(1) or cumsum(*a, **b))
    turns = list(pairs.window_sums(None, 2)(block, block))
    assert len(turns) > 4 and sum(len(x[0]) for x in turns) == 72 and len(made) == 3


@pytest.mark.parametrize("length", [1, 3])
def test_counted_windows(spark, length):
    """Every window of every pair, equal ones counted."""
    df = tracks(spark).unionAll(tracks(spark).selectExpr("traj_id + 100", "points"))
    scale = features.fit_minmax(long_form(df, length)).first().asDict()
    every = pairs.scaled_windows(df, length, scale)
    want = every.select(*(F.col(c).cast("float").alias(c) for c in every.columns)).groupBy(*every.columns).agg(F.count("*"))
    got = rows(pairs.counted_windows(df, length, scale))
    assert got == rows(want) and sum(r[-1] for r in got) == pairs.count_windows(df, length) > len(got)


def test_blocks_by_place_are_few(spark):
    """Many shuffle partitions do not part the windows that could be counted together."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 400)
    try:
        found = pairs.map_blocks(tracks(spark), 1, lambda a, b: iter(()), "i long", by_place=True)
        assert found.rdd.getNumPartitions() <= 6 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
