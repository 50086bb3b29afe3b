"""Feature sets for models: supervised splits, masking, pairwise differences, masked loss."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode
from ..schema import point_seconds, require_columns

MASK, PAD = -1.0, -999.0


def shuffled(df: DataFrame, key: str = "mmsi", seed: int = 0) -> DataFrame:
    """The rows in an order that depends on the seed and the key only, not on partitions. shuffle_key holds that order."""
    require_columns(df, key)
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).orderBy("shuffle_key")


def supervised_split(trajectories: DataFrame, n_pred: int, seq_len: int | None = None) -> DataFrame:
    """Adds X (the points before the last n_pred, or the last seq_len of those) and y (the last n_pred).

    Rows too short for both are an error no more: their X and y are null.
    """
    require_columns(trajectories, "points")
    if n_pred < 0 or (seq_len is not None and seq_len < 1):
        raise ValueError("n_pred is not negative and seq_len positive")
    n = F.size("points")
    length = F.lit(seq_len) if seq_len else n - n_pred
    enough = (n >= n_pred + (seq_len or 1)) & (n > 0)
    x = F.when(enough, F.slice("points", F.greatest(n - n_pred - length + 1, F.lit(1)), F.greatest(length, F.lit(0))))
    y = F.when(enough, F.slice("points", F.greatest(n - n_pred + 1, F.lit(1)), F.lit(n_pred)))
    return trajectories.withColumns({"X": x, "y": y})


def feature_vector(p: Column, start: Column, normalize: bool = True, speed: bool = True, orientation: bool = True, timestamps: bool = True, axis_order: str = "reference") -> Column:
    """lon, lat, speed, course (two columns if normalised), elapsed time of a point."""
    seconds = point_seconds(p["ts"], start)
    if not normalize:
        return F.array(p["lon"], p["lat"], *([p["sog"]] if speed else []), *([p["cog"]] if orientation else []), *([seconds] if timestamps else []))
    return F.array(
        *encode.scale_position(p["lon"], p["lat"], axis_order), *([encode.scale_speed(p["sog"])] if speed else []),
        *(encode.course_sin_cos(p["cog"]) if orientation else ()), *([encode.scale_elapsed(seconds)] if timestamps else []),
    )


def to_supervised(trajectories: DataFrame, n_pred: int, seq_len: int | None = None, **flags) -> DataFrame:
    """X and y as arrays of feature arrays; elapsed time counts from the first point of the whole trajectory."""
    start = F.col("points")[0]["ts"]
    split = supervised_split(trajectories, n_pred, seq_len)
    vectors = lambda c: F.transform(c, lambda p: feature_vector(p, start, **flags))
    return split.withColumns({"X": vectors("X"), "y": vectors("y")})


def last_points(points: Column, most: int) -> Column:
    n = F.size(points)
    return F.slice(points, F.greatest(F.lit(1), n - most + 1), F.lit(most))


def pad(sequence: Column, length: int, filler: Column) -> Column:
    """Cut or padded at the end to length."""
    head = F.slice(sequence, 1, length)
    return F.concat(head, F.array_repeat(filler, F.lit(length) - F.size(head)))


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def mask_count(n: Column, ratio: float, least: int = 1) -> Column:
    return F.least(n, F.greatest(F.lit(least), F.floor(n * ratio).cast("int")))


def random_mask(n: Column, key: Column, seed: int, ratio: float = 0.15, least: int = 1) -> Column:
    """Booleans: the places with the smallest hashes."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, F.lit(1), mask_count(n, ratio, least)), lambda r: r["i"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(chosen, i))


def consecutive_mask(n: Column, key: Column, seed: int, ratio: float = 0.8, least: int = 1) -> Column:
    run = mask_count(n, ratio, least)
    start = F.pmod(F.xxhash64(key, F.lit(seed), F.lit("start")), n - run + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i >= start) & (i < start + run))


def end_mask(n: Column, ratio: float = 0.5, least: int = 1) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i >= n - mask_count(n, ratio, least))


def masked_dataset(
    trajectories: DataFrame, max_seq_len: int, key: str = "mmsi", random_mask_ratio: float = 0.15, consecutive_mask_ratio: float = 0.8, end_mask_ratio: float = 0.5,
    mask_token: float = MASK, pad_token: float = PAD, min_masks: int = 1, prob_random: float = 0.2, prob_consecutive: float = 0.3, prob_end: float = 0.5, seed: int = 0, **flags,
) -> DataFrame:
    """key, masked, attention, target (float arrays padded to max_seq_len) and mask, the places that were masked.

    The strategy of a row and its places follow from hashes of the key, place
    and seed; another epoch is another seed.
    """
    probabilities = (prob_random, prob_consecutive, prob_end)
    if min(probabilities) < 0 or not math.isclose(sum(probabilities), 1.0):
        raise ValueError("the probabilities of the strategies are not negative and sum to 1")
    require_columns(trajectories, key, "points")
    df = to_supervised(trajectories.where(F.size("points") > 0), 0, None, **flags)
    df = df.select(key, last_points(F.col("X"), max_seq_len).alias("x")).withColumn("n", F.size("x"))
    n, u, k = F.col("n"), _uniform(F.col(key), F.lit(seed)), F.col(key)
    mask = F.when(u < prob_random, random_mask(n, k, seed, random_mask_ratio, min_masks)).when(u < prob_random + prob_consecutive, consecutive_mask(n, k, seed, consecutive_mask_ratio, min_masks)).otherwise(end_mask(n, end_mask_ratio, min_masks))
    df = df.withColumn("mask", mask)
    width = F.size(F.col("x")[0])
    filler = F.array_repeat(F.lit(pad_token), width)
    hidden = F.zip_with("x", "mask", lambda v, m: F.when(m, F.transform(v, lambda _: F.lit(mask_token))).otherwise(v))
    floats = "array<array<float>>"
    return df.select(
        key, pad(hidden, max_seq_len, filler).cast(floats).alias("masked"), F.transform(F.sequence(F.lit(0), F.lit(max_seq_len - 1)), lambda i: i < n).alias("attention"),
        pad(F.col("x"), max_seq_len, filler).cast(floats).alias("target"), pad(F.col("mask"), max_seq_len, F.lit(False)).alias("mask"),
    )


def masked_mse(df: DataFrame, predicted: str = "predicted", compat: bool = False, mask_token: float = MASK) -> DataFrame:
    """One row, loss: the mean squared error over all features of masked, attended places; null without any.

    compat: a place counts as masked if any feature of its input is mask_token.
    """
    hidden = F.transform("masked", lambda v: F.exists(v, lambda x: x == F.lit(mask_token).cast("float"))) if compat else F.col("mask")
    rows = df.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col("target").alias("t"), F.col("attention").alias("a"), hidden.alias("m"))).alias("z")).where("z.a AND z.m")
    return rows.select(F.explode(F.zip_with("z.p", "z.t", lambda p, t: F.pow(p.cast("double") - t, F.lit(2.0)))).alias("e")).agg(F.avg("e").alias("loss"))


def pair_differences(points: DataFrame, length: int, key: str = "traj_id") -> DataFrame:
    """i, j, pos, dlat, dlon for every ordered pair of trajectories of over length + 1 points, up to the shorter one's end.

    points: key, pos, lat, lon. An equi-join on pos: all pairs are what is asked for.
    """
    require_columns(points, key, "pos", "lat", "lon")
    if length < 1:
        raise ValueError("the sequence length is positive")
    long = points.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") > length + 1)
    a = long.select(F.col(key).alias("i"), "pos", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = long.select(F.col(key).alias("j"), "pos", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return a.join(b, "pos").where("i != j").select("i", "j", "pos", (F.col("a_lat") - F.col("b_lat")).alias("dlat"), (F.col("a_lon") - F.col("b_lon")).alias("dlon"))


def fit_minmax(differences: DataFrame) -> DataFrame:
    """One row: least and range (1 if there is none) of dlat and dlon."""
    span = lambda c: F.when(F.max(c) == F.min(c), F.lit(1.0)).otherwise(F.max(c) - F.min(c))
    return differences.agg(*(x for c in ("dlat", "dlon") for x in (F.min(c).alias(f"{c}_min"), span(c).alias(f"{c}_range"))))


def scale_minmax(differences: DataFrame, fitted: DataFrame) -> DataFrame:
    joined = differences.join(F.broadcast(fitted.limit(1)))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range") for c in ("dlat", "dlon")}).select(*differences.columns)


def pair_windows(differences: DataFrame, length: int) -> DataFrame:
    """i, j, k, seq (length differences from place k on), target (the next one), for k up to n - length - 2."""
    w = Window.partitionBy("i", "j").orderBy("pos")
    d = F.struct("dlat", "dlon")
    rows = differences.withColumn("seq", F.collect_list(d).over(w.rowsBetween(0, length - 1))).withColumn("target", F.lead(d, length).over(w)).withColumn("after", F.lead("pos", length + 1).over(w))
    return rows.where("after IS NOT NULL").select("i", "j", F.col("pos").alias("k"), "seq", "target")
