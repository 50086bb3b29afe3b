"""Written tables in the shared folder, which cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import new_path, scratch  # noqa: F401


def file_count(spark: SparkSession, rows: int, a_file: int = 50_000) -> int:
    """Files for a table of about so many small rows; at most one for each shuffle partition."""
    return max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // a_file))


def written(df: DataFrame, name: str, files: int | None = None, most: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there.

    files: deal it out to so many files. most: merge tasks, without a shuffle, until no more than so many are left.
    """
    spark = df.sparkSession
    if files:
        df = df.repartition(files)
    if most:
        df = df.coalesce(most)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch sent to Python, where the session leaves that open."""
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20), None),
    ):
        now = spark.conf.get(key, None)
        if now is None or now == default or (default is None and not now.isdigit()) or (now.isdigit() and int(now) > int(value)):
            spark.conf.set(key, value)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names like stems that df does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
        have.add(name.lower())
    return out
