"""The Parquet tables of one data folder, and their latest deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Hashes of re-delivered keys that are broadcast at most (8 bytes each).
REDELIVERED = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], stamp: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key: the delivery with the greatest ``stamp``.

    An aggregate with map-side combination instead of a window: re-delivered
    rows of a hot key are merged before the shuffle, and no task ever holds a
    group. Ties on ``stamp`` are settled by the whole row, so the result does
    not depend on the order of the input. Rows with a null key form a key of
    their own; a null stamp loses against any other. Columns of types without
    order (maps) can't be carried.
    """
    kept = [c for c in (columns or df.columns) if c not in keys and c != stamp]
    row = F.struct(F.col(stamp).alias("_stamp"), *[F.col(c) for c in kept])
    best = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    named = [F.col(f"_row.{c}").alias(c) for c in kept]
    if columns is None or stamp in columns:
        named.append(F.col("_row._stamp").alias(stamp))
    return best.select(*keys, *named)


def latest_texts(df: DataFrame, keys: list[str], stamp: str, columns: list[str] | None = None) -> DataFrame:
    """As :func:`latest`, for rows with long texts of which few are re-delivered.

    The hashes of the keys that stand in several rows are found first, from
    the key columns alone, and counted. If they are few enough to be broadcast
    (``REDELIVERED``), rows of other keys are handed on without a shuffle or a
    sort and only the rest, with any key of the same hash, is aggregated; else
    everything is.
    """
    key = F.xxhash64(*[F.col(k) for k in keys])
    again = cut_lineage(df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"))
    if again.count() > REDELIVERED:
        return latest(df, keys, stamp, columns)
    wanted = [c for c in (columns or df.columns) if c not in keys and (c != stamp or columns is None or stamp in columns)]
    hashed = df.withColumn("_key", key)
    sole = hashed.join(F.broadcast(again), "_key", "left_anti").select(*keys, *wanted)
    several = latest(hashed.join(F.broadcast(again), "_key", "left_semi").drop("_key"), keys, stamp, columns or df.columns)
    return sole.unionByName(several.select(*keys, *wanted))
