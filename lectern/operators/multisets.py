"""Bags of values: counts and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(df: DataFrame, keys: list[str], left: Column, right: Column, name: str) -> DataFrame:
    """``keys, name, surplus``: values that the array ``left`` of a row holds more often than its array ``right``, and how much more often.

    Both sides are exploded into signed counts and added up in one aggregation,
    so no join is made and equal values meet before the shuffle. Rows with the
    same keys are one bag. Null arrays are empty.
    """
    signed = lambda a, n: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.struct(x.alias("v"), F.lit(n).alias("n")))
    each = df.select(*keys, F.explode(F.concat(signed(left, 1), signed(right, -1))).alias("x"))
    return each.groupBy(*keys, F.col("x.v").alias(name)).agg(F.sum("x.n").alias("surplus")).filter("surplus > 0")
