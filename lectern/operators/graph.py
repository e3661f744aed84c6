"""Connected components of graphs that fit no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` of every end of an edge; the component is its smallest node.

    Alternating large-star and small-star steps: each is one aggregation and
    one join on edge lists, never a group in a task. A node of great degree is
    a hot join key on the side of the edges only (the other side has one row
    per node), which adaptive skew handling splits. The number of rounds grows
    with the logarithm of the diameter; every round is cut by a checkpoint.
    Repeated edges, loops and both directions are allowed; null ends are
    dropped (they link nothing); an empty table gives an empty table. More
    than ``rounds`` rounds is an error, never a partial result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    loops = e.select("u").union(e.select("v")).distinct()
    now = cut_lineage(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        last, before = before, _fingerprint(now)
        if last == before:
            return loops.join(now.withColumnsRenamed({"u": "node", "v": "component"}), loops["u"] == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge list; one row to the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
