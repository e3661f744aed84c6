"""Parent links to full hierarchies: paths, depths, roots, descendants, cycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import broadcast_if_small, cut_lineage

#: One node in so many is a splitter.
SPLITTER_EVERY = 8

#: Numbers of nodes on and above cycles that are broadcast at most (8 bytes each); more are joined by shuffle.
LOOSE_NODES = 1_000_000


@dataclass(frozen=True)
class Hierarchy:
    """Resolved trees of all groups.

    ``base``: every node with a number ``u``, its group, id and title;
    ``ended``: ``u, top, via`` of every node below a root (numbers of the root
    and of all ancestors, nearest first); ``loose``: ``u`` of every node whose
    chain never ends; ``cycles``: these nodes with ``cycle_id`` (the smallest id on the cycle reached) and
    ``on_cycle``. Ids and titles are joined to numbers only where they are
    asked for.
    """

    base: DataFrame
    ended: DataFrame
    loose: DataFrame
    cycles: DataFrame
    group: str
    node: str

    def _pairs(self) -> DataFrame:
        return self.ended.select("u", F.posexplode("via").alias("at", "above"))

    def _named(self, *more: DataFrame) -> DataFrame:
        """``u, g, id, t, root_id`` of every node whose chain ends, with what ``more`` (by ``u``) tells of it."""
        ids = self.base.select(F.col("u").alias("top"), F.col("id").alias("root_id"))
        own = self.base.join(self.loose, "u", "left_anti").join(self.ended.select("u", "top").join(ids, "top").select("u", "root_id"), "u", "left")
        for m in more:
            own = own.join(m, "u", "left")
        return own.withColumn("root_id", F.coalesce("root_id", "id"))

    def _titled(self, *about: str) -> DataFrame:
        """``u, ups``: the ancestors of every node below a root, nearest first, with ``about`` of each."""
        above = self.base.select(F.col("u").alias("above"), *about)
        return self._pairs().join(above, "above").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("at", *about))).alias("ups"))

    @property
    def nodes(self) -> DataFrame:
        """``group, node, path, ancestors, depth, root_id`` of every node whose chain ends: titles from the root, ids of ancestors nearest first, 0 for a root's depth."""
        whole = self._named(self._titled("id", "t").withColumnRenamed("ups", "_ups"))
        none = F.array().cast("array<string>")
        path = F.concat(F.reverse(F.coalesce(F.col("_ups.t"), none)), F.array("t"))
        return whole.select(F.col("g").alias(self.group), F.col("id").alias(self.node), path.alias("path"), F.coalesce(F.col("_ups.id"), none).alias("ancestors"), F.coalesce(F.size("_ups"), F.lit(0)).alias("depth"), "root_id")

    def depths(self) -> DataFrame:
        """``group, node, depth, root_id`` of every node whose chain ends, without titles or ancestors."""
        depth = self.ended.select("u", F.size("via").alias("depth"))
        return self._named(depth).select(F.col("g").alias(self.group), F.col("id").alias(self.node), F.coalesce("depth", F.lit(0)).alias("depth"), "root_id")

    def descendants(self) -> DataFrame:
        """``group, node, descendant_id, distance``: a row for every node and each node below it."""
        below = self.base.select("u", "g", F.col("id").alias("descendant_id"))
        about = self.base.select(F.col("u").alias("above"), F.col("id").alias(self.node))
        return self._pairs().join(about, "above").join(below, "u").select(F.col("g").alias(self.group), self.node, "descendant_id", (F.col("at") + 1).alias("distance"))

    def paths(self) -> DataFrame:
        """``group, node, path, depth, root_id, n_descendants``; a node whose chain never ends has nulls.

        Descendants are counted by the numbers of the ancestors, combined
        before they move.
        """
        below = self._pairs().groupBy("above").agg(F.count(F.lit(1)).alias("n_descendants")).withColumnRenamed("above", "u")
        whole = self._named(self._titled("t"), below)
        path = F.concat(F.reverse(F.coalesce(F.col("ups.t"), F.array().cast("array<string>"))), F.array("t"))
        done = whole.select(F.col("g").alias(self.group), F.col("id").alias(self.node), path.alias("path"), F.coalesce(F.size("ups"), F.lit(0)).alias("depth"), "root_id", F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"))
        return done.unionByName(self.cycles.select(self.group, self.node), allowMissingColumns=True)


def hierarchy(rows: DataFrame, group: str, node: str, parent: str, title: str, every: int = SPLITTER_EVERY) -> Hierarchy:
    """Resolve the trees of all groups at once.

    A hash of its key makes one node in ``every`` a splitter. Every node walks
    to its next splitter or root by pointer doubling, the splitters' own
    pointers (a graph ``every`` times smaller) are doubled up to the roots,
    and a node's path is its walk followed by its splitter's. Walks that meet
    no splitter, and splitters that meet no root, end in cycles and are
    resolved by themselves. Nodes are numbered once, and keys compared (by
    16-byte hashes) only to find each node's parent; all steps after that are
    equi-joins on numbers, in which the looked-up side has one row per key.
    Nothing is grouped by tree, so a group or a parent with a third of all rows
    is only a skewed probe side, which adaptive execution splits. Each round is
    cut by a checkpoint; the rounds grow with the logarithm of the depth.

    A chain ends at a null parent or at one that names no node of the group.
    Nodes are unique by (group, id): repeated rows count once, and of rows that
    differ the greatest (parent, title) holds. A null group is a group of its
    own; rows with a null id name no node and are left out; null titles stay
    nulls in paths. An empty table gives empty results.
    """
    flat = rows.filter(F.col(node).isNotNull()).groupBy(F.col(group).alias("g"), F.col(node).alias("id")).agg(F.max(F.struct(F.col(parent).alias("p"), F.col(title).alias("t"))).alias("r"))
    flat = cut_lineage(flat.select(F.monotonically_increasing_id().alias("u"), "g", "id", F.col("r.p").alias("p"), F.col("r.t").alias("t")))
    key = lambda c: F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("g"), F.col("g").cast("string")), F.lit("")), F.lit("\x00"), F.col(c).cast("string")))).alias("k")
    split = F.pmod(F.xxhash64("g", "id"), F.lit(every)) == 0
    above = flat.select(key("id"), F.col("u").alias("nxt"), split.alias("ns"))
    up = cut_lineage(flat.filter("p is not null").select("u", key("p"), split.alias("s")).join(above, "k").select("u", "s", "nxt", "ns"))
    parts = max(1, up.rdd.getNumPartitions())
    further = up.select(F.col("u").alias("nxt"), F.lit(True).alias("goes_on"))
    links = cut_lineage(up.join(further, "nxt", "left").select("u", "s", "nxt", "ns", F.col("goes_on").isNull().alias("end"), F.array("nxt").alias("via")).coalesce(parts))

    walked = _chase(links.withColumn("stop", F.col("end") | F.col("ns")), F.col("end") | F.col("ns"), parts)
    settled = walked.filter("stop")
    top = _chase(settled.filter("s").withColumn("stop", F.col("end")), F.col("end"), parts).filter("end").select(F.col("u").alias("nxt"), F.col("nxt").alias("up"), F.col("via").alias("more"))
    far = settled.filter("not end").join(top, "nxt").select("u", F.col("up").alias("top"), F.concat("via", "more").alias("via"))
    ended = cut_lineage(settled.filter("end").select("u", F.col("nxt").alias("top"), "via").unionByName(far).coalesce(parts))

    loose = cut_lineage(links.select("u", "nxt").join(ended.select("u"), "u", "left_anti").coalesce(parts))
    ids = broadcast_if_small(loose.select("u"), LOOSE_NODES)
    about = cut_lineage(flat.select("u", "g", "id").join(ids, "u", "left_semi"))
    turning = _cycles(loose.join(about.select("u", "id"), "u"), parts).join(about, "u")
    return Hierarchy(flat.select("u", "g", "id", "t"), ended, ids, turning.select(F.col("g").alias(group), F.col("id").alias(node), F.col("low").alias("cycle_id"), F.col("on_cycle").cast("int").alias("on_cycle")), group, node)


def _chase(rows: DataFrame, arrived: Column, parts: int) -> DataFrame:
    """Double the pointers of ``rows`` until each stops or lies on a walk without end.

    While any walk that ends is still open, each round stops at least one more
    row; so once a round stops none, the open rest runs in cycles. Rounds are
    kept in ``parts`` partitions.
    """
    now = cut_lineage(rows)
    open_rows = now.filter("not stop").count()
    while open_rows:
        step = now.select(F.col("u").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("ns").alias("ns2"), F.col("end").alias("end2"), F.col("via").alias("via2"))
        moved = now.filter("not stop").join(step, "nxt").select("u", "s", F.col("nxt2").alias("nxt"), F.col("ns2").alias("ns"), F.col("end2").alias("end"), F.concat("via", "via2").alias("via"))
        now = cut_lineage(now.filter("stop").unionByName(moved.withColumn("stop", arrived)).coalesce(parts))
        before, open_rows = open_rows, now.filter("not stop").count()
        if open_rows == before:
            break
    return now


def _cycles(links: DataFrame, parts: int) -> DataFrame:
    """``u, low, on_cycle`` for links ``u, nxt, id`` in which every chain runs into a cycle.

    After enough doublings the ends of the walks are exactly the nodes on
    cycles (their number stands still) and the smallest id seen on a walk from
    such a node is the smallest of its cycle (none changes any more).
    """
    now = cut_lineage(links.select("u", "nxt", F.col("id").alias("low")).coalesce(parts))
    state = None
    while True:
        seen = now.agg(F.countDistinct("nxt"), F.sum(F.xxhash64("u", "low").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        step = now.select(F.col("u").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        now = cut_lineage(now.join(step, "nxt").select("u", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low")).coalesce(parts))
    ends = now.select(F.col("nxt").alias("u")).distinct().withColumn("on", F.lit(True))
    lows = now.select(F.col("u").alias("nxt"), F.col("low").alias("cycle"))
    return now.join(ends, "u", "left").join(lows, "nxt").select("u", F.col("cycle").alias("low"), F.col("on").isNotNull().alias("on_cycle"))
