"""Ranking and choosing under budgets, roll-ups, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import fold
from lectern.session import cut_lineage

#: Budgets of a selection.
BUDGET = {"items": 10, "characters": 12_000, "tokens": 3_000}

#: Classes of equal sets, or sets that have to be compared, that are broadcast at most.
SETS = 50_000


def topic_matches(terms: list[str], *texts: str) -> Column:
    """How many of the terms stand in the texts, case aside."""
    whole = F.lower(F.concat_ws(" ", *texts))
    found = F.lit(0)
    for t in sorted({t.lower() for t in terms}):
        found = found + F.contains(whole, F.lit(t)).cast("int")
    return found


def budgeted(rows: DataFrame, group: list[str], order: list[str], size: str, key: str, items: int, characters: int, tokens: int | None = None) -> DataFrame:
    """``rows`` with ``reason``: ``selected``, or why not: ``duplicate``, ``enough_items``, ``over_budget``.

    In the given order a row is taken if there is room for it in characters
    and, if ``tokens`` is given, in tokens (a quarter of the characters each,
    rounded up); one that does not fit is passed over and smaller ones may follow. A key counts as seen
    only once a row of it was taken. Each choice depends on all before it, so
    this is a scan; it keeps the keys taken, at most ``items``.
    """

    def step(state, row):
        taken, used, spent = state or ([], 0, 0)
        n = row[size] or 0
        cost = -(-n // 4)
        if row[key] in taken:
            return (taken, used, spent), {"reason": "duplicate"}
        if len(taken) >= items:
            return (taken, used, spent), {"reason": "enough_items"}
        if used + n > characters or (tokens is not None and spent + cost > tokens):
            return (taken, used, spent), {"reason": "over_budget"}
        return ([*taken, row[key]], used + n, spent + cost), {"reason": "selected"}

    return fold(rows, group, order, step, "reason string")


def short_groups(picks: DataFrame, group: list[str], items: int) -> DataFrame:
    """``group, selected`` of the groups for which fewer than ``items`` rows were selected; a caller that needs them all refuses these."""
    return picks.groupBy(*group).agg(F.count_if(F.col("reason") == "selected").alias("selected")).filter(F.col("selected") < items)


def strongest(rows: DataFrame, keys: list[str], status: str, ranks: dict[str, int], gathered: dict[str, str]) -> DataFrame:
    """One row per key: the status of the highest rank, and the sorted distinct values of each gathered column joined by commas; unknown statuses have rank 0."""
    known = F.create_map(*[F.lit(v) for x in ranks.items() for v in x])
    rank = F.coalesce(F.try_element_at(known, F.col(status)), F.lit(0))
    lists = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(n) for c, n in gathered.items()]
    best = rows.groupBy(*keys).agg(F.max(F.struct(rank.alias("r"), F.col(status).alias("s"))).alias("_b"), *lists)
    return best.select(*keys, F.col("_b.s").alias(status), *gathered.values())


def best(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: the ``columns`` of the row that is greatest by ``order``, ties going to the greatest columns; nulls are least."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *columns)
    return rows.groupBy(*keys).agg(F.max(rank).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def _counted(df: DataFrame) -> DataFrame:
    """The right side of a join: broadcast if it has at most ``SETS`` rows, which are counted; else merged by shuffle, whatever its size is taken to be."""
    return F.broadcast(df) if df.count() <= SETS else df.hint("merge")


def similar_sets(rows: DataFrame, group: str, key: str, tokens: str, least: float) -> DataFrame:
    """``group, left_key, right_key, similarity``: pairs of rows of a group whose token sets have at least the similarity ``least``, left being the smaller key.

    Equal sets are one class whose smallest key stands for it; the others come
    as pairs with that key and similarity 1, not with each other. Classes are
    compared by prefix filtering: tokens are ordered from rare to frequent
    within the group and two sets can only be that similar if they share a
    token among the first ``n - ceil(least * n) + 1``; only such pairs meet,
    through an equi-join on (group, token), and those of sizes too far apart
    are left out. Exact: every candidate is verified. Empty sets and null groups pair with none.

    Classes are numbered and written once. Tokens meet by a hash of (group,
    token) and carry the number only: hashes that coincide make a candidate
    more, never one less, as the order of tokens starts with what is counted
    by hash. A token that no other set of its group has takes its place in the
    prefix but is not joined. Spark plans by the size of the files, which
    exploded tokens exceed many times over, so no join here is left to its
    estimate: what is not counted is merged by shuffle.
    """
    sets = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_sort(F.array_distinct(F.col(tokens))).alias("t"))
    classed = sets.withColumn("h", F.coalesce(F.sha2(F.array_join("t", "\u0001"), 256), F.lit("")))
    classes = classed.groupBy("g", "h").agg(F.min("k").alias("k"), F.first("t").alias("t"), F.count(F.lit(1)).alias("members")).filter(F.size("t") > 0)
    heads = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    several = heads.filter("members > 1").select("g", "h", F.col("k").alias("a"))
    copies = classed.select("g", "h", F.col("k").alias("b")).join(_counted(several), ["g", "h"]).filter("a <> b").select("g", "a", "b", F.lit(1.0).alias("similarity"))
    each = heads.select("id", F.size("t").alias("n"), "g", F.explode("t").alias("w")).select("id", "n", "w", F.xxhash64("g", "w").alias("gw"))
    often = each.groupBy("gw").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = each.join(often.hint("merge"), "gw").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gw", "w"))).alias("by"))
    room = F.size("by") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1
    signed = shared.filter(room > 0).select("id", "n", F.explode(F.slice(F.col("by.gw"), F.lit(1), room)).alias("gw"))
    left, right = signed.select("gw", F.col("id").alias("ia"), F.col("n").alias("na")), signed.select("gw", F.col("id").alias("ib"), F.col("n").alias("nb"))
    met = left.join(right.hint("merge"), "gw").filter((F.col("ia") < F.col("ib")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")))
    once = cut_lineage(met.select("ia", "ib").distinct())
    wanted = once.select(F.explode(F.array("ia", "ib")).alias("id")).distinct()
    texts = heads.select("id", "g", "k", "t").join(_counted(wanted), "id", "left_semi")
    first, second = texts.select(F.col("id").alias("ia"), "g", F.col("k").alias("ka"), F.col("t").alias("ta")), texts.select(F.col("id").alias("ib"), F.col("g").alias("gb"), F.col("k").alias("kb"), F.col("t").alias("tb"))
    both = once.join(first.hint("merge"), "ia").join(second.hint("merge"), "ib").filter("g = gb and ka <> kb")
    similarity = F.size(F.array_intersect("ta", "tb")).cast("double") / F.size(F.array_union("ta", "tb"))
    near = both.select("g", F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), similarity.alias("similarity")).filter(F.col("similarity") >= least)
    return near.unionByName(copies).select(F.col("g").alias(group), F.col("a").alias("left_key"), F.col("b").alias("right_key"), F.round("similarity", 6).alias("similarity"))


def event_state(events: DataFrame, key: str, stamp: str, order: str, status: str) -> DataFrame:
    """``key, status, n_events, first_at, last_at``: the latest state of every key of an append-only log; ties on the time go to the greater ``order``."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(stamp, order)).alias("status"), F.count(F.lit(1)).alias("n_events"), F.min(stamp).alias("first_at"), F.max(stamp).alias("last_at"))
