"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.tokens import RANKS, distinct_counts, text_key
from lectern.session import broadcast_if_small, cut_lineage

#: Texts in one bucket of a pattern's order, on average.
BUCKET = 20_000

PLAN = T.StructType([T.StructField(n, t) for n, t in (("pattern", T.StringType()), ("mix_name", T.StringType()), ("source", T.StringType()), ("start", T.LongType()), ("lo", T.LongType()), ("hi", T.LongType()), ("size", T.LongType()))])

#: Rows of the plan up to which it is broadcast.
PLAN_ROWS = 100_000


@dataclass
class Network:
    """A flow network with integer capacities and costs."""

    ends: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        k = len(self.ends)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(r)
            self.cost.append(c)
        return k

    def _prices(self, s: int) -> list[float]:
        far = [float("inf")] * len(self.out)
        far[s] = 0
        queue, waiting = deque([s]), {s}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in self.out[u]:
                v = self.ends[e]
                if self.room[e] and far[u] + self.cost[e] < far[v]:
                    far[v] = far[u] + self.cost[e]
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        return far

    def push(self, s: int, t: int, with_costs: bool = True) -> int:
        """A maximum flow from ``s`` to ``t``, of least cost if costs count: blocking flows along cheapest paths, cost by cost."""
        sent = 0
        while True:
            price = self._prices(s) if with_costs else None
            if price is not None and price[t] == float("inf"):
                return sent
            more = self._blocking(s, t, price)
            if not more:
                return sent
            sent += more

    def _blocking(self, s: int, t: int, price: list[float] | None) -> int:
        fits = lambda u, e: self.room[e] and (price is None or price[u] + self.cost[e] == price[self.ends[e]])
        sent = 0
        while True:
            depth = {s: 0}
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in self.out[u]:
                    if fits(u, e) and self.ends[e] not in depth:
                        depth[self.ends[e]] = depth[u] + 1
                        queue.append(self.ends[e])
            if t not in depth:
                return sent
            at = [0] * len(self.out)
            while True:
                path, u = [], s
                while u != t:
                    while at[u] < len(self.out[u]):
                        e = self.out[u][at[u]]
                        if fits(u, e) and depth.get(self.ends[e]) == depth[u] + 1:
                            break
                        at[u] += 1
                    if at[u] < len(self.out[u]):
                        path.append(self.out[u][at[u]])
                        u = self.ends[path[-1]]
                    elif path:
                        u = self.ends[path.pop() ^ 1]
                        at[u] += 1
                    else:
                        break
                if u != t:
                    break
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least
                sent += least


def route(sizes: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source.

    ``sizes``: tokens of the texts that stand in exactly these sources;
    ``shares`` add up to 1. Without ``total`` the greatest total is taken for
    which every source that has any text reaches its share exactly; a source
    without text gets nothing and the others' shares are kept in proportion.
    With ``total``, quotas that can't be met are met as far as they can. Of all
    ways to meet the quotas one is taken in which texts repeat least: the k-th
    copy of a token costs k - 1.
    """
    own = {p: n for p, n in sorted(sizes.items()) if n > 0}
    live = {s: w for s, w in sorted(shares.items()) if w > 0 and repeats.get(s, 0) > 0 and any(s in p for p in own)}
    whole = sum(live.values())
    if not live:
        return {}
    quota = lambda n: {s: int(n * w / whole) for s, w in live.items()}

    def build(wanted: dict[str, int]) -> tuple[Network, int, int, dict]:
        net = Network()
        s, t = net.node(), net.node()
        of = {x: net.node() for x in live}
        gives = {}
        for p, n in own.items():
            inside = [x for x in p if x in live]
            if not inside:
                continue
            u = net.node()
            for k in range(max(repeats[x] for x in inside)):
                net.arc(s, u, n, k)
            for x in inside:
                gives[p, x] = net.arc(u, of[x], n * repeats[x])
        for x, n in wanted.items():
            net.arc(of[x], t, n)
        return net, s, t, gives

    if total is None:
        lo, hi = 0, sum(n * max(repeats[x] for x in live) for n in own.values())
        while lo < hi:
            mid = (lo + hi + 1) // 2
            wanted = quota(mid)
            net, s, t, _ = build(wanted)
            if net.push(s, t, with_costs=False) == sum(wanted.values()):
                lo = mid
            else:
                hi = mid - 1
        total = lo
    net, s, t, gives = build(quota(total))
    net.push(s, t)
    return {k: net.room[e ^ 1] for k, e in gives.items() if net.room[e ^ 1]}


def texts_by_pattern(documents: DataFrame, sources: list[str], key: str, text: str, source: str, ranks: str = RANKS) -> DataFrame:
    """``text_hash, n_tokens, members, pattern``: every distinct text with tokens and the document that stands for it in each source.

    ``members`` is an array of (source, document) of all listed sources the
    text stands in; ``pattern`` joins their names.
    """
    rows = documents.filter(F.col(source).isin(sources)).select(text_key(text).alias("text_hash"), F.col(source).alias("source"), F.col(key).alias("doc_id"))
    each = rows.groupBy("text_hash", "source").agg(F.min("doc_id").alias("doc_id"))
    sets = each.groupBy("text_hash").agg(F.array_sort(F.collect_set(F.struct("source", "doc_id"))).alias("members"))
    counts = distinct_counts(documents.filter(F.col(source).isin(sources)), text, ranks).filter("n_tokens > 0")
    return sets.join(counts, "text_hash").withColumn("pattern", F.array_join(F.col("members.source"), "\x1f"))


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, total: int | None = None, ranks: str = RANKS) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, copies``: the selection for every mix.

    ``targets``: ``mix_name, source, target_share, max_repeats``, a small table
    that goes to the driver. Copies of a text under several documents are one
    text; it may serve any of the sources it stands in, each use being counted
    for one of them, and no source uses it more than its ``max_repeats`` times.
    Only totals per membership pattern go to the driver (as many as there are
    different sets of listed sources), where :func:`route` decides how many
    tokens each pattern gives to each source. For a mix, patterns that agree in
    its own sources are one, laid end to end. A pattern's texts are put in a
    seeded order and a source takes a stretch of it, wrapping round for
    repeats; what a stretch lacks or has too much is made up by a few texts of
    that size.

    The order's prefix sums are taken in buckets of bounded size, so a pattern
    with a third of all texts is no single task. Null and empty texts have no
    tokens and are never selected; sources that no target names are left out;
    an empty table gives an empty selection.
    """
    spark = documents.sparkSession
    wanted = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    sources = sorted({r["source"] for r in wanted})
    texts = cut_lineage(texts_by_pattern(documents, sources, key, text, source, ranks))
    sums = {r["pattern"]: (r["tokens"], r["n"]) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan = []
    quotas: dict[tuple[str, str], int] = {}
    for mix in sorted({r["mix_name"] for r in wanted}):
        own = [r for r in wanted if r["mix_name"] == mix]
        names = {r["source"] for r in own}
        merged: dict[tuple[str, ...], int] = {}
        parts: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for p, (n, _) in sorted(sums.items()):
            if inside := tuple(x for x in p.split("\x1f") if x in names):
                parts.setdefault(inside, []).append((p, merged.get(inside, 0)))
                merged[inside] = merged.get(inside, 0) + n
        flows = route(merged, {r["source"]: r["share"] for r in own}, {r["source"]: r["repeats"] for r in own}, total)
        at: dict[tuple[str, ...], int] = {}
        for (inside, s), n in sorted(flows.items()):
            lo = at.get(inside, 0)
            plan += [(p, mix, s, start, lo, lo + n, merged[inside]) for p, start in parts[inside]]
            quotas[mix, s] = quotas.get((mix, s), 0) + n
            at[inside] = lo + n
    buckets = max(16, sum(n for _, n in sums.values()) // BUCKET)
    placed = texts.withColumn("order", F.xxhash64(F.lit(seed), "text_hash")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("tokens")).select("pattern", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("order", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("in_bucket", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, ["pattern", "bucket"])
    middle = F.col("start") + F.col("base") + F.col("in_bucket") + F.col("n_tokens") / 2
    turns = lambda c: F.ceil((F.col(c) - middle) / F.col("size"))
    planned = ordered.join(broadcast_if_small(spark.createDataFrame(plan, PLAN), PLAN_ROWS), "pattern")
    doc = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["doc_id"]
    caps = {(r["mix_name"], r["source"]): r["repeats"] for r in wanted}
    cap = F.create_map(*[v for (m, x), n in sorted(caps.items()) for v in (F.concat_ws("\x1f", F.lit(m), F.lit(x)), F.lit(n))]) if caps else F.create_map().cast("map<string,int>")
    most = F.array_max(F.transform("members", lambda m: F.coalesce(F.try_element_at(cap, F.concat_ws("\x1f", "mix_name", m["source"])), F.lit(0))))
    used = planned.select("mix_name", "source", "text_hash", doc.alias("doc_id"), "n_tokens", (turns("hi") - turns("lo")).cast("int").alias("copies"), (F.size("members") == 1).alias("alone"), most.alias("most"))
    shared = used.filter("not alone").groupBy("mix_name", "text_hash").agg(F.sum("copies").alias("_uses"))
    chosen = cut_lineage(used.join(shared, ["mix_name", "text_hash"], "left").withColumn("uses", F.coalesce("_uses", F.col("copies").cast("bigint"))).drop("_uses"))
    return _settled(chosen, quotas, caps).filter("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")


_STEPS = T.StructType([T.StructField(n, t) for n, t in (("mix_name", T.StringType()), ("source", T.StringType()), ("text_hash", T.BinaryType()), ("step", T.IntegerType()))])
_SHIFTS = T.StructType([T.StructField(n, t) for n, t in (("mix_name", T.StringType()), ("text_hash", T.BinaryType()), ("shift", T.IntegerType()))])


def _settled(chosen: DataFrame, quotas: dict[tuple[str, str], int], caps: dict[tuple[str, str], int]) -> DataFrame:
    """``chosen`` with a few texts more or less in each mix and source, until none would bring its tokens nearer to the quota.

    A stretch ends within half a text of its quota, which matters where a
    quota is a few texts. In each round one copy of the text whose size is
    nearest to what is missing or too much is added or taken away. A text may
    be added while its source's ``max_repeats`` and, over all its sources in
    the mix, the greatest of theirs allow (``uses`` below ``most``); of two
    sources that would add the same text in a round the first does, the other
    waits for the next. Every step brings a source strictly nearer to its
    quota, so the rounds end. The driver gets two rows a round for each mix
    and source that is still off.
    """
    spark = chosen.sparkSession
    steps: dict[tuple[str, str, bytes], int] = {}
    now = chosen
    while True:
        got = {(r["mix_name"], r["source"]): r["n"] for r in now.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
        open_rows = [(m, s, q - got.get((m, s), 0), caps[m, s]) for (m, s), q in quotas.items() if q != got.get((m, s), 0)]
        lack = F.broadcast(spark.createDataFrame(open_rows, "mix_name string, source string, lack long, cap int"))
        far = F.abs(F.col("n_tokens") - F.abs("lack"))
        able = F.when(F.col("lack") > 0, (F.col("copies") < F.col("cap")) & (F.col("uses") < F.col("most"))).otherwise(F.col("copies") > 0)
        near = now.join(lack, ["mix_name", "source"]).filter(able & (far < F.abs("lack")))
        best = near.groupBy("mix_name", "source").agg(F.min(F.struct(far.alias("far"), "text_hash", F.signum("lack").cast("int").alias("step"))).alias("b")).collect()
        if not best:
            return now
        added: set[tuple[str, bytes]] = set()
        for r in sorted(best, key=lambda r: (r["mix_name"], r["source"])):
            text, step = (r["mix_name"], bytes(r["b"]["text_hash"])), r["b"]["step"]
            if step > 0 and text in added:
                continue
            if step > 0:
                added.add(text)
            k = (r["mix_name"], r["source"], text[1])
            steps[k] = steps.get(k, 0) + step
        shifts: dict[tuple[str, bytes], int] = {}
        for (m, _, h), n in steps.items():
            shifts[m, h] = shifts.get((m, h), 0) + n
        changed = F.broadcast(spark.createDataFrame([(*k, n) for k, n in sorted(steps.items())], _STEPS))
        moved = F.broadcast(spark.createDataFrame([(*k, n) for k, n in sorted(shifts.items())], _SHIFTS))
        now = chosen.join(changed, ["mix_name", "source", "text_hash"], "left").join(moved, ["mix_name", "text_hash"], "left")
        now = now.withColumns({"copies": F.col("copies") + F.coalesce("step", F.lit(0)), "uses": F.col("uses") + F.coalesce("shift", F.lit(0))}).drop("step", "shift")


def actual_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, actual_share, tokens, documents, most_copies, max_repeats`` of every target; 0 where nothing was selected."""
    used = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = targets.join(used, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", zero("tokens"), zero("documents"), zero("most_copies"), "max_repeats")
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0)))
