from __future__ import annotations

import random

import pytest

from lectern.operators.graph import connected_components
from lectern.operators.hierarchy import hierarchy


def brute(rows):
    parent = {(g, i): p for g, i, p, _ in rows}
    title = {(g, i): t for g, i, _, t in rows}
    nodes, cycles = {}, {}
    for g, i in parent:
        walk, at = [i], i
        while (nxt := parent[g, at]) is not None and (g, nxt) in parent and nxt not in walk:
            walk.append(nxt)
            at = nxt
        nxt = parent[g, at]
        if nxt is not None and (g, nxt) in parent:
            turn = walk[walk.index(nxt) :]
            cycles[g, i] = (min(turn), int(i in turn))
        else:
            nodes[g, i] = ([title[g, x] for x in reversed(walk)], walk[1:], len(walk) - 1, walk[-1])
    return nodes, cycles


def forest(seed, n=250):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        parent = None if kind < 0.06 else f"n{r.randrange(n)}" if kind < 0.5 else f"n{max(0, i - 1)}" if kind < 0.9 else "gone"
        rows.append((r.choice(["a", "b", None]), f"n{i}", parent, r.choice(["t", "u", None])))
    rows += [("a", f"c{k}", f"c{k + 1}", "deep") for k in range(90)] + [("a", "c90", None, "top"), ("b", "s", "s", "self"), ("b", "p", "q", "x"), ("b", "q", "p", "y")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_walk_of_every_node(spark, seed):
    rows = forest(seed)
    df = spark.createDataFrame([*rows, *rows[:20]], "g string, id string, parent string, title string").selectExpr("*", "1 as nxt", "2 as root", "3 as via")
    nodes, cycles = brute(rows)
    h = hierarchy(df, "g", "id", "parent", "title")
    assert {(r.g, r.id): (r.path, r.ancestors, r.depth, r.root_id) for r in h.nodes.collect()} == nodes
    assert {(r.g, r.id): (r.cycle_id, r.on_cycle) for r in h.cycles.collect()} == cycles
    below = {(r.g, r.id, r.descendant_id, r.distance) for r in h.descendants().collect()}
    assert below == {(g, a, i, k) for (g, i), (_, up, _, _) in nodes.items() for k, a in enumerate(up, 1)}
    paths = {(r.g, r.id): r.n_descendants for r in h.paths().collect()}
    assert len(paths) == len(nodes) + len(cycles) and all(paths[k] is None for k in cycles)
    for every in (1, 1_000_000):
        again = hierarchy(df, "g", "id", "parent", "title", every=every)
        assert {(r.g, r.id): (r.cycle_id, r.on_cycle) for r in again.cycles.collect()} == cycles
        assert {(r.g, r.id): (r.depth, r.root_id) for r in again.depths().collect()} == {k: v[2:] for k, v in nodes.items()}


def test_empty_table_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([], "g string, id string, parent string, title string")
    h = hierarchy(df, "g", "id", "parent", "title")
    assert h.nodes.count() == h.cycles.count() == h.paths().count() == 0
    df = spark.createDataFrame([("a", None, "x", "t"), ("a", "x", None, "old"), ("a", "x", None, "z")], df.schema)
    assert [(r.id, r.path) for r in hierarchy(df, "g", "id", "parent", "title").nodes.collect()] == [("x", ["z"])]


def test_components(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(220)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)] + [("l", "l"), ("x", None), (None, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges + edges[:9], "a string, b string").selectExpr("*", "1 as u", "2 as node")
    assert {q.node: q.component for q in connected_components(df).collect()} == {x: find(x) for x in parent}
    assert connected_components(df.limit(0)).count() == 0
