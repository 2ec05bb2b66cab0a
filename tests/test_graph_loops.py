"""Iterative graph operators against plain Python on random graphs."""

import random
from collections import deque

import pytest

from graphloom.functions.similarity import partial_ratio, token_sort_ratio
from graphloom.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "subject string, predicate string, object string")


def random_edges(rng, nodes=9, count=16):
    return list({(f"n{rng.randrange(nodes)}", rng.choice(["rel:RELATED_TO", "rel:uses", "rel:PART_OF"]), f"n{rng.randrange(nodes)}") for _ in range(count)})


def queue_search(edges, names, seeds, hops):
    """The first-in-first-out search: a node is skipped if it was reached with at least this score."""
    best, queue = {}, deque((i, s, 0) for i, s in seeds)
    while queue:
        node, score, depth = queue.popleft()
        if score <= 0 or depth > hops or best.get(node, (-1, 0))[0] >= score:
            continue
        best[node] = (score, depth)
        for s, p, o in edges:
            if s == node and depth < hops:
                w = (1.2 if p.endswith("RELATED_TO") else 1.5) + partial_ratio(p, "RELATED_TO") / 100
                w *= 0.8 if names.get(o, o).endswith("material") else 1.0
                queue.append((o, score * w / (depth + 1), depth + 1))
    return {n: (round(s, 9), d) for n, (s, d) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_weighted_search(spark, seed):
    rng = random.Random(seed)
    edges, hops = random_edges(rng), seed + 1
    names = {f"n{i}": "a material" if i % 3 == 0 else f"name {i}" for i in range(7)}
    seeds = [(f"n{i}", round(rng.random(), 3)) for i in range(3)] + [("n8", 0.0)]
    got = graph.weighted_search(frame(spark, edges), spark.createDataFrame(list(names.items()), "id string, name string"), spark.createDataFrame(seeds, "id string, score double"), hops)
    assert {r.id: (round(r.score, 9), r.depth) for r in got.collect()} == queue_search(edges, names, seeds, hops)


def test_additive_search(spark):
    rng = random.Random(5)
    edges = random_edges(rng)
    best, level = {"n0": 1.0, "n1": 1.0}, {"n0": [1.0], "n1": [1.0]}
    for depth in range(3):
        after = {}
        for s, p, o in edges:
            for score in level.get(s, []):
                made = score * (1.2 if p.endswith("RELATED_TO") else 1.5) + token_sort_ratio(p, "RELATED_TO") / 100 / (depth + 1)
                after.setdefault(o, []).append(made)
                best[o] = max(best.get(o, 0), made)
        level = after
    got = graph.additive_search(frame(spark, edges), spark.createDataFrame([("n0",), ("n1",)], "id string"), 3, k=99)
    assert {r.id: round(r.score, 9) for r in got.collect()} == {n: round(s, 9) for n, s in best.items()}


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}" if i < 40 else None) for i in range(41)] + [("x", "y"), ("y", "x")]
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(chain, "name string, is_a string")).collect()}
    want = {(f"c{i:02}", f"c{j:02}") for i in range(41) for j in range(i, 41)} | {(a, b) for a in "xy" for b in "xy"}
    assert got == want


def test_shortest_path_and_hops(spark):
    rng = random.Random(11)
    for _ in range(2):
        edges = random_edges(rng, 14, 15)
        near = {}
        for s, _, o in edges:
            near.setdefault(s, set()).add(o)
            near.setdefault(o, set()).add(s)
        steps, queue = {"n0": 0}, deque(["n0"])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in steps:
                    steps[y] = steps[x] + 1
                    queue.append(y)
        for target in ("n0", "n5", "n13"):
            found = graph.shortest_path(frame(spark, edges), "n0", target).collect()
            assert [len(r.path) - 1 for r in found] == ([steps[target]] if target in steps else [])
            assert all(b in near[a] for r in found for a, b in zip(r.path, r.path[1:], strict=False))
    deep = [(f"d{i}", "p", f"d{i + 1}") for i in range(12)]
    got = graph.k_hop(frame(spark, deep), spark.createDataFrame([("d0",)], "id string"), 10)
    assert {r.id: r.depth for r in got.collect()} == {f"d{i}": i for i in range(11)}
