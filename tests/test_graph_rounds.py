"""Graph operators that run in rounds, against the sequential rules."""

import itertools
import random

import pytest

from geopulse.operators import graph, network


def lattice(spark, n, drop=lambda e: False):
    vertices = [(100 * j + i, i * 150.0, j * 150.0) for j in range(n) for i in range(n)]
    edges = [(2 * k, k, k + 1, 150.0) for k, x, _ in vertices if x < (n - 1) * 150] + [(2 * k + 1, k, k + 100, 150.0) for k, _, y in vertices if y < (n - 1) * 150]
    edges = [e for e in edges if not drop(e)]
    return spark.createDataFrame(vertices, "key long, x double, y double"), spark.createDataFrame(edges, "edge_id long, k1 long, k2 long, length double"), edges


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 7)])
def test_nodes_merge_as_in_sequence(spark, seed, parts):
    rng = random.Random(seed)
    nodes = [(i, rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(150)] + [(200 + i, 20 + 0.9 * i, 0.0) for i in range(9)]
    rng.shuffle(nodes)
    want = {}
    for i, x, y in sorted(nodes):
        if i not in want:
            for j, u, v in nodes:
                if j not in want and (x - u) ** 2 + (y - v) ** 2 <= 1.0:
                    want[j] = i
    df = spark.createDataFrame(nodes, "node_id long, x double, y double").repartition(parts)
    assert {r.node_id: r.key for r in graph.merge_nodes(df, 1.0).collect()} == want
    apart = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0)], df.schema)
    assert {r.node_id: r.key for r in graph.merge_nodes(apart, 1.0).collect()} == {1: 1, 2: 2}


def test_dense_nodes_merge_without_a_table_of_pairs(spark, monkeypatch):
    """All nodes near one another: no table may grow with their pairs."""
    rng, most = random.Random(5), [0]
    nodes = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(600)] + [(601, float("nan"), 0.0), (602, None, 0.0)]
    keep = graph.written

    def counted(df):
        out = keep(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    df = spark.createDataFrame(nodes, "node_id long, x double, y double")
    got = {r.node_id: r.key for r in graph.merge_nodes(df, 2.0).collect()}
    assert got == {i: 0 for i in range(600)} | {601: 601, 602: 602} and most[0] <= len(nodes)


def test_graph_of_lines_keeps_first_places(spark):
    lines = [(1, 1, 0.0, 0.0), (1, 2, 1.0, 1.0), (1, 3, 5.1, 1.2), (2, 1, 2.0, 0.0), (2, 2, 1.05, 1.0), (2, 3, 0.0, 5.0), (2, 4, 5.1, 1.2), (3, 1, 0.0, 0.0), (3, 2, 0.0, 5.0), (3, 3, 0.02, 5.0)]
    vertices, edges = graph.from_lines(spark.createDataFrame(lines, "line_id long, seq long, x double, y double"), 0.1)
    at = {r.key: (r.x, r.y) for r in vertices.collect()}
    assert sorted(at.values()) == [(0.0, 0.0), (0.0, 5.0), (1.0, 1.0), (2.0, 0.0), (5.1, 1.2)]
    got = {frozenset((at[r.k1], at[r.k2])) for r in edges.collect()}
    a, b, c, d, e = (0.0, 0.0), (1.0, 1.0), (5.1, 1.2), (2.0, 0.0), (0.0, 5.0)
    assert got == {frozenset(p) for p in ((a, b), (b, c), (d, b), (b, e), (e, c), (a, e))} and edges.count() == 6


def chain_of(edges):
    """Every edge's (place, k_from, k_to), by walking each chain in either direction."""
    ways = {}
    for e, a, b, _ in edges:
        ways.setdefault(a, []).append((e, b))
        ways.setdefault(b, []).append((e, a))
    two = {v for v, w in ways.items() if len(w) == 2}
    # Cycles: components of edges whose vertices are all of degree 2.
    ends, seen = set(ways) - two, set()
    for v in sorted(two):
        stack, members = [v], set()
        while stack:
            u = stack.pop()
            if u not in members:
                members.add(u)
                stack += [w for _, w in ways[u]]
        if members <= two and v not in seen:
            ends.add(min(members))
        seen |= members
    best = {}
    for start in ends:
        for first, _ in ways[start]:
            edge, at, place = first, start, 0
            while True:
                to = next(b for e, b in ways[at] if e == edge)
                row = (start, first, place, at, to)
                best[edge] = min(best.get(edge, row), row)
                if to in ends:
                    break
                edge, at, place = next(e for e, _ in ways[to] if e != edge), to, place + 1
    return {e: r[2:] for e, r in best.items()}


def test_places_in_chains(spark):
    ring = [(k, k, (k + 1) % 9 + 0, 1.0) for k in range(9)]
    # A chain of 11 edges in mixed order, a ring, and a loop of three edges that hangs on a junction.
    order = [105, 3, 77, 20, 51, 90, 12, 64, 33, 8, 41, 19]
    chain = [(100 + i, *((a, b) if i % 2 else (b, a)), 1.0) for i, (a, b) in enumerate(itertools.pairwise([x + 1000 for x in order]))]
    lasso = [(200, 2000, 2001, 1.0), (201, 2001, 2002, 1.0), (202, 2003, 2002, 1.0), (203, 2003, 2001, 1.0), (204, 2001, 2010, 1.0)]
    edges = ring + chain + lasso
    for parts in (1, 6):
        df = spark.createDataFrame(edges, "edge_id long, k1 long, k2 long, length double").repartition(parts)
        got = {r.edge_id: (r.place, r.k_from, r.k_to) for r in graph.ordered_segments(df).collect()}
        assert got == chain_of(edges)
    named = {r.edge_id: r.segment for r in graph.ordered_segments(df).collect()}
    assert {named[e[0]] for e in chain} == {100} and {named[k] for k in range(9)} == {0} and {named[k] for k in (201, 202, 203)} == {201}


def test_one_index_serves_several_bandwidths(spark, tmp_path):
    _, edges, rows = lattice(spark, 4, lambda e: e[0] % 7 == 3)
    rng = random.Random(4)
    events = spark.createDataFrame([(i, rng.choice(rows)[0], rng.random()) for i in range(12)] + [(90, rows[0][0], 0.5)] * 2, "event_id long, edge_id long, t double")
    folder = f"file://{tmp_path}/index"
    index = network.saved_path_index(edges, 500.0, folder)
    for bandwidth in (100.0, 320.0, 500.0):
        want = {r.edge_id: r.risk for r in network.network_hotspot(events, edges, bandwidth).collect()}
        got = {r.edge_id: r.risk for r in network.network_hotspot_indexed(events, edges, index, bandwidth).collect()}
        assert got == pytest.approx(want)
    made = {p.name for p in (tmp_path / "index").iterdir()}
    network.saved_path_index(edges.repartition(3), 500.0, folder)
    assert {p.name for p in (tmp_path / "index").iterdir()} == made and len(made) == 1
    network.saved_path_index(edges.where("edge_id <> 0"), 500.0, folder)
    assert len(list((tmp_path / "index").iterdir())) == 2
