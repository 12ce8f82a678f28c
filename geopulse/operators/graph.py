"""Street graphs: edges (edge_id, k1, k2, length), vertices (key, x, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.tables import forget, running, written


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge_id, a, b, length) in both directions."""
    return edges.select("edge_id", F.col("k1").alias("a"), F.col("k2").alias("b"), "length").unionAll(edges.select("edge_id", F.col("k2").alias("a"), F.col("k1").alias("b"), "length"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("degree"))


def derived_graph(edges: DataFrame) -> DataFrame:
    """(e1, e2, length): edges that share a vertex, with the mean of their lengths."""
    s = both_ways(edges).select("edge_id", "a", "length")
    t = s.select(F.col("edge_id").alias("f"), "a", F.col("length").alias("g"))
    return s.join(t, "a").where(F.col("edge_id") < F.col("f")).select(F.col("edge_id").alias("e1"), F.col("f").alias("e2"), ((F.col("length") + F.col("g")) / 2).alias("length")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(key, component): the least key reachable; least labels of neighbours, and the labels' own labels, until nothing changes."""
    both = both_ways(edges).select("a", "b").distinct()
    labels = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("component").alias("n"))
        step = labels.join(near, labels.key == near.a, "left").select("key", F.col("component").alias("old"), F.least("component", "n").alias("component"))
        own = labels.select(F.col("key").alias("u"), F.col("component").alias("m"))
        step = written(step.join(own, step.component == own.u, "left").select("key", "old", F.least("component", "m").alias("component")))
        labels = step.select("key", "component")
        if not step.where("component <> old").limit(1).count():
            return labels


def shortest_paths(edges: DataFrame, start: int, most: float | None = None) -> DataFrame:
    """(key, distance, previous) from a vertex, -1 where it can't be reached: rounds of relaxation over the changed frontier."""
    known = edges.sparkSession.createDataFrame([(start, 0.0, None)], "key long, distance double, previous long")
    both = both_ways(edges).select("a", "b", "length")
    known = relaxed(both, known, most)
    vertices = both.select(F.col("a").alias("key")).distinct()
    return vertices.join(known, "key", "left").select("key", F.coalesce("distance", F.lit(-1.0)).alias("distance"), "previous")


def shortest_edge_paths(edges: DataFrame, edge_id: int, position: float = 0.5) -> DataFrame:
    """(key, distance, previous) of the vertices that a place on an edge reaches; the edge's own ends are their own previous."""
    on = edges.where(F.col("edge_id") == edge_id)
    ends = [(F.col("k1"), F.col("length") * position), (F.col("k2"), F.col("length") * (1 - position))]
    known = reduce(DataFrame.unionAll, (on.select(k.alias("key"), d.alias("distance"), k.alias("previous")) for k, d in ends))
    return relaxed(both_ways(edges).select("a", "b", "length"), known)


def edge_distances(edges: DataFrame, edge_id: int) -> DataFrame:
    """(edge_id, distance): from the middle of an edge to the middle of each other that it reaches; 0 for itself."""
    found = shortest_edge_paths(edges, edge_id).select("key", "distance")
    near = both_ways(edges).join(found, F.col("a") == F.col("key")).groupBy("edge_id").agg(F.min(F.col("distance") + F.col("length") / 2).alias("d"))
    return near.select("edge_id", F.when(F.col("edge_id") == edge_id, 0.0).otherwise(F.col("d")).alias("distance"))


def edge_places(vertices: DataFrame, edges: DataFrame, on: DataFrame) -> DataFrame:
    """on(event_id, edge_id, t) with the place (x, y) at the share t of the edge from k1 to k2."""
    a, b = (vertices.select(F.col("key").alias(k), F.col("x").alias(f"x{k[1]}"), F.col("y").alias(f"y{k[1]}")) for k in ("k1", "k2"))
    at = lambda c: (F.col(f"{c}1") * (1 - F.col("t")) + F.col(f"{c}2") * F.col("t")).alias(c)
    return on.join(edges, "edge_id").join(a, "k1").join(b, "k2").select("event_id", "edge_id", "t", at("x"), at("y"))


def bounds(vertices: DataFrame) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax."""
    return vertices.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def relaxed(both: DataFrame, known: DataFrame, most: float | None = None) -> DataFrame:
    """(key, distance, previous): the least distances from those known, by rounds over the vertices that changed."""
    frontier = known
    while True:
        reach = frontier.join(both, frontier.key == both.a).select(F.col("b").alias("key"), (F.col("distance") + F.col("length")).alias("distance"), F.col("a").alias("previous"))
        if most is not None:
            reach = reach.where(F.col("distance") <= most)
        best = F.min(F.struct("distance", "previous")).alias("m")
        new = reach.groupBy("key").agg(best).select("key", "m.distance", "m.previous")
        old = known.select("key", F.col("distance").alias("d"))
        frontier = written(new.join(old, "key", "left").where("d is null or distance < d").select("key", "distance", "previous"))
        if not frontier.limit(1).count():
            break
        known = written(known.unionByName(frontier).groupBy("key").agg(best).select("key", "m.distance", "m.previous"))
    return known


def simple_paths(edges: DataFrame, start: int, most: float, steps: int) -> DataFrame:
    """(path, length): all simple paths from a vertex with at most ``steps`` edges and length ``most``."""
    both = both_ways(edges).select("a", "b", F.col("length").alias("step"))
    paths = edges.sparkSession.createDataFrame([([start], start, 0.0)], "path array<long>, at long, length double")
    out = paths
    for _ in range(steps):
        grown = paths.join(both, paths.at == both.a).where(~F.array_contains("path", F.col("b")) & (F.col("length") + F.col("step") <= most))
        paths = written(grown.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("length") + F.col("step")).alias("length")))
        out = out.unionByName(paths)
    return out.select("path", "at", "length")


def paths_between(edges: DataFrame, start: int, end: int, most: float | None = None, avoid: list[tuple[int, int]] = ()) -> DataFrame:
    """(path, length): the paths from start to end that pass no vertex twice, no longer than ``most``, and not over the avoided edges,
    named by their two vertices. A path ends where it first comes to the end; start and end may be equal."""
    both = both_ways(edges).select("a", "b", F.col("length").alias("step"))
    if avoid:
        left_out = edges.sparkSession.createDataFrame([p for u, v in avoid for p in ((u, v), (v, u))], "a long, b long").distinct()
        both = both.join(F.broadcast(left_out), ["a", "b"], "left_anti")  # as many as the caller names
    at = edges.sparkSession.createDataFrame([([start], start, 0.0)], "path array<long>, at long, length double")
    if start == end:
        return at.select("path", "length")
    out = None
    while True:
        grown = at.join(both, at.at == both.a).where(~F.array_contains("path", F.col("b")))
        grown = grown.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("length") + F.col("step")).alias("length"))
        grown = written(grown if most is None else grown.where(F.col("length") <= most))
        found = grown.where(F.col("at") == end).select("path", "length")
        out = found if out is None else out.unionAll(found)
        at = grown.where(F.col("at") != end)
        if at.isEmpty():
            return out


def edge_paths_between(edges: DataFrame, start: tuple[int, int], end: tuple[int, int], most: float | None = None) -> DataFrame:
    """(path, length): the paths from either end of one edge to either end of another that use neither; the two edges' own lengths don't count."""
    each = [paths_between(edges, u, v, most, [start, end]) for u in start for v in end]
    return reduce(DataFrame.unionAll, each)


def walks_with_degrees(edges: DataFrame, start: int, avoid: int, most: float, max_degree: float) -> DataFrame:
    """(k1, k2, length, degree): walks from ``start`` not over ``avoid``; each row enters an edge at distance ``length`` with the
    product of max(degree - 1, 1) so far. A walk ends where its length reaches ``most`` or its degree exceeds ``max_degree``."""
    both = both_ways(edges).select("a", "b", F.col("length").alias("step"))
    deg = degrees(edges).select(F.col("key").alias("a"), F.greatest(F.col("degree") - 1, F.lit(1)).cast("double").alias("split"))
    both = both.join(deg, "a")
    at = edges.sparkSession.createDataFrame([([avoid, start], start, 0.0, 1.0)], "path array<long>, at long, length double, degree double")
    out = None
    while True:  # walks pass no vertex twice, so they end
        grown = at.join(both, at.at == both.a).where(~F.array_contains("path", F.col("b")))
        grown = grown.withColumn("degree", F.col("degree") * F.col("split")).where(F.col("degree") <= max_degree)
        rows = grown.select(F.col("a").alias("k1"), F.col("b").alias("k2"), "length", "degree")
        out = rows if out is None else out.unionByName(rows)
        at = written(grown.where(F.col("length") + F.col("step") < most).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("length") + F.col("step")).alias("length"), "degree"))
        if not at.limit(1).count():
            break
    return out


def segments(edges: DataFrame) -> DataFrame:
    """(edge_id, segment): the maximal chains over vertices of degree 2, named by their least edge."""
    two = degrees(edges).where("degree = 2").select(F.col("key").alias("a"))
    chain = both_ways(edges).join(two, "a", "left_semi").select("a", "edge_id")
    pair = chain.groupBy("a").agg(F.min("edge_id").alias("k1"), F.max("edge_id").alias("k2")).where("k1 <> k2")
    linked = connected_components(pair.select(F.col("a").alias("edge_id"), "k1", "k2", F.lit(0.0).alias("length")))
    return edges.select("edge_id").join(linked, edges.edge_id == linked.key, "left").select("edge_id", F.coalesce("component", "edge_id").alias("segment"))


def ordered_segments(edges: DataFrame) -> DataFrame:
    """(edge_id, segment, place, k_from, k_to): each edge's place in its chain, from 0 on, and the direction in which the chain runs through it.

    A chain runs from the lesser of its ends; one that ends where it began (a cycle begins at its least vertex), from the end with the lesser edge.
    Places are found by pointer doubling: each directed edge knows how far back it has looked, and how far that one has in turn, so a
    chain of n edges takes log2(n) rounds.
    """
    both = both_ways(edges).select("edge_id", "a", "b")
    named = written(both.join(segments(edges), "edge_id"))
    inner = degrees(edges).where("degree = 2").select(F.col("key").alias("a"))
    # A cycle has no end: its least vertex becomes one.
    closed = named.join(inner.withColumn("two", F.lit(1)), "a", "left").groupBy("segment").agg(F.min("a").alias("a"), F.count_if(F.col("two").isNull()).alias("ends")).where("ends = 0")
    inner = inner.join(closed.select("a"), "a", "left_anti")
    arc = F.struct("edge_id", "a")
    back = named.select(F.col("b").alias("a"), F.col("edge_id").alias("before"), F.col("a").alias("before_a")).join(inner, "a")
    start = named.join(back, "a", "left").where("before is null or before <> edge_id")
    at = written(start.select(arc.alias("arc"), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("edge_id"), F.col("before_a").alias("a"))).alias("jump"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("place"), arc.alias("first")))
    while not at.where("jump is not null").isEmpty():
        far = at.select(F.col("arc").alias("jump"), F.col("jump").alias("next"), F.col("place").alias("more"), F.col("first").alias("its_first"))
        step = at.join(far, "jump", "left")
        moved = F.col("jump").isNotNull()
        # Where the one looked at has come to the chain's begin, so has this one.
        new = step.select("arc", F.when(moved, F.col("next")).alias("jump"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.when(moved, F.col("its_first")).otherwise(F.col("first")).alias("first"))
        before, at = at, written(new)
        forget(before)
    ranked = named.select(arc.alias("arc"), "edge_id", "a", "b", "segment").join(at, "arc")
    best = F.min(F.struct("first.a", "first.edge_id", "place", F.col("a").alias("k_from"), F.col("b").alias("k_to"))).alias("m")
    return ranked.groupBy("edge_id", "segment").agg(best).select("edge_id", "segment", "m.place", "m.k_from", "m.k_to")


def split_edges(vertices: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(edge_id, part, x1, y1, x2, y2, length): each edge in equal parts of at most ``most``."""
    a, b = (vertices.select(F.col("key").alias(k), F.col("x").alias(f"x{k[1]}"), F.col("y").alias(f"y{k[1]}")) for k in ("k1", "k2"))
    e = edges.join(a, "k1").join(b, "k2").withColumn("n", F.ceil(F.col("length") / most).cast("int"))
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    at = lambda u, v, k: F.col(u) + (F.col(v) - F.col(u)) * k / F.col("n")
    k, k1 = F.col("part"), F.col("part") + 1
    return e.select("edge_id", "part", at("x1", "x2", k).alias("x1"), at("y1", "y2", k).alias("y1"), at("x1", "x2", k1).alias("x2"), at("y1", "y2", k1).alias("y2"), (F.col("length") / F.col("n")).alias("length"))


def merge_nodes(nodes: DataFrame, tolerance: float) -> DataFrame:
    """(node_id, key): going through the nodes by id, each that is still free becomes a key and takes the free nodes within the tolerance.

    So keys are the first maximal set of nodes in order that are farther apart, and a node belongs to its first key. In a round, every free node that
    comes before all free nodes of its cell (as wide as the tolerance) and of those beside it becomes a key at once, and those near it are taken; as many
    rounds are needed as choices depend on one another. Nodes meet keys only, of which a cell holds a few, so no table has a row for each pair of nodes.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    beside = lambda df: df.select("*", steps.alias("s")).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    near = (F.col("x") - F.col("kx")) ** 2 + (F.col("y") - F.col("ky")) ** 2 <= tolerance * tolerance
    celled = written(nodes.select("node_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).where("cx is not null and cy is not null"))
    free, keys = celled, None
    while True:
        least = written(free.groupBy("cx", "cy").agg(F.min(F.struct("node_id", "x", "y")).alias("m")).select("cx", "cy", "m.*"))
        if least.isEmpty():
            forget(least)
            break
        first = beside(least).groupBy("cx", "cy").agg(F.min("node_id").alias("first"))
        new = written(least.join(first, ["cx", "cy"]).where("node_id = first").select(F.col("node_id").alias("key"), F.col("x").alias("kx"), F.col("y").alias("ky"), "cx", "cy"))
        forget(least)
        keys = new if keys is None else keys.unionAll(new)
        taken = beside(new).withColumnsRenamed({"cx": "tx", "cy": "ty"})
        rest = free.join(taken, (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty")) & ((F.col("node_id") == F.col("key")) | near), "left_anti")
        left, free = free, written(rest)
        if left is not celled:
            forget(left)
    forget(free)
    if keys is None:
        return nodes.select("node_id", F.col("node_id").alias("key"))
    # Nodes that are near no key (not even themselves, without a place) are keys themselves.
    found = celled.join(beside(keys), ["cx", "cy"]).where(near).groupBy("node_id").agg(F.min("key").alias("key"))
    return nodes.select("node_id").join(found.hint("merge"), "node_id", "left").select("node_id", F.coalesce("key", "node_id").alias("key"))


def from_lines(lines: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of polylines (line_id, seq, x, y): places within the tolerance are one vertex (``merge_nodes`` in the order in which they
    are first seen), which stands at its first place; loops and repeated edges are dropped."""
    nodes = written(lines.select("line_id", "seq", "x", "y"))
    places = nodes.groupBy("x", "y").agg(F.min(F.struct("line_id", "seq")).alias("seen"))  # equal places need no search
    places = written(running(places.select("x", "y", "seen"), ["seen"], "node_id").select("x", "y", "node_id"))
    keys = written(places.hint("merge").join(merge_nodes(places, tolerance), "node_id").select("x", "y", "node_id", "key"))
    vertices = keys.where("node_id = key").select("key", "x", "y")
    keyed = nodes.join(keys.select("x", "y", "key").hint("merge"), ["x", "y"])
    nxt = F.lead("key").over(W.partitionBy("line_id").orderBy("seq"))
    steps = keyed.select("key", nxt.alias("next")).where("next is not null and key <> next")
    ends = steps.select(F.least("key", "next").alias("k1"), F.greatest("key", "next").alias("k2")).distinct()
    a, b = (vertices.select(F.col("key").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("k1", "k2"))
    length = F.sqrt((F.col("xk1") - F.col("xk2")) ** 2 + (F.col("yk1") - F.col("yk2")) ** 2)
    return vertices, ends.join(a, "k1").join(b, "k2").select(F.xxhash64("k1", "k2").alias("edge_id"), "k1", "k2", length.alias("length"))


def from_paths(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of polylines (line_id, seq, x, y) that may cross without meeting: only a line's first and last corner are shared.

    Corners are numbered from 1 by (line_id, seq). A corner inside a line is a vertex of its own; an end is the first corner at exactly its
    place. A line of one corner gives a vertex, steps between equal vertices no edge; an edge has the number of the corner at which it begins.
    """
    corners = running(lines.select("line_id", "seq", "x", "y"), ["line_id", "seq"], "node_id")
    line = W.partitionBy("line_id")
    end = (F.col("seq") == F.min("seq").over(line)) | (F.col("seq") == F.max("seq").over(line))
    corners = written(corners.select("*", end.alias("end")))
    # Many lines may end at one place: the first corner comes from an aggregate.
    firsts = corners.groupBy("x", "y").agg(F.min("node_id").alias("first"))
    keyed = corners.join(firsts, ["x", "y"]).withColumn("key", F.when(F.col("end"), F.col("first")).otherwise(F.col("node_id")))
    keyed = written(keyed.select("line_id", "node_id", "x", "y", "key"))
    nxt = F.lead(F.struct("key", "x", "y")).over(line.orderBy("node_id"))
    steps = keyed.select(F.col("node_id").alias("edge_id"), F.col("key").alias("k1"), "x", "y", nxt.alias("n")).where("n is not null and k1 <> n.key")
    length = F.sqrt((F.col("x") - F.col("n.x")) ** 2 + (F.col("y") - F.col("n.y")) ** 2)
    edges = steps.select("edge_id", "k1", F.col("n.key").alias("k2"), length.alias("length"))
    return keyed.where("node_id = key").select("key", "x", "y"), edges


def reduce_chains(edges: DataFrame) -> DataFrame:
    """(edge_id, k1, k2, length): each chain over vertices of degree 2 as one edge between its ends; chains that close, or that would
    double an edge, stay as they are."""
    named = edges.join(segments(edges), "edge_id")
    ends = both_ways(named.select("edge_id", "k1", "k2", "length")).join(named.select("edge_id", "segment"), "edge_id")
    outer = ends.groupBy("segment", "a").agg(F.count("*").alias("n")).where("n = 1").groupBy("segment").agg(F.min("a").alias("u"), F.max("a").alias("v"), F.count("*").alias("n"))
    total = named.groupBy("segment").agg(F.sum("length").alias("length"))
    merged = outer.where("n = 2").join(total, "segment")
    same = W.partitionBy("u", "v")
    merged = merged.withColumn("twins", F.count("*").over(same)).where("twins = 1").select(F.col("segment").alias("edge_id"), F.col("u").alias("k1"), F.col("v").alias("k2"), "length")
    rest = named.join(merged.select(F.col("edge_id").alias("segment")), "segment", "left_anti").select("edge_id", "k1", "k2", "length")
    return merged.unionByName(rest)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON files of both tables."""
    vertices.select("key", "x", "y").write.json(f"{path}/vertices")
    edges.select("edge_id", "k1", "k2", "length").write.json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema("key long, x double, y double").json(f"{path}/vertices"),
        spark.read.schema("edge_id long, k1 long, k2 long, length double").json(f"{path}/edges"),
    )
