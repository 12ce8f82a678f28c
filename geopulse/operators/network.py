"""Hotspots on street networks, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.kernels import triangle_integral
from geopulse.functions.tables import running, scratch, written
from geopulse.operators import geometry
from geopulse.operators.graph import both_ways, degrees


def edge_segments(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(segment_id, x1, y1, x2, y2, k1, k2, length): edges with their ends' places."""
    a = vertices.select(F.col("key").alias("k1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select(F.col("key").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "k1").join(b, "k2").select(F.col("edge_id").alias("segment_id"), "x1", "y1", "x2", "y2", "k1", "k2", "length")


def network_points(points: DataFrame, vertices: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(event_id, edge_id, t): events on their nearest edge within the radius."""
    return geometry.project(points, edge_segments(vertices, edges), radius).select("event_id", F.col("segment_id").alias("edge_id"), "t")


def network_hotspot(events: DataFrame, edges: DataFrame, bandwidth: float, weight: Column | None = None) -> DataFrame:
    """(edge_id, risk): the triangle kernel spread from each event along all simple paths, split evenly at junctions.

    events: (event_id, edge_id, t, ...). Walks grow by one edge a round and end at the bandwidth, so there
    are as many rounds as edges fit in it; a round's walks are joined with the edges by vertex.
    """
    w = F.lit(1.0) if weight is None else weight
    start = events.join(edges, "edge_id").withColumn("w", w)
    there, back = F.col("length") * (1 - F.col("t")), F.col("length") * F.col("t")
    own = start.select("edge_id", (triangle_integral(F.lit(0.0), there, bandwidth) + triangle_integral(F.lit(0.0), back, bandwidth)).alias("v"), "w", "length")
    parts = own.select("edge_id", (F.col("w") * F.col("v") / F.col("length")).alias("risk"))
    at = start.select(F.array("k1", "k2").alias("path"), F.col("k2").alias("at"), there.alias("d"), "w").unionAll(start.select(F.array("k2", "k1").alias("path"), F.col("k1").alias("at"), back.alias("d"), "w"))
    at = at.where(F.col("d") < bandwidth).groupBy("path", "at", "d").agg(F.sum("w").alias("w"))
    ways = both_ways(edges).join(degrees(edges).select(F.col("key").alias("a"), F.greatest(F.col("degree") - 1, F.lit(1)).alias("split")), "a")
    while True:
        # The edges at the walk's end, other than those to vertices that it has passed.
        grown = at.join(ways, at.at == ways.a).where(~F.array_contains("path", F.col("b"))).withColumn("w", F.col("w") / F.col("split"))
        grown = written(grown.select("edge_id", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), "d", "w", "length"))
        if not grown.limit(1).count():
            break
        v = triangle_integral(F.col("d"), F.col("d") + F.col("length"), bandwidth)
        parts = parts.unionAll(grown.select("edge_id", (F.col("w") * v / F.col("length")).alias("risk")))
        at = grown.withColumn("d", F.col("d") + F.col("length")).where(F.col("d") < bandwidth).select("path", "at", "d", "w")
    return edges.select("edge_id").join(parts.groupBy("edge_id").agg(F.sum("risk").alias("risk")), "edge_id", "left").fillna(0.0, ["risk"])


def path_index(edges: DataFrame, length: float) -> DataFrame:
    """(edge_id, at_end, to_edge, d, w): every edge that simple paths from either end of an edge (at_end: k2) enter within the length, at the distance d
    from that end, with the sum w of the shares that come there. It serves all bandwidths up to the length (``network_hotspot_indexed``)."""
    both = edges.select("edge_id", F.lit(True).alias("at_end"), F.array("k1", "k2").alias("path"), F.col("k2").alias("at")).unionAll(edges.select("edge_id", F.lit(False), F.array("k2", "k1"), F.col("k1")))
    at = both.select("*", F.lit(0.0).alias("d"), F.lit(1.0).alias("w"))
    ways = both_ways(edges).withColumnRenamed("edge_id", "to_edge").join(degrees(edges).select(F.col("key").alias("a"), F.greatest(F.col("degree") - 1, F.lit(1)).alias("split")), "a")
    out = None
    while True:
        grown = at.join(ways, at.at == ways.a).where(~F.array_contains("path", F.col("b"))).withColumn("w", F.col("w") / F.col("split"))
        grown = written(grown.select("edge_id", "at_end", "to_edge", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), "d", "w", "length"))
        rows = grown.select("edge_id", "at_end", "to_edge", "d", "w")
        out = rows if out is None else out.unionAll(rows)
        if grown.isEmpty():
            return out.groupBy("edge_id", "at_end", "to_edge", "d").agg(F.sum("w").alias("w"))
        at = grown.withColumn("d", F.col("d") + F.col("length")).where(F.col("d") < length).select("edge_id", "at_end", "path", "at", "d", "w")


def graph_version(edges: DataFrame) -> str:
    """A name for the edges' content, whatever their order."""
    h = edges.agg(F.sum(F.xxhash64("edge_id", "k1", "k2", "length").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).head()
    return f"{h.n}-{h.h or 0}"


def saved_path_index(edges: DataFrame, length: float, folder: str) -> DataFrame:
    """``path_index`` from the folder, where it is made once for each version of the graph and length."""
    spark = edges.sparkSession
    path = f"{folder}/{graph_version(edges)}-{length!r}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        with scratch():
            path_index(edges, length).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def network_hotspot_indexed(events: DataFrame, edges: DataFrame, index: DataFrame, bandwidth: float) -> DataFrame:
    """``network_hotspot`` by one join with a path index at least as long as the bandwidth."""
    start = events.join(edges, "edge_id")
    there, back = F.col("length") * (1 - F.col("t")), F.col("length") * F.col("t")
    own = start.select("edge_id", ((triangle_integral(F.lit(0.0), there, bandwidth) + triangle_integral(F.lit(0.0), back, bandwidth)) / F.col("length")).alias("risk"))
    tips = start.select("edge_id", F.lit(True).alias("at_end"), there.alias("own")).unionAll(start.select("edge_id", F.lit(False), back))
    # Events at one place weigh together.
    tips = tips.where(F.col("own") < bandwidth).groupBy("edge_id", "at_end", "own").agg(F.count("*").alias("n"))
    reached = tips.join(index, ["edge_id", "at_end"]).withColumn("d", F.col("own") + F.col("d")).where(F.col("d") < bandwidth)
    reached = reached.join(edges.select(F.col("edge_id").alias("to_edge"), "length"), "to_edge")
    v = F.col("n") * F.col("w") * triangle_integral(F.col("d"), F.col("d") + F.col("length"), bandwidth) / F.col("length")
    parts = own.unionAll(reached.select("to_edge", v))
    return edges.select("edge_id").join(parts.groupBy("edge_id").agg(F.sum("risk").alias("risk")), "edge_id", "left").fillna(0.0, ["risk"])


def ranked_lengths(risks: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, length, upto, all): the length of the edges up to each, by falling risk and id, and of all."""
    joined = risks.select("edge_id", "risk").join(edges.select("edge_id", "length"), "edge_id")
    return running(joined, [F.desc("risk"), "edge_id"], "upto", "length").drop("risk").join(F.broadcast(joined.agg(F.sum("length").alias("all"))))


def coverage(risks: DataFrame, edges: DataFrame, fraction: float, crossing: bool = False) -> DataFrame:
    """(edge_id): edges by falling risk, ties by id, up to the fraction of the total length; ``crossing`` keeps the edge that crosses it."""
    run = ranked_lengths(risks, edges)
    before = F.col("upto") - F.col("length") if crossing else F.col("upto")
    return run.where((before < F.col("all") * fraction) if crossing else (before <= F.col("all") * fraction)).select("edge_id")


def network_hit_rate(events: DataFrame, covered: DataFrame) -> DataFrame:
    """(hits, total, rate): events on covered edges, rate -1 without events."""
    hit = covered.select("edge_id").distinct().withColumn("hit", F.lit(1))
    s = events.join(hit, "edge_id", "left").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("total"))
    return s.select("hits", "total", F.when(F.col("total") == 0, -1.0).otherwise(F.try_divide("hits", "total")).alias("rate"))


def grid_risk_to_edges(surface: DataFrame, grid: GridSpec, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, risk): the risk of the cell that holds the longest part of the edge, 0 off the grid."""
    main = geometry.segment_main_cell(edge_segments(vertices, edges), grid)
    return main.join(surface.select("gx", "gy", "risk"), ["gx", "gy"], "left").select(F.col("segment_id").alias("edge_id"), F.coalesce("risk", F.lit(0.0)).alias("risk"))


def grid_risk_subdivided(surface: DataFrame, grid: GridSpec, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, part, x1, y1, x2, y2, length, risk): each edge cut where it goes from cell to cell, each part with its cell's risk, 0 off the grid."""
    segments = edge_segments(vertices, edges)
    parts = geometry.segment_cells(segments, grid).join(surface.select("gx", "gy", "risk"), ["gx", "gy"], "left").join(segments, "segment_id")
    order = W.partitionBy("segment_id").orderBy("t1", "gx", "gy")
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(t)
    return parts.select(
        F.col("segment_id").alias("edge_id"), F.row_number().over(order).alias("part"), at("x", "t1").alias("x1"), at("y", "t1").alias("y1"),
        at("x", "t2").alias("x2"), at("y", "t2").alias("y2"), ((F.col("t2") - F.col("t1")) * F.col("length")).alias("length"), F.coalesce("risk", F.lit(0.0)).alias("risk"),
    )


def network_log_likelihood(risks: DataFrame, events: DataFrame) -> DataFrame:
    """Sum of ln risk at the events; -27.6 where it is 0."""
    ln = F.when(F.col("risk") > 0, F.ln(F.when(F.col("risk") > 0, F.col("risk")))).otherwise(-27.6)
    return events.join(risks, "edge_id").agg(F.sum(ln).alias("likelihood"))


def network_hotspot_shortest(events: DataFrame, edges: DataFrame, bandwidth: float) -> DataFrame:
    """(edge_id, risk): as ``network_hotspot``, but along the shortest path to each vertex only, so the work doesn't grow with the number of paths.

    Rounds of relaxation keep one row for each event and vertex: the least distance, and the split on the way there. The n events at one place of an edge
    count as one. Joins of such rows are sorted, as written tables are small as files, but not as rows to broadcast.
    """
    start = events.groupBy("edge_id", "t").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).join(edges, "edge_id")
    there, back = F.col("length") * (1 - F.col("t")), F.col("length") * F.col("t")
    own = start.select("edge_id", (F.col("n") * (triangle_integral(F.lit(0.0), there, bandwidth) + triangle_integral(F.lit(0.0), back, bandwidth)) / F.col("length")).alias("risk"))
    ways = both_ways(edges).join(degrees(edges).select(F.col("key").alias("a"), F.greatest(F.col("degree") - 1, F.lit(1)).cast("double").alias("split")), "a")
    ends = start.select("event_id", F.col("edge_id").alias("via"), F.col("k2").alias("at"), there.alias("d"), "n").unionAll(start.select("event_id", F.col("edge_id").alias("via"), F.col("k1").alias("at"), back.alias("d"), "n"))
    row = F.struct("d", "via", "w", "n")
    known = ends.where(F.col("d") < bandwidth).withColumn("w", F.lit(1.0)).groupBy("event_id", "at").agg(F.min(row).alias("m")).select("event_id", "at", "m.*")
    known = frontier = written(known)
    while True:
        new = frontier.join(ways, (frontier.at == ways.a) & (frontier.via != ways.edge_id))
        new = new.select("event_id", F.col("b").alias("at"), (F.col("d") + F.col("length")).alias("d"), F.col("edge_id").alias("via"), (F.col("w") / F.col("split")).alias("w"), "n").where(F.col("d") < bandwidth)
        best = new.groupBy("event_id", "at").agg(F.min(row).alias("m")).select("event_id", "at", "m.*")
        old = known.select("event_id", "at", F.col("d").alias("old"))
        frontier = written(best.join(old.hint("merge"), ["event_id", "at"], "left").where("old is null or d < old").drop("old"))
        if not frontier.limit(1).count():
            break
        known = written(known.unionByName(frontier).groupBy("event_id", "at").agg(F.min(row).alias("m")).select("event_id", "at", "m.*"))
    # From each vertex into the edges that its shortest path didn't come by.
    onward = known.join(ways, (known.at == ways.a) & (known.via != ways.edge_id))
    v = triangle_integral(F.col("d"), F.col("d") + F.col("length"), bandwidth)
    parts = own.unionAll(onward.select("edge_id", (F.col("n") * F.col("w") / F.col("split") * v / F.col("length")).alias("risk")))
    return edges.select("edge_id").join(parts.groupBy("edge_id").agg(F.sum("risk").alias("risk")), "edge_id", "left").fillna(0.0, ["risk"])


def covered_edges(covered: DataFrame, grid: GridSpec, vertices: DataFrame, edges: DataFrame, least: float | None = None) -> DataFrame:
    """(edge_id): edges that meet covered cells (gx, gy), with at least the fraction ``least`` of their length in them."""
    parts = geometry.segment_cells(edge_segments(vertices, edges), grid).join(covered.select("gx", "gy").distinct(), ["gx", "gy"])
    inside = parts.groupBy(F.col("segment_id").alias("edge_id")).agg(F.sum(F.col("t2") - F.col("t1")).alias("part"))
    return inside.where(F.col("part") >= (least or 0.0)).select("edge_id")


def hit_counts_by_coverage(events: DataFrame, risks: DataFrame, edges: DataFrame, percentages: list[int]) -> DataFrame:
    """(coverage, hits, total, rate in percent) for network coverages, from one ranking of the edges."""
    counts = events.groupBy("edge_id").agg(F.count("*").alias("n"))
    run = ranked_lengths(risks, edges).join(counts, "edge_id", "left").select("upto", "all", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array(*map(F.lit, percentages))).alias("coverage"))
    hits = run.groupBy("coverage").agg(F.sum(F.when(F.col("upto") <= F.col("all") * (F.col("coverage") / 100), F.col("n")).otherwise(0)).alias("hits"))
    return hits.join(F.broadcast(events.agg(F.count("*").alias("total")))).select("coverage", "hits", "total", F.try_divide(F.col("hits") * 100, "total").alias("rate"))
