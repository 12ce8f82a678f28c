"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import checkpointed, drop_table


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Columns v and label, the least vertex reachable from v, for each vertex of edges(a, b).

    By contraction: each vertex goes over to its least neighbour's least neighbour (if that is less
    than itself), edges are renamed accordingly, loops and doubles go, until no edge is left. Stars and
    cliques vanish in one or two rounds. The edges of a vertex meet in aggregates with partial sums, and
    in joins of two plain exchanges, which Spark splits where a vertex has very many edges. Each round
    is a written table; only a count comes to the driver. rows: about how many edges there are at most.
    """
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct(), rows)
    rows = edges.count()
    moved: list[DataFrame] = []
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("p")), rows)
        over = up.select(F.col("v").alias("u"), F.col("p").alias("q"))
        step = checkpointed(up.join(over, up.p == over.u).select("v", F.col("q").alias("p")), rows)
        drop_table(up)
        moved.append(step)
        one, two = step.select(F.col("v").alias("a"), F.col("p").alias("x")), step.select(F.col("v").alias("b"), F.col("p").alias("y"))
        left = edges.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        before, edges = edges, checkpointed(left.distinct(), rows)
        drop_table(before)
        if edges.isEmpty():
            break
    drop_table(edges)
    labels = moved[0]
    for step in moved[1:]:
        over = step.select(F.col("v").alias("u"), F.col("p").alias("q"))
        labels = checkpointed(labels.join(over, labels.p == over.u, "left").select("v", F.coalesce("q", "p").alias("p")), rows)
    for step in moved:
        if step is not labels:
            drop_table(step)
    return labels.select("v", F.col("p").alias("label"))
