"""Connected components of a graph given as edges, by large-star and small-star rounds.

Each round is a few joins and aggregations over edges; it leaves no more edges than before plus one for each vertex,
and the number of rounds grows with the logarithm of the longest path. The graph is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.session import materialize

#: Parts into which the edges that lead to one vertex are dealt.
SALTS = 16


def connected_components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): for each vertex of edges (u, v) the smallest vertex of its component.

    Vertices may be of any ordered type. Loops give a vertex of its own; repeated edges count once; an edge with a
    null end is left out; no edges give no rows. RuntimeError if most_rounds don't suffice.
    """
    given = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(given, tag)
    loops, now_edges = now.where("u = v"), now.where("u > v")
    for _ in range(most_rounds):
        # Large star: an edge to a vertex goes to the least of that vertex's neighbourhood instead. A vertex that many
        # edges lead to is salted; it has one least neighbour, so only that row is repeated.
        least = now_edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
        salted = now_edges.withColumn("own_salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = salted.join(least, (F.col("v") == F.col("x")) & (F.col("own_salt") == F.col("salt")), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # Small star: a vertex and its smaller neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u > v").distinct()
        now_edges = materialize(small, tag)
        rows, vertices = now_edges.agg(F.count("*"), F.count_distinct("u")).first()
        # Settled when every edge leads to a root: one edge from each vertex, none from a vertex that others lead to.
        if rows == vertices and now_edges.join(now_edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now_edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    linked = now_edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root")).join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(alone)
