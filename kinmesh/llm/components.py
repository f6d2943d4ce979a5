"""Connected components of a pair table by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.operators.skew import skew_join
from kinmesh.session import cut


def _largest_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Connects the neighbours of every node with the least node of its neighbourhood.

    ``both``: large-star (a node's larger neighbours); else small-star (a node and its smaller neighbours). The least
    neighbour is a combined aggregate; it meets the edges again in a join that keeps hubs whole but spread.
    """
    if both:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return skew_join(seen.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = skew_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.unionByName(least.select("a", F.col("m").alias("b")))


def components(pairs: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): every node of a pair of two different nodes, with the least node reachable from it.

    Pairs may come in either order and repeatedly; pairs with a null end and pairs of a node with itself link nothing, so
    a node that has only such pairs is left out. An empty table gives no rows. Each round is checkpointed; the loop ends
    when a round changes no edge, and raises if ``most_rounds`` rounds did not suffice.
    """
    given = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut(_largest_first(given))
    mark = None
    for _ in range(most_rounds):
        edges = cut(_largest_first(_star(cut(_largest_first(_star(edges, True))), False)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def key_links(df: DataFrame, node: str, key: str) -> DataFrame:
    """Pairs that join all nodes of one key: each node with the least of its key, a star instead of all pairs. Null keys link nothing."""
    rows = df.select(F.col(node).alias("a"), F.col(key).alias("k")).where("a IS NOT NULL AND k IS NOT NULL").distinct()
    least = rows.groupBy("k").agg(F.min("a").alias("b"))
    return skew_join(rows, least, "k").select("a", "b").where("a <> b")
