"""Connected components of links, by rounds of joins; no links or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of longs -> (id, component): the smallest id that is reachable, for each id in a link.

    Alternates large-star and small-star rounds. Both only aggregate and join by id, so a node with very many links
    is pre-aggregated, and its side of the join is one that Spark may split. Null ends and self-links are left out;
    repeated links count once. An empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds):
        stars = _small(_large(edges))
        after_edges = cut(stars, "links")
        after = _state(after_edges)
        drop_cut(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: links did not settle")
    # settled: each edge is (node, root)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its smallest neighbour (or itself)."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
    return both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
