"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id reachable. Links may repeat and stand in either order.

    Each round joins the links with one minimum per id, so a hub with a large share of all links is split
    by the adaptive join; nothing gathers a hub's links in one place.
    """

    def hang(edges: DataFrame, both: bool) -> DataFrame:
        """Hangs neighbours on each id's least neighbour: the larger ones (both), or the smaller ones and the id itself."""
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            pairs = pairs.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.write(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        joined = pairs.join(least, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        written = scratch.write(out.where("a <> b").distinct())
        scratch.drop(least)
        return written

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    while True:
        large = hang(edges, True)
        small = hang(large, False)
        scratch.drop(edges, large)
        edges, after = small, mark(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
