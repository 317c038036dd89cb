"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinicframe.session import ensure_checkpoint_dir


def _stars(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): every v that is larger than the least of u's neighbours and u, with that least one."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) from links (a, b) of longs: for each node that is linked with another the smallest node it reaches.

    Each round shortens all paths and is checkpointed; a node with very many links is one
    row of a grouping and, on the other side of the join, rows that can be split. The
    driver sees one count and one checksum a round.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().checkpoint()
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
        both = edges.union(edges.select("v", "u"))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = small.distinct().checkpoint()
