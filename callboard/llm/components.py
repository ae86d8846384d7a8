"""Connected components of a graph given as links, by alternating stars.

Each round points the greater neighbours of every node to its least neighbour (large star), then
the lesser ones (small star); the links end as stars around the least node of each component after
a number of rounds that grows with the logarithm of its size. Each round is written to the shared
folder and the one before removed, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(links: DataFrame) -> DataFrame:
    """Join every link (u, v) to the least of u and its neighbours."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return _star(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    starred = _star(down)
    moved = starred.where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = starred.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node reachable.

    ``links`` has whole-number columns a and b. Null ends and links of a node to itself are
    passed over; repeated and turned links count once.
    """
    clean = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = written(clean.distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = state
        after = written(_small(_large(now).distinct()).distinct(), "links")
        discard(now)
        now = after
