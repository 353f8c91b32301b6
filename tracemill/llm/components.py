"""Connected components by distributed union-find: every node points to a smaller one until it points to its root.

Each round hangs, for every node, its larger neighbours and then its smaller ones (itself included) below the
smallest of them. Links between nodes that met before collapse, so the number of rounds follows
the logarithm of the longest chain. The smallest neighbour is found with a map-side minimum, and
joined back by a join that Spark may split where a node has very many links, so no component is
ever held by one task. Each round is stored in the shared folder.

Defined results: null ends and links to oneself are ignored; repeated links count once; no links, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with v < u. Large: larger neighbours of a node to its least one; small: smaller ones."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component."""
    links = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = stored(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        last, links = links, stored(_star(_star(links, True).distinct(), False).distinct(), "links")
        release(last)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
