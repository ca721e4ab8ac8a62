"""Connected components of a table of links, by alternating large and small stars.

Each step replaces every node's links by links to the least node among its neighbours; a large star passes it to the
greater neighbours, a small star to the others. Least neighbours are found by aggregation, which combines before it
shuffles, so a node with very many links is no hot task. The links stay distributed; only a count and a checksum reach
the driver, to see whether a round changed anything. Each round is cut from its lineage by a written table,
which goes when the next one is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v, distinct. Every node's neighbours get its least neighbour (or itself) as theirs."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (u, v) but the roots themselves."""
    now = store.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    seen = None
    while True:
        old, now = now, store.written(_star(_star(now, True), False), "stars")
        store.drop_written(old)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == seen or not state[0]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._written_to = now._written_to
            return out
        seen = tuple(state)
