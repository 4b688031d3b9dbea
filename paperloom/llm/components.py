"""Connected components of links, as rounds of joins and sums over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import written


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _to_smallest(links: DataFrame) -> DataFrame:
    """Each ``u``'s links with the smallest end that ``u`` has a link to."""
    smallest = links.groupBy(F.col("u").alias("s_u")).agg(F.min("v").alias("m"))
    return links.join(smallest, F.col("u") == F.col("s_u")).select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and is not its component's smallest node.

    Links are pairs (u, v) of one ordered type, in any direction; nulls and loops are ignored.
    Each round hangs every node's larger neighbours on its smallest one and then does the same
    for the smaller neighbours; the rounds needed grow with the logarithm of the longest chain.
    A node with many links is one key of a join that Spark may split, never a group.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    links = written(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(*pair).distinct(), "links")
    before = None
    while (now := _signature(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "links")
        small = _to_smallest(large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        links = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
