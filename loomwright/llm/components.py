"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate and a join on the larger and smaller ends of links, so a node
with very many links is combined before it is shuffled. In the large-star step, where a node with many
links sends to all of them, both sides of the join are exchanged anew, so AQE can split such a node's
rows. Links never reach the driver: a step reports two sums. Each round is written to the shared folder
and the round before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import store


def _lowest(links: DataFrame) -> DataFrame:
    """Lowest neighbour of each node, itself included."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to u's lowest neighbour."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Read from storage, the lowest neighbours are not partitioned by u, as they would be straight from the aggregate.
    out = both.where(F.col("v") > F.col("u")).join(store.materialize(_lowest(both), "lowest"), "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the lowest of them."""
    low = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(low)
    out = low.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionAll(lowest.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Returns (u, v): each linked node that isn't the smallest of its component, with that smallest node.

    ``links`` has two long columns u and v; their order, repeats and loops don't matter.
    """
    spark = links.sparkSession
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")
    schema = links.schema
    # A round reads its links more than once; what finds them runs once.
    path, before = store.save(links, "links"), None
    links = spark.read.schema(schema).parquet(path)
    for _ in range(max_rounds):
        after = store.save(_small_star(_large_star(links)), "links")
        links = spark.read.schema(schema).parquet(after)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(spark, path)
        path = after
        if now == before:
            return links
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
