"""Connected components of a graph that is given as pairs, by alternating star contraction.

Each round hangs every node's larger neighbours, then its smaller ones, under the least node it
sees (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). The pairs end as stars
around the least node of each component. A node's neighbours are never gathered: their least is an
aggregate, and the join that hands it out has one row for each node on one side, so Spark can split
the other side where a node has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.shared import materialize


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Pairs come with u > v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` has columns u and v of one ordered type. Gives node and component - the least node
    that it reaches - for every node with a link to another. Loops and repeats do no harm; links
    with a null are no links; no links give no rows."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = materialize(pairs, "links"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        pairs = materialize(_small_star(_large_star(pairs)), "links")
