"""Connected components of a table of links, by alternating large-star and
small-star steps until every component is a star.

Every step is a partial minimum per node and a join that Spark can split for
a node with very many links; the links are written down after each step, so a
lost executor costs a re-read.  The driver gets a yes or no per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import cut


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m): the lowest ``v`` of every ``u``."""
    return cut(links.groupBy("u").agg(F.min("v").alias("m")))


def _is_forest(links: DataFrame) -> bool:
    """Every node has one link, to a node that has none: each component is a star
    around its smallest node."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("to")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("to")))).alias("e"))
    most = F.max(F.col("out") + F.col("to"))
    return (ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.max("e.to").alias("to"))
            .agg(most.alias("most")).first()["most"] or 0) <= 1


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a
    link.  ``links`` has two columns of integers, in any order, repeats allowed."""
    a, b = links.columns
    now = cut(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a row per link at most, so repeats can stay until the end of the round
        large = cut(both.join(_lowest(both), "u").where("v > u")
                    .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        lowest = _lowest(large)
        small = large.join(lowest, "u").where("v != m").select("v", "m")
        now = cut(small.toDF("u", "v").unionByName(lowest.toDF("u", "v")).distinct())
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))
                             .distinct())
