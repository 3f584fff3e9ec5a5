"""Connected components by alternating stars (Kiveris et al., 2014), in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import shared_table


def _hook(pairs: DataFrame, smaller: bool) -> DataFrame:
    """Each node's neighbours (above it, or itself and those below) point to its smallest one."""
    if smaller:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = pairs.select("u", "v").unionByName(
            pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = shared_table(
        around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")),
        "star-centres")
    near = around.join(least, "u")
    if smaller:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    else:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link; the label is the component's smallest node.

    ``links`` has two columns of a sortable type. Self-links and repeated links are allowed and
    rows with a null are left out. The number of rounds grows with the logarithm of the nodes.
    """
    a, b = links.columns
    pairs = shared_table(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "links")
    while True:
        pairs = shared_table(_hook(pairs, smaller=False), "stars")
        pairs = shared_table(_hook(pairs, smaller=True), "stars")
        # done when no node points to two others, or is pointed to while pointing on
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(
            pairs.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if seen.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty():
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(
        stars.select(F.col("label").alias("node"), "label").distinct())
