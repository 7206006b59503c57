"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

Edges stay in Spark; each round is an aggregation and a join on narrow rows, written
to the shared folder. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import discard, write_table


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to (u, v) the least of u and its neighbours v."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _with_least(down)
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node below another has one edge, to a node that is below none."""
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(True).alias("below"))
    up = edges.select(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("to"), F.lit(False).alias("below"))
    nodes = down.unionByName(up).groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.bool_or("below").alias("x"), F.bool_and("below").alias("y"))
    return nodes.where("a <> b or x <> y").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one orderable type. Returns node, root (the least node of the
    component) for every node that is not its own root."""
    spark = edges.sparkSession
    now, path = write_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        last = path
        now, path = write_table(_round(now), "edges")
        discard(spark, last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
