"""Connected components of links, by star steps over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import materialize, remove


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` that isn't its component's smallest (signed) number.

    Large-star and small-star steps in turn, each over tables in the shared folder, until a round changes nothing. Links may
    repeat or join a node with itself; without links there are no rows.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    measure = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    state = measure(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        # A table, so that both sides of the join are plain exchanges, which Spark splits where a node has many links.
        low = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        remove(spark, low)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(spark, edges, large)
        edges, before, state = new, state, measure(new)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
