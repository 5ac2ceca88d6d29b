"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, str | None]:
    """From edges (u, v) to (u, v) with v the smallest node of u's component, for every u but those smallest.

    Large star: every node links its larger neighbours to its smallest neighbour; small star: it links
    itself and its smaller neighbours to the smallest. Both keep components and shorten paths; edges
    stay as many as they were at most. Each round ends in a written table; none depends on the
    driver but for whether the edges are stars already. The second value is the path of that table.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    while not star(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(spark, path)
        path = new
    return now, path


def star(edges: DataFrame) -> bool:
    """Whether every node has at most one smaller neighbour and that has none."""
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
    return not chained and not edges.groupBy("u").count().filter("count > 1").limit(1).count()
