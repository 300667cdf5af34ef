"""Connected components of links, in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.stored import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that it is connected with.

    Rounds of two steps on the links alone: each node's larger neighbours move
    to its smallest neighbour, then its smaller ones do. The links turn into
    stars around the smallest ids in a number of rounds that grows with the
    logarithm of the component's size. Each round is written to the shared
    folder. Both sides of each join are written tables,
    so adaptive execution can split a hub's rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def smallest_ids(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component_id) for every row of ``classes`` (key, low): the smallest ``low`` that ``links`` (a, b) of keys reach."""
    found = written(components(links), "components")
    both = found.join(classes, F.col("id") == F.col("key"))
    least = both.groupBy("component").agg(F.min("low").alias("least"))
    linked = found.join(written(least, "least"), "component").select("id", "least")
    return classes.join(linked, F.col("id") == F.col("key"), "left").select("key", F.coalesce("least", "low").alias("component_id"))
