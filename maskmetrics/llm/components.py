"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_files, materialise


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: two equal edge sets agree in both."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(u long, v long)``; the component is its smallest node.

    Alternating large-star and small-star steps halve the distance to the smallest node; each
    step is one partial aggregation and one equi-join, and its edge set is written to the
    shared folder, so a lost executor costs one step.  Links of a node with itself and
    repeated links are allowed; links with a null end are ignored; no links give no rows.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges, "links")
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        was, mark = mark, _mark(edges)
        drop_files(done)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
