"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node tells its larger (or its not larger) neighbours the least node among its neighbours and itself.

    The plan reads edges twice: the driver plans every copy of what it is made of, and two steps stand in one plan.
    """
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    near = edges.select(F.explode(ways).alias("e")).select("e.*")
    near = near if large else near.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    told = (near.where("v > u") if large else near).join(least, "u")
    if large:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether edges (u, v), all with v < u, are more than stars: some node has two smaller neighbours, or a smaller and a larger one."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    of_node = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return of_node.agg(F.count_if((F.col("below") > 0) & (F.col("below") + F.col("above") > 1))).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): the least node that each can reach.

    A hub costs one partial minimum and rows that a join can split, never a
    list of its neighbours. Each step is written to the shared folder; steps
    end when the edges are stars around their least nodes, which no step
    changes. Self-edges, repeated edges and edges with a null end add nothing;
    no edges give no rows.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _open(now):
        last, now = now, common.written(_star(_star(now, True), False), "stars")
        common.dropped(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
