"""Connected components by alternating large-star and small-star steps; the steps' edges are tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's larger (or all its smaller) neighbours to its least neighbour."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    w = Window.partitionBy("u")
    m = both.withColumn("m", F.least(F.min("v").over(w), F.col("u")))
    if large:
        out = m.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = m.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(m.select("u", F.col("m").alias("v")).where("u <> v"))
    return out.distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component): the least node that each node of the edges is connected with. Nulls and loops are left out."""
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"{u} is not null and {v} is not null and {u} <> {v}").distinct()
    e = cut(e, "edges")
    before = None
    while True:
        new = cut(_star(_star(e, True), False), "edges")
        drop_cut(e)
        e = new
        # at the fixed point every node hangs on its root, and the sums don't change
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
