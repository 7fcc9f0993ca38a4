"""Connected components of a link table: alternating star contraction.

Every round hangs the larger ends of a vertex's links on the smallest vertex it
sees, then the smaller ones, so that stars form in about log(n) rounds. Each
round is two aggregations with map-side minimum and two joins back, staged as
Parquet; the driver only sees a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges``: (u, v), u > v, distinct."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, stage: Stage, name: str) -> DataFrame:
    """(vertex, component): for every vertex that has a link, the smallest vertex
    reachable from it. Self links and repeated links do no harm."""
    e = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stage.put(e, f"{name}-0")
    seen, i = None, 0
    while True:
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.max("v")).first()
        if state == seen or state[0] == 0:
            break
        seen, i = state, i + 1
        e = stage.put(_star(_star(e, True), False), f"{name}-{i}")
        stage.drop(f"{name}-{i - 1}")
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
