"""Never-seen ids as intervals.

An id below the largest one that no tuple carries is still a value of its dimension.
There may be 10^12 of them, so they are kept as the gaps between the seen ids, at
most one more than those, and written out one by one only where a user asks for it.

The gaps come from the sorted ids: range partitions, a window inside each, and the
largest id of the partition before from a broadcast table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize
from .profile import value_masses

STEP = 1 << 16  # ids that one row is expanded to at a time


def unseen_ranges(values: DataFrame, card: int, partitions: int | None = None) -> DataFrame:
    """(from, to): the maximal intervals of 0..card-1 without an id of ``values`` (one
    distinct column ``value``)."""
    spark = values.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = spark.createDataFrame([(-1,), (int(card),)], "value long")  # borders before the first and after the last id
    ranged = materialize(values.select("value").unionByName(ends).repartitionByRange(parts, "value").withColumn("pid", F.spark_partition_id()))
    last = ranged.groupBy("pid").agg(F.max("value").alias("last"))
    order = Window.orderBy("pid")  # a row for each partition
    last = last.select("pid", F.lag("last").over(order).alias("last"))
    inside = F.lag("value").over(Window.partitionBy("pid").orderBy("value"))
    gaps = ranged.withColumn("before", inside).join(F.broadcast(last), "pid")
    before = F.coalesce("before", "last")
    return gaps.where(F.col("value") - before > 1).select((before + 1).alias("from"), (F.col("value") - 1).alias("to"))


def expand(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, value): every id of the intervals, STEP at a time so that no row holds a long list."""
    starts = ranges.select(*keys, "to", F.explode(F.sequence("from", "to", F.lit(STEP).cast("long"))).alias("start"))
    return starts.select(*keys, F.explode(F.sequence("start", F.least(F.col("start") + (STEP - 1), F.col("to")))).alias("value"))


def value_mass_ranges(df: DataFrame, n_dims: int, cards: tuple[int, ...]) -> DataFrame:
    """(mode, from, to, mass): every seen value with its mass, and the never-seen ids as intervals
    of mass 0. The intervals of a dimension add up to its cardinality."""
    seen = value_masses(df, n_dims)
    out = seen.select("mode", F.col("value").alias("from"), F.col("value").alias("to"), "mass")
    for m, c in enumerate(cards):
        gaps = unseen_ranges(seen.where(F.col("mode") == m).select("value"), c)
        out = out.unionByName(gaps.select(F.lit(m).alias("mode"), "from", "to", F.lit(0).cast("long").alias("mass")))
    return out
