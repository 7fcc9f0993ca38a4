"""Dictionary encoding of non-integer dimensions to dense ids 0..d-1.

Ids follow the sort order of the keys. The distinct keys are range-partitioned
and sorted, each partition numbers its own keys, and the number of keys in the
partitions before it, from a joined table of one row per partition, makes the
ids global. No step gathers the keys into one task.

A null key has no id: the tuple keeps a null, which the profile counts as
invalid (``failfast``) or leaves out with that count (``drop``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize

# A dictionary is broadcast up to this size (keys and ids, measured).
BROADCAST_BYTES = 32 << 20
# Keys of at least 1 / HOT of the rows (so at most HOT of them) and at most HOT_BYTES
# are encoded by a broadcast of their own when the whole dictionary is too large for one.
HOT, HOT_BYTES = 4096, 4096


def dictionary(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(key, id) for the distinct non-null values of ``column``, ids dense in key order."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(column).alias("key")).filter(F.col("key").isNotNull()).distinct()
    ranged = materialize(keys.repartitionByRange(parts, "key").withColumn("pid", F.spark_partition_id()))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))
    own = F.row_number().over(Window.partitionBy("pid").orderBy("key")) - 1
    numbered = ranged.withColumn("own", own).join(F.broadcast(starts), "pid")
    return numbered.select("key", (F.col("own") + F.col("start")).cast("long").alias("id"))


def _fits(d: DataFrame) -> bool:
    """Is a dictionary (_key, _id) small enough to be broadcast?"""
    size = d.agg(F.sum(F.octet_length(F.col("_key").cast("string")) + 8)).first()[0] or 0
    return size <= BROADCAST_BYTES


def _translate(df: DataFrame, column: str, d: DataFrame, of: str, to: str) -> DataFrame:
    """``df`` with ``to`` of the dictionary row whose ``of`` equals ``column`` (null if there is
    none). Beyond a broadcast, hot keys and nulls never enter the shuffle."""
    if _fits(d):
        return df.join(F.broadcast(d), df[column] == d[of], "left").drop(of)
    total = df.count()
    often = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_often")).agg(F.count(F.lit(1)).alias("n"))
    often = often.where((F.col("n") * HOT >= total) & (F.octet_length(F.col("_often").cast("string")) <= HOT_BYTES)).select("_often")
    often = F.broadcast(materialize(often))  # at most HOT rows of HOT_BYTES
    hot = F.broadcast(d.join(often, d[of] == F.col("_often"), "left_semi"))
    columns = [*df.columns, to]
    few = df.join(often, df[column] == F.col("_often"), "left_semi")
    few = few.join(hot, few[column] == hot[of], "left").select(*columns)
    rest = df.where(F.col(column).isNotNull()).join(often, F.col(column) == F.col("_often"), "left_anti")
    rest = rest.join(d, rest[column] == d[of], "left").select(*columns)
    none = df.where(F.col(column).isNull()).withColumn(to, F.lit(None).cast(d.schema[to].dataType))
    return few.unionByName(rest).unionByName(none.select(*columns))


def encode(df: DataFrame, column: str, dict_df: DataFrame, out: str | None = None) -> DataFrame:
    """Replace ``column`` by its id; a null, or a key that is not in the dictionary, becomes null."""
    out = out or column
    d = dict_df.select(F.col("key").alias("_key"), F.col("id").alias("_id"))
    return _translate(df, column, d, "_key", "_id").drop(column).withColumnRenamed("_id", out)


def encode_column(df: DataFrame, column: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dictionary-encode ``column``; returns (encoded df, dictionary)."""
    d = materialize(dictionary(df, column))
    return encode(df, column, d, out), d


def decode(df: DataFrame, column: str, dict_df: DataFrame, out: str | None = None) -> DataFrame:
    """Map ids in ``column`` back to keys."""
    out = out or column
    d = dict_df.select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    return _translate(df, column, d, "_id", "_key").drop(column).withColumnRenamed("_key", out)
