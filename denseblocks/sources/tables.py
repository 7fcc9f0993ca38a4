"""Relations built from the test tables (TPC-H-like lineitem, events).

* ``L``: lineitem as (l_partkey, l_suppkey, return flag id; quantity).
* ``P``: ``L`` plus a planted dense block: 50 tuples (p, s, 0, 20000) for
  p in 0..9 and s in 0..4.
* ``H``: ``L`` plus the same block with a quantity of 10^9 each (nearly all of the mass).
* ``F``: lineitem as (return flag id, status id, line number; quantity): a few
  coordinates, each of them very often.
* ``G``: ``F`` with flag ids 5 * 10^11 apart, so that nearly all ids are never seen.
* ``E``: events as (user_id, event type id, hour of the month; number of
  events), one tuple per distinct triple.

String keys are dictionary-encoded in key order (``sources.encode``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import Relation, whole
from .encode import encode_column

# Fixed values of the planted block: 10 parts x 5 suppliers, flag id 0,
# quantity 20000 each.
PLANTED_PARTS = 10
PLANTED_SUPPLIERS = 5
PLANTED_FLAG = 0
PLANTED_QUANTITY = 20000
HEAVY_QUANTITY = 1_000_000_000
APART = 500_000_000_000  # distance of the flag ids of G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_relation(spark: SparkSession, sf_dir: str) -> Relation:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    enc, flags = encode_column(li, "l_returnflag", "flag")
    df = enc.select(
        F.col("l_partkey").cast("long").alias("a0"),
        F.col("l_suppkey").cast("long").alias("a1"),
        F.col("flag").cast("long").alias("a2"),
        whole(enc, "l_quantity").alias("v"),
    )
    return Relation(df, 3, ["l_partkey", "l_suppkey", "l_returnflag"], "l_quantity", {2: flags}, scan_based=True)


def planted_block(spark: SparkSession, quantity: int = PLANTED_QUANTITY) -> DataFrame:
    n = PLANTED_PARTS * PLANTED_SUPPLIERS
    return spark.range(n).select(
        (F.col("id") / PLANTED_SUPPLIERS).cast("long").alias("a0"),
        F.pmod(F.col("id"), F.lit(PLANTED_SUPPLIERS)).cast("long").alias("a1"),
        F.lit(PLANTED_FLAG).cast("long").alias("a2"),
        F.lit(quantity).cast("long").alias("v"),
    )


def planted_relation(spark: SparkSession, sf_dir: str, quantity: int = PLANTED_QUANTITY) -> Relation:
    base = lineitem_relation(spark, sf_dir)
    return Relation(
        base.df.unionByName(planted_block(spark, quantity)), 3, base.source_dims, base.source_measure, base.dictionaries, scan_based=True
    )


def events_relation(spark: SparkSession, sf_dir: str) -> Relation:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    enc, types = encode_column(ev, "event_type", "type_id")
    hour_of_month = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    df = (
        enc.select(
            F.col("user_id").cast("long").alias("a0"),
            F.col("type_id").cast("long").alias("a1"),
            hour_of_month.cast("long").alias("a2"),
        )
        .groupBy("a0", "a1", "a2")
        .agg(F.count(F.lit(1)).cast("long").alias("v"))
    )
    return Relation(df, 3, ["user_id", "event_type", "hour_of_month"], "count", {1: types}, derived=True)


def heavy_relation(spark: SparkSession, sf_dir: str) -> Relation:
    return planted_relation(spark, sf_dir, HEAVY_QUANTITY)


def flags_relation(spark: SparkSession, sf_dir: str, apart: int = 1) -> Relation:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    enc, _ = encode_column(li, "l_returnflag", "flag")
    enc, states = encode_column(enc, "l_linestatus", "status")
    df = enc.select((F.col("flag") * apart).alias("a0"), F.col("status").alias("a1"), F.col("l_linenumber").cast("long").alias("a2"), whole(enc, "l_quantity").alias("v"))
    return Relation(df, 3, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", {1: states}, scan_based=True)


def sparse_relation(spark: SparkSession, sf_dir: str) -> Relation:
    return flags_relation(spark, sf_dir, APART)


RELATIONS = {
    "L": lineitem_relation,
    "P": planted_relation,
    "H": heavy_relation,
    "E": events_relation,
    "F": flags_relation,
    "G": sparse_relation,
}
