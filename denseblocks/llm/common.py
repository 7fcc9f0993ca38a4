"""Helpers shared by the corpus operators: tables, staged Parquet, checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ensure_checkpoint_dir

# A set of 8-byte keys is broadcast up to this many rows (16 MB of keys); a
# larger one goes through a shuffle join.
BROADCAST_KEYS = 2_000_000
BROADCAST_BYTES = 32 << 20  # of wider rows, measured
HOT = 4096  # a key of at least 1 / HOT of the rows is hot
# Bytes of input that one Arrow batch may hold, so that a batch of very long
# texts stays small whatever its row count.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def python_tasks(spark: SparkSession) -> None:
    """Make ready for Python in tasks: executors get this package from Spark's own
    file distribution, and Arrow batches are bounded by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_denseblocks_shipped", False) or not os.path.isdir(_PACKAGE):
        return
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="denseblocks-py-"), "denseblocks_py.zip")
    with open(path, "wb") as f:  # on the driver only; Spark sends it to the executors
        f.write(out.getvalue())
    sc.addPyFile(path)
    sc._denseblocks_shipped = True


class Stage:
    """Parquet tables in the shared checkpoint folder, which cut lineage: what an
    executor held can be read again by any other."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most BROADCAST_KEYS narrow rows, else leave it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def small_bytes(df: DataFrame, size) -> DataFrame:
    """Mark ``df`` for broadcast if its rows of ``size`` bytes (a column) are at most BROADCAST_BYTES."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row a key; ``weight``: how many rows have it). Keys
    of at least 1 / HOT of the rows, HOT of them at most, are broadcast, and rows without a
    key joined to nothing, so that no task of the shuffle holds a hot key."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    often = table.where(F.col(weight) * HOT >= total)
    rest = table.where(F.col(weight) * HOT < total)
    hot = rows.join(F.broadcast(often), key)
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti").where(F.col(key).isNotNull()).join(rest, key, "left")
    none = rows.where(F.col(key).isNull())
    for f in table.schema:
        if f.name != key:
            none = none.withColumn(f.name, F.lit(None).cast(f.dataType))
    return hot.unionByName(cold).unionByName(none)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, _id, _h): whole rows, whatever their columns are called, with their id and
    the hash of their text."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Words as the contracts define them: A-Z lower-cased, runs of other than ASCII white space.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column; null counts 0."""
    parts = F.split(text, SPACE)
    empty = F.when(parts.getItem(0) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.coalesce((F.size(parts) - empty).cast("long"), F.lit(0).cast("long"))


def running(df: DataFrame, keys: list[str], order: list, amount, out: str, buckets: int, bucket) -> DataFrame:
    """Add ``out``: the running sum of ``amount`` before each row, within ``keys``, in
    the order (bucket, *order). ``bucket`` (0 to ``buckets`` - 1) splits the rows of a
    key, so that no window holds a whole key: sums by (key, bucket) are added up over
    at most ``buckets`` rows a key, rows within their own bucket only.
    """
    df = df.withColumn("_b", bucket.cast("int")).withColumn("_n", amount.cast("long"))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0).cast("long")).alias("_o"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out_col = (F.coalesce(F.sum("_n").over(inner), F.lit(0).cast("long")) + F.col("_o")).alias(out)
    at = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    cond = at[0]
    for c in at[1:]:
        cond = cond & c
    joined = df.alias("l").join(F.broadcast(sums.alias("r")) if buckets <= 100_000 else sums.alias("r"), cond)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], F.col("r._o").alias("_o")).select(
        *[c for c in df.columns if c not in ("_b", "_n")], out_col
    )
