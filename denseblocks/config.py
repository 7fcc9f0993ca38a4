"""Run options and session helpers.

Everything that decides *how* a plan is executed (broadcast limits, salting,
materialisation) lives here so that the operators stay declarative.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession


@dataclass(frozen=True)
class Options:
    """Execution knobs; defaults are sized for a large cluster.

    broadcast_rows
        A membership set (ids of one dimension) is broadcast only when its
        exact row count, known from the pass statistics, is at most this.
        Larger sets go through a shuffle join.
    hot_parts
        A value with at least ``tuples / hot_parts`` of the tuples is *hot*. There
        are at most ``hot_parts`` of them in a dimension (every tuple has one value
        of it), so the hot set is always safe to broadcast. Hot keys are
        decided map-side and salted out of the shuffle.
    salts
        Number of fake join keys the tuples of hot values are spread over.
    min_partitions
        Lower bound when the working tuples are re-partitioned after shrinking
        (their partition count follows their share of the original tuples).
    bitmap_bytes
        A set above ``broadcast_rows`` is broadcast as chunked bitmaps, one bit an id,
        when those take at most so many bytes (bounded by the largest id, else measured).
        0 turns bitmaps off.
    merge
        Identical coordinates are searched once, with their added measure: ``auto``
        (if at most half of the tuples are distinct, by an estimate), ``always`` or ``never``.
    update
        ``recompute`` the value masses from the tuples that are left, or ``delta``: subtract
        those of the tuples that went.
    histogram
        ``recompute`` it from the alive values each pass, or ``delta``: keep it, and move
        only the values whose mass has changed.
    layout
        ``plain``, or ``bucketed``: while sets are above both broadcast limits, the working tuples
        lie in buckets of the dimension with the largest sets, so that those joins move no
        tuples. Tuples of hot values lie in a table of their own.
    """

    broadcast_rows: int = 2_000_000
    hot_parts: int = 4096
    salts: int = 256
    min_partitions: int = 1
    bitmap_bytes: int = 64 << 20
    merge: str = "auto"
    update: str = "recompute"
    histogram: str = "recompute"
    layout: str = "plain"
    # Stop a search once nothing left can beat the best block (exact; the
    # reported pass count is then the passes run, not the full peel's).
    early_exit: bool = False
    # "histogram" (default for the built-in measures) or "values": scan the
    # chosen dimension value by value (always used for user measures).
    cut_path: str = "histogram"


DEFAULT = Options()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only a local-mode session without the setting (tests, laptops) gets
    a private folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "so that iterative lineage can be cut reliably"
        )
    local = tempfile.mkdtemp(prefix="denseblocks-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable, eager checkpoint.

    The checkpoint keeps the output partitioning of the plan, so a value table
    hash-partitioned by (mode, value) is joined later without a new exchange.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "rows", folder: str | None = None, partition: str | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage of ``df`` with a Parquet table in ``folder`` (default: the checkpoint
    folder), which later jobs read column by column. Returns the table and its path."""
    path = f"{folder or ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def counted(df: DataFrame, name: str, counts: dict[str, Column], folder: str | None = None, partition: str | None = None) -> tuple[DataFrame, str, dict]:
    """:func:`stored`, with aggregates of the rows that come out of the same job."""
    seen = Observation()
    table, path = stored(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name, folder, partition)
    return table, path, seen.get


def bucketed(df: DataFrame, name: str, key: str, buckets: int, folder: str | None = None) -> tuple[str, str]:
    """Write ``df`` in buckets of ``key``, as a table of the session's catalog over files in
    ``folder``. Returns the table's name and path."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{folder or ensure_checkpoint_dir(df.sparkSession)}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return table, path


def open_bucketed(spark: SparkSession, table: str, path: str, key: str, buckets: int, schema) -> DataFrame:
    """A table of :func:`bucketed`, made known again to a session that did not write it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def size_of(spark: SparkSession, path: str | None) -> int:
    """Bytes of the files below ``path``."""
    if not path:
        return 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength())


def release(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`stored` that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def persist(df: DataFrame) -> DataFrame:
    """Keep ``df`` once computed (memory, spilling to disk); lazy, so the next
    action that needs it fills the cache instead of an extra job. Used for
    tables whose lineage is short or is cut by a periodic checkpoint."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "denseblocks") -> SparkSession:
    """Session for tests and the local bench (not used by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("DENSEBLOCKS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark
