"""Run the block search as relation files arrive (Structured Streaming).

The reference has no streaming operator; this is only its batch job driven
by new input: a file-source stream of relation text lines is parsed with
the same rules as the batch reader, accepted tuples are appended to a
parquet table, and after every micro-batch the k-block search runs over the
whole table so far and writes its blocks under ``output/epoch=<id>``.
Rejected lines go to ``table_path/_rejected``. A micro-batch writes its own
``epoch=<id>`` folder of both tables, so that a replayed one replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..relation import Relation
from ..sources.sinks import write_blocks
from ..sources.text import classify_lines
from ..plans.search import find_blocks


def start(
    spark: SparkSession,
    input_dir: str,
    table_path: str,
    output: str,
    checkpoint: str,
    n_dims: int,
    k: int = 1,
    measure: str = "geo",
    policy: str = "density",
    theta: float = 2.0,
    delimiter: str = ",",
    trigger_seconds: int | None = None,
) -> StreamingQuery:
    lines = spark.readStream.format("text").load(input_dir)
    parsed = classify_lines(lines, n_dims, delimiter)
    dims = [f"a{i}" for i in range(n_dims)]

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.filter(F.col("reason").isNotNull()).select("line", "reason").write.mode("overwrite").parquet(
            f"{table_path.rstrip('/')}/_rejected/epoch={epoch_id}"
        )
        batch.filter(F.col("reason").isNull()).select(*dims, "v").write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/epoch={epoch_id}")
        df = batch.sparkSession.read.parquet(table_path).select(*dims, "v")
        res = find_blocks(Relation(df, n_dims, scan_based=True), k, measure, policy, theta)
        write_blocks(res, f"{output.rstrip('/')}/epoch={epoch_id}")

    writer = parsed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
