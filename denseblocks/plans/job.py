"""Command-line job.

    spark-submit -m denseblocks.plans.job INPUT OUTPUT N MEASURE POLICY THETA K \
        [--format text|parquet|csv] [--delimiter ,] [--dims c1,c2 --measure-column m] \
        [--shuffle-partitions P] [--event-log DIR] [--malformed failfast|drop] [--cardinality max_plus_one|distinct] \
        [--merge auto|always|never] [--layout plain|bucketed] [--histogram recompute|delta] [--journal DIR] [--publish]

Positional arguments follow the reference's order: input path, output path,
number of dimensions, density measure (ari|geo|susp), policy
(density|cardinality), theta (>= 1), number of blocks. Text input holds
``a0,..,aN-1,v`` lines; parquet/csv input names its columns with --dims and
--measure-column (columns that are not integers are dictionary-encoded; the output has
their keys, and the dictionaries). Parsed or encoded input is kept once as Parquet in
spark.checkpoint.dir. --event-log names a folder for Spark's event log. --journal names a
shared folder in which every pass is written down: the same command, started again after a
failure, goes on from there. --publish writes all outputs to a fresh folder under OUTPUT and
makes them visible at once by a manifest (sources.sinks).
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from ..config import Options, ensure_checkpoint_dir, stored
from ..relation import from_columns
from ..sources.encode import encode_column
from ..sources.sinks import publish_blocks, write_blocks
from ..sources.text import read_relation_text
from .search import find_blocks


def parse_args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="denseblocks", description="Find the k densest blocks of a relation.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("dimensions", type=int)
    p.add_argument("measure", type=str.lower, choices=["ari", "geo", "susp"])
    p.add_argument("policy", type=str.lower, choices=["density", "cardinality"])
    p.add_argument("theta", type=float)
    p.add_argument("blocks", type=int)
    p.add_argument("--format", default="text", choices=["text", "parquet", "csv"])
    p.add_argument("--delimiter", default=",")
    p.add_argument("--dims", default=None, help="comma-separated dimension columns (parquet/csv)")
    p.add_argument("--measure-column", default=None, help="measure column (parquet/csv); default counts rows")
    p.add_argument("--shuffle-partitions", type=int, default=None)
    p.add_argument("--malformed", default="failfast", choices=["failfast", "drop"])
    p.add_argument("--cardinality", default="max_plus_one", choices=["max_plus_one", "distinct"])
    p.add_argument("--event-log", default=None, help="folder for Spark's event log (a session that this job starts)")
    p.add_argument("--broadcast-rows", type=int, default=Options.broadcast_rows)
    p.add_argument("--bitmap-bytes", type=int, default=Options.bitmap_bytes)
    p.add_argument("--merge", default=Options.merge, choices=["auto", "always", "never"])
    p.add_argument("--layout", default=Options.layout, choices=["plain", "bucketed"])
    p.add_argument("--histogram", default=Options.histogram, choices=["recompute", "delta"])
    p.add_argument("--journal", default=None, help="shared folder to write every pass down in, and to go on from")
    p.add_argument("--publish", action="store_true", help="make all outputs visible at once, by a manifest")
    a = p.parse_args(argv)
    if a.theta < 1.0:
        p.error("theta must be at least 1")
    if a.dimensions < 1 or a.blocks < 1:
        p.error("dimensions and blocks must be positive")
    return a


def main(argv: list[str] | None = None) -> int:
    a = parse_args(sys.argv[1:] if argv is None else argv)
    builder = SparkSession.builder.appName("denseblocks")
    if a.event_log:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.event_log)
    spark = builder.getOrCreate()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(a.shuffle_partitions or before))
    try:
        return run(spark, a)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    ensure_checkpoint_dir(spark)
    t0 = time.time()
    if a.format == "text":
        rel, rejected = read_relation_text(spark, a.input, a.dimensions, a.delimiter, a.malformed)
        print("Lines: " + ", ".join(f"{n} {c}" for n, c in rel.counts.items()))
        if a.malformed == "drop":
            rejected.write.mode("overwrite").csv(f"{a.output.rstrip('/')}/rejected")
    else:
        # the schema of csv is inferred from all rows, so integers stay integers
        reader = spark.read.option("header", True).option("inferSchema", True) if a.format == "csv" else spark.read
        df = reader.format(a.format).load(a.input)
        dims = a.dims.split(",") if a.dims else df.columns[: a.dimensions]
        if len(dims) != a.dimensions:
            raise SystemExit(f"expected {a.dimensions} dimension columns, got {dims}")
        dicts = {}
        for i, d in enumerate(dims):
            if dict(df.dtypes)[d] not in ("tinyint", "smallint", "int", "bigint"):
                df, dicts[i] = encode_column(df, d)
        rel = from_columns(df, dims, a.measure_column)
        rel = replace(rel, df=stored(rel.df, "input")[0], dictionaries=dicts, scan_based=True)
    opts = Options(broadcast_rows=a.broadcast_rows, bitmap_bytes=a.bitmap_bytes, merge=a.merge, layout=a.layout, histogram=a.histogram)
    res = find_blocks(rel, a.blocks, a.measure, a.policy, a.theta, opts=opts, cardinality=a.cardinality, journal=a.journal)
    print(res.text())
    t1 = time.time()
    print(f"Writing members and tuples to {a.output}")
    (publish_blocks if a.publish else write_blocks)(res, a.output)
    res.close()
    print(f"Done: output took {time.time() - t1:.3f} s, the whole job {time.time() - t0:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
