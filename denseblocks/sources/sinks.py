"""Writing blocks.

Layout under ``out``:

* ``attributes/block=<i>/part-*.csv`` -- lines ``mode,value`` (0-based mode);
* ``tuples/block=<i>/part-*.csv``     -- lines ``a0,..,aN-1,v`` of the
  original relation, duplicates kept;
* ``dictionaries/mode=<n>/``          -- Parquet (key, id) of an encoded dimension;
* ``report/part-*.csv``               -- one row per block (header).

Values are the user's own: ids of an encoded dimension are written as their keys.
Each is one distributed write; nothing passes through the driver.

``write_blocks`` replaces these folders one after the other. ``publish_blocks`` writes them, with
the intervals of the members (``ranges``) and the passes (``passes``), to a fresh folder under
``out`` and then names that folder in one manifest; ``published`` follows the newest manifest. A
failure before it leaves the last result readable, a reader never sees a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import release
from ..plans.journal import Journal
from ..plans.search import Result
from .encode import decode


def decoded_members(result: Result) -> DataFrame:
    """(block, mode, value) with values as text, keys of encoded dimensions restored."""
    out = result.members().select("block", F.col("mode").cast("int"), "value")
    plain = out.where(~F.col("mode").isin(list(result.ctx.dictionaries)))
    text = plain.withColumn("value", F.col("value").cast("string"))
    for m, d in result.ctx.dictionaries.items():
        part = decode(out.where(F.col("mode") == m), "value", d)
        text = text.unionByName(part.withColumn("value", F.col("value").cast("string")))
    return text


def decoded_tuples(result: Result) -> DataFrame:
    """(block, a0.., v), keys of encoded dimensions restored."""
    out = result.tuples()
    columns = out.columns
    for m, d in result.ctx.dictionaries.items():
        out = decode(out, f"a{m}", d)
    return out.select(*columns)


def write_blocks(result: Result, out: str, mode: str = "overwrite") -> None:
    out = out.rstrip("/")
    decoded_members(result).write.mode(mode).partitionBy("block").csv(f"{out}/attributes")
    decoded_tuples(result).write.mode(mode).partitionBy("block").csv(f"{out}/tuples")
    for m, d in result.ctx.dictionaries.items():
        d.write.mode(mode).parquet(f"{out}/dictionaries/mode={m}")
    result.report().coalesce(1).write.mode(mode).option("header", True).csv(f"{out}/report")


def publish_blocks(result: Result, out: str, expanded: bool = True) -> str:
    """Write all outputs to a fresh folder and make them visible by one manifest.
    ``expanded=False`` leaves out the members one by one, where never-seen ids are too many for
    that. The result before stays for its readers, older ones go. Returns the folder."""
    book = Journal(result.ctx.spark, out)
    past = book.load() or {}
    name = f"run-{uuid.uuid4().hex}"
    folder = f"{book.folder}/{name}"
    if expanded:
        decoded_members(result).write.partitionBy("block").csv(f"{folder}/attributes")
    result.member_ranges().write.parquet(f"{folder}/ranges")
    decoded_tuples(result).write.partitionBy("block").csv(f"{folder}/tuples")
    for m, d in result.ctx.dictionaries.items():
        d.write.parquet(f"{folder}/dictionaries/mode={m}")
    result.passes().coalesce(1).write.option("header", True).csv(f"{folder}/passes")  # a row per pass
    result.report().coalesce(1).write.option("header", True).csv(f"{folder}/report")
    book.save({"run": name, "before": past.get("run")})
    if past.get("before"):
        release(result.ctx.spark, f"{book.folder}/{past['before']}")
    return folder


def published(spark: SparkSession, out: str) -> str:
    """Folder of the newest whole result under ``out``."""
    book = Journal(spark, out)
    state = book.load()
    if state is None:
        raise FileNotFoundError(f"{out} holds no published result")
    return f"{book.folder}/{state['run']}"
