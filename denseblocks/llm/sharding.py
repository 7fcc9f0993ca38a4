"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Every shard takes the same number of rows (at
most one apart). Groups of more rows than a shard has fill whole shards first. The
others start with a random shard for each member; in each round a group, or what is
left of it, looks at the shards that its members are on and asks for the one with room
that most of them are on, those already placed before all others. A shard accepts the
largest groups first, up to its free rows; the others look again in the next round,
until all are placed. A group is cut by the room of the shards only, when no shard has
room for what is left of it. Documents without links then fill the shards up to their
quotas exactly.

Neighbours are counted by (group, shard), never as pairs. All the tables are narrow:
texts are read once for their size, CRC and key.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, running, small

SHARDS = 40
BASE_BYTES = 16  # of a row besides its text


def _pick(values: list[int], index):
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): ``doc_id,
    size, text_crc32, shard, slot, linked`` (rows with an equal text, itself included).

    A null text has no bytes, the CRC of no bytes, and is equal to other null texts only.
    Repeated rows and null ids are rows like others. Reruns over the same files agree.
    An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "shard")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + BASE_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit("00"))).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stage.put(rows.withColumn("h", F.xxhash64("uid")), "rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = max(16, n // 1_000_000)

    groups = stage.put(rows.groupBy("key").agg(F.count("*").alias("linked")).where("linked > 1"), "groups")
    room, whole = list(quota), []
    for key, m in groups.where(F.col("linked") > quota[0]).orderBy(F.desc("linked"), "key").collect():  # fewer than shards
        while m:
            s = room.index(max(room))
            take = min(m, room[s])
            room[s], m = room[s] - take, m - take
            whole.append((bytes(key), s, take))
    parts = stage.put(docs.sparkSession.createDataFrame(whole, "key binary, shard int, m long"), "parts")
    todo = groups.where(F.col("linked") <= quota[0]).select("key", F.col("linked").alias("rest"), F.xxhash64("key").alias("uh"))
    start = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    start = rows.join(small(todo.select("key")), "key").groupBy("key", start).agg(F.count("*").alias("votes")).withColumn("placed", F.lit(0))
    start, i = stage.put(start, "start"), 0
    while not todo.isEmpty():
        # shards that members are on now and that have room; without one, any shard with room
        most = max(room)
        need = F.when(F.col("rest") <= most, F.col("rest")).otherwise(F.lit(max(1, most // 2)).cast("long"))
        votes = start.unionByName(parts.select("key", "shard", F.col("m").alias("votes"), F.lit(1).alias("placed")))
        ask = votes.join(todo, "key").where(_pick(room, F.col("shard")) >= need)
        ask = ask.groupBy("key").agg(F.max(F.struct("placed", "votes", F.xxhash64("uh", "shard", F.lit(i)).alias("t"), "shard")).alias("best"))
        fit = F.filter(F.array(*[F.lit(s) for s in range(shards)]), lambda s: _pick(room, s) >= need)
        any_fit = F.element_at(fit, (F.pmod(F.xxhash64("uh", F.lit(1000 + i)), F.size(fit)) + 1).cast("int"))
        wanted = todo.join(ask, "key", "left").select("key", "rest", "uh", F.coalesce("best.shard", any_fit).alias("shard"))
        bucket = (F.lit(63) - F.floor(F.log2(F.col("rest").cast("double")))) * buckets + F.pmod("uh", F.lit(buckets))
        wanted = running(wanted, ["shard"], [F.desc("rest"), "uh", "key"], F.col("rest"), "before", 64 * buckets, bucket)
        free = _pick(room, F.col("shard")) - F.col("before")
        take = F.when(F.col("rest") <= free, F.col("rest")).when(F.col("rest") > most, F.greatest(free, F.lit(0))).otherwise(0).cast("long")
        wanted = stage.put(wanted.withColumn("m", take), f"round-{i}")
        got = wanted.where("m > 0").select("key", "shard", "m")
        for s, m in got.groupBy("shard").agg(F.sum("m")).collect():  # a row for each shard
            room[s] -= m
        parts, i = parts.unionByName(got), i + 1
        todo = wanted.where("m < rest").select("key", (F.col("rest") - F.col("m")).alias("rest"), "uh")

    # a group of one part goes there as a whole, the rows of a cut one by their rank
    homes = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "m"))).alias("parts"))
    homes = stage.put(homes.join(groups, "key").withColumn("home", F.when(F.size("parts") == 1, F.col("parts")[0]["shard"])), "homes")
    columns = ["doc_id", "size", "text_crc32", "uid", "h", "linked"]
    marked = rows.join(small(homes.select("key", "linked", "home")), "key", "left").withColumnRenamed("home", "shard")
    marked = stage.put(marked, "marked")
    cut = running(marked.where("shard IS NULL AND linked IS NOT NULL").drop("shard"), ["key"], ["h", "uid"], F.lit(1), "rank", buckets, F.pmod(F.shiftright("h", 17), F.lit(buckets)))
    ends = F.transform("parts", lambda x: F.aggregate(F.filter("parts", lambda y: y["shard"] <= x["shard"]), F.lit(0).cast("long"), lambda a, y: a + y["m"]))
    cuts = homes.where("home IS NULL").select("key", "parts", ends.alias("ends"))
    cut = cut.join(small(cuts), "key").withColumn("shard", F.element_at("parts", F.size(F.filter("ends", lambda x: x <= F.col("rank"))) + 1)["shard"])
    placed = marked.where("shard IS NOT NULL").select(*columns, "shard").unionByName(cut.select(*columns, "shard"))
    marked = marked.where("linked IS NULL").select(*columns, "shard")
    left = running(marked.drop("shard").withColumn("all", F.lit(0)), ["all"], ["h", "uid"], F.lit(1), "rank", buckets * shards, F.pmod(F.shiftright("h", 17), F.lit(buckets * shards)))
    ends = F.array(*[F.lit(x).cast("long") for x in accumulate(room)])
    left = left.withColumn("shard", F.size(F.filter(ends, lambda x: x <= F.col("rank"))).cast("int"))
    placed = stage.put(placed.unionByName(left.select(*columns, "shard")), "placed")
    out = running(placed, ["shard"], ["h", "uid"], F.lit(1), "slot", buckets, F.pmod(F.shiftright("h", 17), F.lit(buckets)))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", F.coalesce("linked", F.lit(1).cast("long")).alias("linked"))
