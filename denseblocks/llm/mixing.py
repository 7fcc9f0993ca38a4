"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id. A source is taken ``floor(target /
size)`` times whole and once more up to a threshold of the hash, so that the words
below it come as near to the rest of the target as whole documents allow. The
threshold is found from sums by (source, hash bucket): 4096 buckets of the whole
range, then 4096 of the one bucket in which the target falls, and so on to a single
hash value. Only that boundary bucket is read again; nothing is sorted, and the
documents are then taken by a filter on their hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, small, word_count

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MOST = 3  # a source is taken at most so many times
LEVELS, BITS = 5, 12


def id_hash(doc_id):
    """60 bits of the MD5 of the id as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, stage: Stage) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by the order of the
    source's code points, null last; targets above MOST times a source's size stop
    there and the excess is shared again by weight."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered by range partitions, without one task for all sources
    ordered = by_source.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ordered = stage.put(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("m"))
    offset = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    parts = parts.select("part", F.coalesce(offset, F.lit(0)).alias("offset"))
    rank = (row + F.col("offset")) % len(WEIGHTS)
    weight = reduce(lambda c, i: c.when(rank == i, F.lit(WEIGHTS[i])), range(1, len(WEIGHTS)), F.when(rank == 0, F.lit(WEIGHTS[0])))
    named = ordered.withColumn("part", part).join(F.broadcast(parts), "part").select("source", "source_size", weight.cast("long").alias("weight"))
    named = stage.put(named, "weights")

    total, every = named.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, left = int(total or 0), int(every or 0)

    def above(rest: int, left: int):
        wide = "decimal(38,0)"
        return F.col("weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(27,0)") > (F.col("source_size") * MOST).cast("decimal(24,0)") * F.lit(left).cast("decimal(13,0)").cast(wide if left >= 10**13 else "decimal(13,0)")

    while True:
        full, kept = named.agg(
            F.sum(F.when(above(rest, left), F.col("source_size") * MOST).otherwise(0)), F.sum(F.when(above(rest, left), 0).otherwise(F.col("weight")))
        ).first()
        again = (int(total or 0) - int(full or 0), int(kept or 0))
        if again == (rest, left) or not again[1]:
            break
        rest, left = again
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(left or 1))
    return stage.put(named.select("source", "source_size", F.when(above(rest, left), (F.col("source_size") * MOST).cast("double")).otherwise(share).alias("target")), "targets")


def thresholds(rows: DataFrame, goal: DataFrame, stage: Stage) -> DataFrame:
    """(source, source_size, target, times, edge, ties): documents of a source are
    taken ``times`` times, those with a hash below ``edge`` (at it, if ``ties``) once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    state = state.withColumn("edge", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("at_edge", F.lit(0).cast("long"))
    order = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.alias("r").join(small(state).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        inside = inside.where(F.shiftright("r.h", shift + BITS) == F.col("s.edge"))
        sums = inside.groupBy("r.source", F.shiftright("r.h", shift).alias("bucket")).agg(F.sum("size").alias("w"), F.first("s.rest").alias("rest"), F.first("s.below").alias("low"))
        run = sums.withColumn("upto", F.col("low") + F.sum("w").over(order))
        # the first bucket that passes the rest, else the last
        edge = run.groupBy("source").agg(
            F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "w"))), F.max(F.struct("bucket", "upto", "w"))).alias("e")
        )
        edge = edge.select("source", F.col("e.bucket").alias("edge"), (F.col("e.upto") - F.col("e.w")).alias("below"), F.col("e.w").alias("at_edge"))
        old = state.drop("edge", "below", "at_edge").alias("o")
        state = old.join(edge.alias("e"), F.col("o.source").eqNullSafe(F.col("e.source"))).select("o.*", "edge", "below", "at_edge")
        state = stage.put(state, f"level-{level}")
    ties = F.col("below") + F.col("at_edge") - F.col("rest") < F.col("rest") - F.col("below")
    more = F.col("rest") > 0  # else nothing is taken once more, empty documents neither
    return state.select("source", "source_size", "target", "times", F.when(more, F.col("edge")).otherwise(0).alias("edge"), (more & ties).alias("ties"))


def _cuts(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and the thresholds of their sources."""
    rows = docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    rows = stage.put(rows.withColumn("h", id_hash(F.col("doc_id"))), "sizes")
    return rows, thresholds(rows.select("source", "size", "h"), targets(rows, stage), stage)


def _times():
    return F.expr("times + CASE WHEN h < edge OR (h = edge AND ties) THEN 1 ELSE 0 END")


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored):
    ``doc_id, source, size, source_size, target, times`` (how often the mix takes it) and
    ``taken`` (``times * size``).

    Null texts have size 0. A null source is a source. Rows with equal doc_id (null
    too) have one hash and are taken alike. Reruns agree. An empty table gives an
    empty result.
    """
    rows, cuts = _cuts(docs, Stage(docs.sparkSession, "mix"))
    out = rows.alias("r").join(small(cuts).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).withColumn("taken_times", _times())
    return out.select("r.doc_id", "r.source", "size", "source_size", "target", F.col("taken_times").alias("times"), (F.col("taken_times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as the mix takes it, MOST times at
    most. Rows without words, null texts, null ids and sources, repeated rows and an empty table
    are as in :func:`mix`."""
    _, cuts = _cuts(docs, Stage(docs.sparkSession, "mix"))
    cuts = cuts.select(F.col("source").alias("_source"), "times", "edge", "ties")
    names = docs.columns
    out = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], id_hash(F.col("doc_id")).alias("h"), F.col("source").cast("string").alias("_s"))
    out = out.join(small(cuts), F.col("_s").eqNullSafe(F.col("_source"))).withColumn("n", _times()).where("n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def sql(table: str = "documents", text: str = "text") -> str:
    """The same mix in DuckDB's SQL, by sorting."""
    return f"""
WITH rows AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {table}),
named AS (SELECT source, sum(size)::HUGEINT AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM rows GROUP BY source),
filled AS (SELECT *, (SELECT sum(s) FROM named) - coalesce(sum(3 * s) OVER o, 0) AS rest, (SELECT sum(w) FROM named) - coalesce(sum(w) OVER o, 0) AS lef
    FROM named WINDOW o AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, lef FROM filled WHERE w * rest <= 3 * s * lef ORDER BY s::DOUBLE / w, source NULLS LAST LIMIT 1),
goal AS (SELECT source, s AS source_size, CASE WHEN w * level.rest > 3 * s * level.lef THEN (3 * s)::DOUBLE ELSE w::DOUBLE * level.rest::DOUBLE / level.lef::DOUBLE END AS target FROM named, level),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS times FROM goal),
runs AS (SELECT r.doc_id, r.source, r.size, r.h, c.source_size, c.target, c.times, c.target - c.times * c.source_size::DOUBLE AS rest,
    sum(size) OVER (PARTITION BY r.source ORDER BY r.h) AS upto, sum(size) OVER (PARTITION BY r.source, r.h) AS here
    FROM rows r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source),
edges AS (SELECT *, min(CASE WHEN upto > rest THEN h END) OVER (PARTITION BY source) AS edge FROM runs)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    (size * (times + CASE WHEN edge IS NULL OR h < edge OR (h = edge AND upto - rest < rest - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM edges
"""
