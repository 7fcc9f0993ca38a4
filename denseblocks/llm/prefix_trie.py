"""Prefix trie of conversations, with subtree totals by bands of depth.

A node of depth d is a distinct sequence of first d turns. Its key is a 128-bit hash of
the sums, over the positions i of its path, of hashes of (i, role, text); sums make the keys
of a conversation a running sum, which is added up in buckets of positions, so that no task holds a
long conversation. Positions are numbered over range partitions for the same reason.

Subtree totals are rolled up by bands of BAND levels. Within a band every node adds its
value to its ancestors in that band only (its path there is read off the one conversation that
represents it, the smallest member, and added up along it before anything is shuffled by
node). The band roots, with the totals of their band, then form a trie that is BAND times less
deep, which is rolled up in the same way; a band root's completed total goes to its
ancestors in the band above. Every step is a bounded number of shuffles, there are log(depth) / log(BAND) of
them, and no row is copied more than BAND times.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, default_partitions, python_tasks, small, word_count

BAND = 32  # levels of a band
FAMILY = 20  # conversations that share the turns of one of them
HEADS = 4  # they share fewer than so many turns
BUCKET = 4096  # positions whose running sums one window adds up
CHUNK = 4096  # conversation ids in one piece of a node's list
HOT = 4096  # nodes on at least 1 / HOT of all paths, so at most HOT of them, are joined by broadcast
LANES = 4  # sums of 31 bits each: exact for up to 2^32 turns of one conversation

EMPTY = hashlib.sha256(b"").hexdigest()


def _numbered(turns: DataFrame, stage: Stage) -> DataFrame:
    """(c, k, h1, h2, words): every turn with its place k (from 1) in its conversation. Range
    partitions cut long conversations; the places before a part come from its counts."""
    turns = stage.put(turns, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("u")]
    ranged = turns.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(default_partitions(turns.sparkSession), "c", *order)
    ranged = stage.put(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    counts = ranged.groupBy("part", "c").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("part", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "c").orderBy(*order))
    numbered = ranged.withColumn("own", own).join(counts, ["part", "c"])
    return stage.put(numbered.select("c", (F.col("own") + F.col("before")).alias("k"), "h1", "h2", "words"), "numbered")


def rebuilt(conversations: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(c, pos, h1, h2, words) of the rebuilt conversations, turns by their hashes, and
    (c, n_turns) of all of them, turnless ones too."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    hashes = [F.xxhash64(F.lit(seed), role, text).alias(f"h{seed}") for seed in (1, 2)]
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", *hashes, word_count(text).alias("words"))
    rows = _numbered(turns, stage)

    lengths = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    base, shared = F.col("c") - F.col("c") % FAMILY, (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS)
    lengths = lengths.select("c", "n", base.alias("base"), shared.alias("h"))
    bases = lengths.where("c = base").select(F.col("c").alias("b"), F.col("n").alias("bn"))
    convs = lengths.join(bases, F.col("base") == F.col("b"), "left")
    convs = convs.select("c", "base", "h", F.least("h", F.coalesce("bn", F.lit(0))).alias("taken"), "n")
    convs = stage.put(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")

    heads = rows.where(F.col("k") < HEADS).where(F.col("c") % FAMILY == 0).withColumnRenamed("c", "b")
    first = convs.join(heads, (F.col("base") == F.col("b")) & (F.col("k") <= F.col("h"))).select("c", F.col("k").alias("pos"), "h1", "h2", "words")
    # The shift by the turns taken over is a property of (c, bucket), so that a long conversation meets it in many tasks.
    own = rows.where(F.col("k") > F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).withColumn("bucket", F.floor(F.col("k") / BUCKET))
    shifts = convs.select("c", (F.col("taken") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BUCKET))).alias("bucket"))
    own = own.join(shifts, ["c", "bucket"]).select("c", (F.col("k") + F.col("shift")).alias("pos"), "h1", "h2", "words")
    return first.unionByName(own), convs.select("c", "n_turns")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, pos, k1, k2, p1, p2, words): the node of every first ``pos`` turns, its parent's
    key and the words of its last text; the root at pos 0 has no parent."""
    both = [F.xxhash64(F.lit(seed), "pos", "h1", "h2") for seed in (3, 5)]
    low = F.lit((1 << 31) - 1)
    lanes = [lane.alias(f"f{i}") for i, lane in enumerate(x for b in both for x in (b.bitwiseAND(low), F.shiftrightunsigned(b, 33)))]
    rows = turns.select("c", "pos", "words", F.floor(F.col("pos") / BUCKET).alias("bucket"), *lanes)
    names = [f"f{i}" for i in range(LANES)]
    sums = rows.groupBy("c", "bucket").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.select("c", "bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o{i}") for i, n in enumerate(names)])
    inside = Window.partitionBy("c", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("c", "bucket", "pos", "words", *names, *[F.sum(n).over(inside).alias(f"s{i}") for i, n in enumerate(names)])
    rows = rows.join(sums, ["c", "bucket"])

    def key(depth, lanes):
        return [F.xxhash64(F.lit(seed), depth.cast("long"), *lanes) for seed in (7, 11)]

    at = [F.col(f"s{i}") + F.col(f"o{i}") for i in range(LANES)]
    up = [x - F.col(n) for x, n in zip(at, names)]
    k, p = key(F.col("pos"), at), key(F.col("pos") - 1, up)
    rows = rows.select("c", F.col("pos").cast("long"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), "words")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    r = key(zero, [zero] * LANES)
    root = convs.select("c", zero.alias("pos"), r[0].alias("k1"), r[1].alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"))
    return rows.unionByName(root)


def rollup(path: DataFrame, values: DataFrame, deepest: int, stage: Stage, level: int = 0) -> DataFrame:
    """(k1, k2, x1, x2): the sums of ``values`` over the subtree of every node.

    ``path`` is (c, pos, k1, k2), the nodes on the way to the end of every conversation;
    ``values`` (c, pos, k1, k2, x1, x2), one row per node at its representative: the same
    one for a node and for all below it whose smallest member it is.
    """
    band = F.floor(F.col("pos") / BAND)
    at = values.select("c", "pos", "x1", "x2")
    along = path.join(at, ["c", "pos"], "left").withColumn("band", band)
    upward = Window.partitionBy("c", "band").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BAND rows
    sums = along.select("k1", "k2", *[F.sum(F.coalesce(x, F.lit(0))).over(upward).alias(x) for x in ("x1", "x2")]).where("x1 <> 0 OR x2 <> 0")
    inside = sums.groupBy("k1", "k2").agg(F.sum("x1").alias("x1"), F.sum("x2").alias("x2"))
    if deepest < BAND:
        return inside
    inside = stage.put(inside, f"inside-{level}")
    up = (F.col("pos") / BAND).cast("long").alias("pos")
    roots = values.where(F.col("pos") % BAND == 0).select("c", up, "k1", "k2")
    roots = stage.put(roots.join(inside, ["k1", "k2"], "left").na.fill(0, ["x1", "x2"]), f"roots-{level}")
    done = rollup(path.where(F.col("pos") % BAND == 0).select("c", up, "k1", "k2"), roots, deepest // BAND, stage, level + 1)
    below = roots.select("c", (F.col("pos") - 1).alias("band"), "k1", "k2").where("band >= 0").join(done, ["k1", "k2"]).select("c", "band", "x1", "x2")
    handed = path.withColumn("band", band).join(below, ["c", "band"]).select("k1", "k2", "x1", "x2")
    return stage.put(inside.unionByName(handed).groupBy("k1", "k2").agg(F.sum("x1").alias("x1"), F.sum("x2").alias("x2")), f"totals-{level}")


def _end_lists(ends: DataFrame, stage: Stage) -> DataFrame:
    """(k1, k2, sha): SHA-256 of the ids ``c`` of every node, ascending, comma-joined.

    Ids are joined to pieces of CHUNK in range partitions. A node of one piece is hashed by Spark;
    the pieces of longer lists are streamed through one hash each, in order."""
    spark = ends.sparkSession
    ranged = stage.put(ends.repartitionByRange(default_partitions(spark), "k1", "k2", "c").withColumn("part", F.spark_partition_id()), "ends")
    place = F.row_number().over(Window.partitionBy("part", "k1", "k2").orderBy("c"))
    ranged = ranged.withColumn("chunk", F.floor((place - 1) / CHUNK))
    ids = F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string"))
    pieces = stage.put(ranged.groupBy("part", "k1", "k2", "chunk").agg(F.array_join(ids, ",").alias("ids")), "pieces")
    several = stage.put(pieces.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "several")
    one = pieces.join(small(several), ["k1", "k2"], "left_anti").select("k1", "k2", F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))

    def stream(batches):
        at, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"k1": pa.array([at[0]], pa.int64()), "k2": pa.array([at[1]], pa.int64()), "sha": [state.hexdigest()]})

        for b in batches:
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if at == (k1, k2):
                    state.update(b",")
                else:
                    if at is not None:
                        yield done()
                    at, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
        if at is not None:
            yield done()

    python_tasks(spark)
    long = pieces.join(small(several), ["k1", "k2"], "left_semi").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part", "chunk")
    return one.unionByName(long.select("k1", "k2", "ids").mapInArrow(stream, "k1 long, k2 long, sha string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text;
    other columns are ignored): ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are
    left out. Equal turn numbers of a conversation (null too, which comes first) are ordered by hashes of
    role and text; repeated rows are turns of their own. Very long texts count as any
    other, very long conversations are cut over tasks. An empty table has no root, and gives an empty result.
    """
    stage = Stage(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, stage)
    path = stage.put(paths(turns, convs), "paths")
    nodes = path.groupBy("k1", "k2").agg(
        F.max("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = stage.put(nodes, "nodes")
    steps, deepest = nodes.agg(F.sum("n_convs"), F.max("depth")).first()

    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage.put(nodes.join(children, ["k1", "k2"], "left").na.fill(0, ["n_children"]), "counted")
    leaf, own = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    values = nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("pos"), "k1", "k2", leaf.alias("x1"), own.alias("x2"))
    totals = rollup(path.select("c", "pos", "k1", "k2"), values, int(deepest or 0), stage)

    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    hot = F.broadcast(parents.where(F.col("n_convs") * HOT >= (steps or 0)).drop("n_convs"))  # at most HOT rows
    rest = parents.where(F.col("n_convs") * HOT < (steps or 0)).drop("n_convs")
    below = nodes.where("depth > 0")
    named = below.join(hot, ["p1", "p2"]).unionByName(below.join(hot, ["p1", "p2"], "left_anti").join(rest, ["p1", "p2"]))
    named = named.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    last = path.join(convs.withColumnRenamed("n_turns", "pos"), ["c", "pos"]).select("k1", "k2", "c")
    out = named.join(totals, ["k1", "k2"], "left").join(_end_lists(last, stage), ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("x1", F.lit(0)).alias("n_leaves"),
        F.coalesce("x2", F.lit(0)).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def sql() -> str:
    """The same in DuckDB's SQL, by comparing whole paths."""
    step = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    bits = f"list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda crc, byte: {step})"
    return f"""
WITH t AS (SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS s, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % {FAMILY} AS base FROM t),
crc AS (SELECT c, base, xor({bits}, 4294967295) % {HEADS} AS h FROM ids),
turns AS (SELECT crc.c, t.k, t.s, t.text FROM crc JOIN t ON t.c = crc.base AND t.k <= crc.h
    UNION ALL SELECT t.c, t.k, t.s, t.text FROM t JOIN crc ON t.c = crc.c AND t.k > crc.h),
path AS (SELECT c, row_number() OVER w AS d, list(s) OVER w AS p, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
    FROM turns WINDOW w AS (PARTITION BY c ORDER BY k)
    UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM ids),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, p FROM path QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY p),
node AS (SELECT p, max(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * max(words) AS own FROM path GROUP BY p),
kids AS (SELECT a.p, count(b.p) AS n FROM node a LEFT JOIN node b ON b.d = a.d + 1 AND b.p[1:a.d] = a.p GROUP BY a.p),
subtree AS (SELECT a.p, sum(CASE WHEN kids.n = 0 THEN 1 ELSE 0 END) AS leaves, sum(b.own) AS saved
    FROM node a JOIN node b ON b.d >= a.d AND b.p[1:a.d] = a.p JOIN kids ON kids.p = b.p GROUP BY a.p)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, up.c AS parent_conv_id, node.n::BIGINT AS n_convs, kids.n::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
    saved::BIGINT AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM node JOIN kids ON node.p = kids.p JOIN subtree ON node.p = subtree.p LEFT JOIN ends ON node.p = ends.p
LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]
"""
