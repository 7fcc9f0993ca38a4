"""Benchmark decontamination with SimHash windows, with DataFrame operations only.

1. *Windows.* A document is cut into windows as long as a benchmark item. Of all
   positions only those matter where some 5-word shingle of the window stands where it
   does in an item of that length: a window that is similar enough has one, as an equal
   shingle is the least that the threshold asks for. Equal windows of all documents
   (of a passage that many share) become one.
2. *Fingerprints.* A 64-bit SimHash of the window's words, each weighted by how often it
   occurs. Items and windows of one length are joined on RADIUS + 1 blocks of the
   fingerprint: of two fingerprints that differ in at most RADIUS bits one block is equal.
3. *Verification.* The exact weighted Jaccard similarity of the 5-word shingles (each as
   often as it occurs) decides.

Documents are read twice, the second time only those with a window. Items and their
shingles are broadcast after a check of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stage, keyed_rows, small, small_bytes

SHINGLE = 5
RADIUS = 15  # bits; 16 blocks of 4 bits
BLOCKS = RADIUS + 1
PERCENT = 80  # least similarity


def words(text: Column) -> Column:
    """Lower-case words of a text; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda w: w != "")


def _hashes(ws: str, n: str, k: int) -> Column:
    """Hashes of the k-word shingles of array column ``ws`` with ``n`` words, in order."""
    return F.expr(f"CASE WHEN {n} >= {k} THEN transform(sequence(0, {n} - {k}), i -> xxhash64({', '.join(f'{ws}[i + {j}]' for j in range(k))})) ELSE array() END")


def _counted(ws: str) -> Column:
    """Shingles of an array of words as strings, the second of two equal ones told apart, and
    so on: sets of them have the weighted similarity of the shingles. Fewer than SHINGLE
    words are one shingle."""
    plain = f"CASE WHEN size({ws}) < {SHINGLE} THEN array(array_join({ws}, ' ')) ELSE transform(sequence(1, size({ws}) - {SHINGLE - 1}), i -> array_join(slice({ws}, i, {SHINGLE}), ' ')) END"
    return F.expr(f"transform({plain}, (s, i) -> concat(s, '\\n', size(filter(slice({plain}, 1, i), o -> o = s))))")


def _simhash(ws: str) -> Column:
    sums = f"aggregate({ws}, array_repeat(0, 64), (acc, w) -> zip_with(acc, sequence(0, 63), (a, i) -> a + CASE WHEN (shiftright(xxhash64(w), i) & 1L) = 1 THEN 1 ELSE -1 END))"
    return F.expr(f"aggregate(zip_with({sums}, sequence(0, 63), (s, i) -> CASE WHEN s > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (acc, b) -> acc | b)")


def _blocks(fp: str) -> Column:
    width = 64 // BLOCKS
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> struct(i AS block, shiftrightunsigned({fp}, cast({width} * i AS int)) & {(1 << width) - 1}L AS bits))")


def matches(docs: DataFrame, benchmark: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, th, item_id, start, similarity): windows of documents (by id and hash of
    their text) that are at least PERCENT similar to an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("iw")).withColumn("len", F.size("iw")).where("len > 0 AND item_id IS NOT NULL")
    items = stage.put(items.withColumn("fp", _simhash("iw")), "items")
    n_items = items.count()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))

    seeds = None
    for (k,) in items.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect():  # SHINGLE rows at most
        of_k = items.where(F.least("len", F.lit(SHINGLE)) == k)
        shingles = of_k.select("len", F.posexplode(_hashes("iw", "len", k)).alias("q", "h")).distinct()
        at = keyed.select("doc_id", "th", "n", F.posexplode(_hashes("ws", "n", k)).alias("p", "h")).join(small(shingles), "h")
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("len")))
        at = at.select("doc_id", "th", "len", start.cast("int").alias("start"))
        seeds = at if seeds is None else seeds.unionByName(at)
    if seeds is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, start int, similarity double")
    seeds = stage.put(seeds.distinct(), "seeds")

    # the windows' words, from the documents that have windows
    per_doc = seeds.groupBy("doc_id", "th").agg(F.collect_list(F.struct("len", "start")).alias("at"))
    per_doc = per_doc.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    have = small(seeds.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct())
    texts = keyed.drop("n").join(have, keyed.doc_id.eqNullSafe(F.col("d")) & (keyed.th == F.col("t")), "left_semi").dropDuplicates(["doc_id", "th"])
    windows = texts.join(per_doc, texts.doc_id.eqNullSafe(F.col("d")) & (texts.th == F.col("t")))
    windows = windows.select("doc_id", "th", "ws", F.explode("at").alias("a")).select("doc_id", "th", "a.len", "a.start", F.expr("slice(ws, a.start + 1, a.len)").alias("ww"))
    windows = stage.put(windows.withColumn("key", F.unhex(F.md5(F.array_join("ww", " ").cast("binary")))), "windows")

    once = windows.groupBy("key", "len").agg(F.first("ww").alias("ww"))
    once = stage.put(once.withColumn("fp", _simhash("ww")), "fingerprints")
    left = once.select("key", "len", "fp", F.explode(_blocks("fp")).alias("b")).select("key", "len", "fp", "b.block", "b.bits")
    right = items.select("item_id", "len", F.col("fp").alias("ifp"), F.explode(_blocks("fp")).alias("b")).select("item_id", "len", "ifp", "b.block", "b.bits")
    near = left.join(small(right, n_items * BLOCKS), ["len", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    near = near.select("key", "len", "item_id").distinct()
    near = near.join(once.select("key", "len", "ww"), ["key", "len"]).join(small_bytes(items.select("item_id", "len", "iw"), F.octet_length(F.array_join("iw", " ")) + 16 * F.size("iw")), ["item_id", "len"])
    near = near.withColumn("a", _counted("ww")).withColumn("b", _counted("iw"))
    both = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - both
    sure = near.where(100 * both >= PERCENT * union).select("key", "len", "item_id", (both / union).alias("similarity"))
    sure = stage.put(sure, "sure")
    return windows.select("doc_id", "th", "len", "start", "key").join(small(sure), ["key", "len"]).select("doc_id", "th", "item_id", "start", "similarity")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): ``doc_id,
    n_items, item_ids`` (sorted), ``similarity`` (of the best window, else 0), ``contaminated``.

    Null and blank texts have no window; null and blank items, and items without an id,
    match nothing. Repeated rows come back repeated; equal items all count. An empty
    table gives an empty result; an empty benchmark contaminates nothing.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    benchmark = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    found = matches(docs, benchmark, stage).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "item_ids", "similarity")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(found, rows.doc_id.eqNullSafe(found.d) & (rows.th == found.t), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("item_ids").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, in which no window matches an item."""
    stage = Stage(docs.sparkSession, "decontaminate")
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = matches(keyed, benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), stage)
    bad = small(stage.put(bad.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct(), "bad"))
    return keyed_rows(docs).join(bad, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left_anti").select("row.*")
