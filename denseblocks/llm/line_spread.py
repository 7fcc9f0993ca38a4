"""Line dedup by the number of distinct sites that a line is on.

Sites are counted over distinct texts: a text and all its copies have one site, that of the copy
with the smallest id, so a document copied to many sites is no boilerplate. A HyperLogLog sketch
per line hash, merged by Spark's partial aggregation, estimates on how many sites a line is.
Lines well above the threshold are boilerplate, those well below are not; for lines whose
estimate lies near the threshold the sites are counted exactly. Boilerplate lines are then
removed from every document but the one with the smallest id, so that no line leaves
the corpus.

Short lines recur by chance and need SITES sites; a line of LONG words or more does not, two
sites are enough for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, word_count

SITES = 5  # a line on so many distinct sites is boilerplate
LONG, LONG_SITES = 50, 2  # a line of so many words on so many
LG_K = 10  # 1024 registers: a standard error of 3 %
NEAR = 0.25  # estimates within this share of the threshold are counted exactly, 8 standard errors
BROADCAST_BYTES = 32 << 20  # of hashes of lines, or of the removed lines of documents


def _broadcast(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if its rows of ``size`` bytes are few enough."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, site, lines): the lines of each document as hashes a, b, with whether they
    are long; blank ones are null."""
    line = lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (word_count(x) >= LONG).alias("long")))
    site = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site")
    return docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), site, F.transform(F.split("text", "\n", -1), line).alias("lines"))


def boilerplate(rows: DataFrame, sites: int, stage: Stage) -> DataFrame:
    """(a, b, keep): the lines on too many sites, and the smallest id of their documents (null
    ids last). ``rows`` is the result of ``_hashed``."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "site")).alias("first")
    texts = rows.groupBy("th").agg(first, F.first("lines").alias("lines"))
    lines = texts.select("first", F.inline(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))))
    lines = stage.put(lines.select("a", "b", "long", F.col("first.site").alias("site"), F.struct("first.col1", "first.doc_id").alias("id")), "lines")
    need = F.when(F.col("long"), min(sites, LONG_SITES)).otherwise(sites)
    guess = lines.groupBy("a", "b", "long").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("id"))
    guess = guess.select("a", "b", "id", need.alias("need"), F.hll_sketch_estimate("sketch").alias("guess")).where(F.col("guess") >= F.col("need") * (1 - NEAR))
    guess = stage.put(guess, "guess")
    near = guess.where(F.col("guess") <= F.col("need") * (1 + NEAR))
    some = lines.join(_broadcast(near.select("a", "b"), F.lit(12)), ["a", "b"], "left_semi").select("a", "b", "site").distinct()
    exact = some.groupBy("a", "b").agg(F.count("*").alias("n")).join(near, ["a", "b"]).where(F.col("n") >= F.col("need"))
    sure = guess.where(F.col("guess") > F.col("need") * (1 + NEAR))
    return stage.put(sure.select("a", "b", "id.doc_id").unionByName(exact.select("a", "b", "id.doc_id")).withColumnRenamed("doc_id", "keep"), "boilerplate")


def remove_spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored):
    ``doc_id, n_lines, n_removed, text`` (the kept lines, in order).

    A null text stays null with no lines; blank lines are kept and count as lines. A null
    source is one site. A line stays in the document with the smallest id that has it (in
    those without an id, if none has one), as often as it has it. Repeated rows come back repeated.
    Very long texts are read whole. An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "lines")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "source")
    rows = stage.put(_hashed(docs), "hashed")
    bad = boilerplate(rows, sites, stage)
    # the removed lines of a document as bits of its line numbers, 64 a word
    spots = rows.select("doc_id", "th", F.posexplode("lines").alias("at", "line")).select("doc_id", "th", "at", "line.a", "line.b")
    spots = spots.join(_broadcast(bad, F.lit(20)), ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keep"))).select("doc_id", "th", "at")
    words = spots.groupBy("doc_id", "th", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
    hits = words.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("bits"))), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")))
    hits = stage.put(hits.select("id", "t", dense.alias("gone")), "hits")
    docs = docs.withColumn("th", F.xxhash64("text"))
    out = docs.join(_broadcast(hits, 24 + 8 * F.size("gone")), docs.doc_id.eqNullSafe(F.col("id")) & (docs.th == F.col("t")), "left")
    parts = F.split("text", "\n", -1)
    stays = lambda x, i: F.coalesce(F.getbit(F.get("gone", F.shiftright(i, 6)), i.bitwiseAND(63)), F.lit(0)) == 0
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, stays)))
    count = lambda x: F.when(F.col("text").isNull(), 0).otherwise(F.size(x)).cast("long")
    return out.select("doc_id", count(parts).alias("n_lines"), (count(parts) - count("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def sql(sites: int = SITES) -> str:
    """The same in DuckDB's SQL, with exact counts for all lines."""
    words = "len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
texts AS (SELECT DISTINCT ON (text) text, site, doc_id FROM d WHERE text IS NOT NULL ORDER BY text, doc_id NULLS LAST, site),
lines AS (SELECT site, doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
bad AS (SELECT line, min(doc_id) AS keep FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN {words} >= {LONG} THEN {min(sites, LONG_SITES)} ELSE {sites} END),
spots AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(s.line, chr(10) ORDER BY pos) AS text FROM spots s
    WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.line = s.line AND bad.keep IS DISTINCT FROM s.doc_id) GROUP BY r)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON d.r = kept.r
"""
