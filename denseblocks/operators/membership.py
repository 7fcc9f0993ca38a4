"""Membership joins: keep / drop / flag tuples by whether one dimension's
value is in a set (P10, J1-J3).

Strategy, decided from exact row counts that the caller already knows:

* set size <= ``broadcast_rows``: broadcast hash semi / anti / outer join,
  no exchange at all;
* larger, but its bitmaps take at most ``bitmap_bytes``: ids are dense integers, so the
  set is cut into chunks of CHUNK ids with one bit for each, the chunks are broadcast and
  the bit is tested in the join: no exchange either, at a bit an id instead of a hashed row;
* larger still: shuffle join on the key. Values that hold a large share of the
  tuples (the *hot* set: tuples >= total / ``hot_parts``, so at most
  ``hot_parts`` of them exist) are decided by a broadcast join first; their tuples then get one of ``salts`` fake negative
  keys, so the shuffle spreads them evenly instead of sending them all to one
  task. Ids are validated non-negative, so fake keys never match a real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Options

_HOT = "_hot_in"
_JK = "_jk"
_IN = "_in"
_CHUNK = "_chunk"
_WORDS = "_words"

CHUNK = 1 << 15  # ids of a chunk: what Spark's bitmap functions put into one bitmap
CHUNK_BYTES = CHUNK // 8 + 128  # of a chunk as a row


# ---------------------------------------------------------------------------
# bitmaps
# ---------------------------------------------------------------------------


def bitmaps(values: DataFrame) -> DataFrame:
    """(_chunk, _words): the set as bitmaps, 512 words of 64 bits a chunk."""
    chunks = values.groupBy(F.bitmap_bucket_number("value").alias(_CHUNK)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"))
    word = lambda i: F.conv(F.substring(F.col("text"), i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    return chunks.select(_CHUNK, F.hex("bits").alias("text")).select(_CHUNK, F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), word).alias(_WORDS))


def _bit(key: str) -> Column:
    """Is the bit of ``key`` set in the chunk's words? A word's first byte is its highest."""
    at = F.bitmap_bit_position(F.col(key)).cast("int")
    bit = (F.lit(7) - F.shiftright(at.bitwiseAND(63), 3)) * 8 + at.bitwiseAND(7)
    return F.getbit(F.get(F.col(_WORDS), F.shiftright(at, 6)), bit) == 1


def bitmaps_fit(values: DataFrame, n_values: int, card: int | None, opts: Options) -> bool:
    """Do the bitmaps of ``values`` take at most ``bitmap_bytes``? Known from the largest
    id (``card`` - 1) or the number of values if those bound the chunks tightly enough; else the
    chunks are counted."""
    most = opts.bitmap_bytes // CHUNK_BYTES
    if most == 0 or n_values > most * CHUNK:
        return False
    bound = n_values if card is None else min(n_values, card // CHUNK + 2)
    return bound <= most or values.select(F.bitmap_bucket_number("value").alias("c")).distinct().count() <= most


def _by_bitmap(df: DataFrame, key: str, values: DataFrame, how: str) -> DataFrame:
    chunks = F.broadcast(bitmaps(values))
    return df.join(chunks, (F.bitmap_bucket_number(F.col(key)) == F.col(_CHUNK)) & _bit(key), how)


# ---------------------------------------------------------------------------
# sets of values
# ---------------------------------------------------------------------------


def shuffles(values: DataFrame, n_values: int, opts: Options, card: int | None = None) -> bool:
    """Is the set too large for both kinds of broadcast?"""
    return n_values > opts.broadcast_rows and not bitmaps_fit(values, n_values, card, opts)


def _salted_key(df: DataFrame, key: str, salts: int):
    # dealt by place, so that identical tuples spread as well
    fake = F.lit(-1) - F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    return F.when(F.col(_HOT).isNull(), F.col(key)).otherwise(fake)


def restrict(
    df: DataFrame,
    key: str,
    values: DataFrame,
    n_values: int,
    *,
    keep: bool,
    hot: DataFrame | None = None,
    opts: Options = DEFAULT,
    card: int | None = None,
) -> DataFrame:
    """Tuples of ``df`` whose ``key`` is (keep=True) or is not (keep=False) in
    ``values`` (one distinct column ``value``)."""
    how = "left_semi" if keep else "left_anti"
    right = values.select(F.col("value").alias(key))
    if n_values <= opts.broadcast_rows:
        return df.join(F.broadcast(right), key, how)
    if bitmaps_fit(values, n_values, card, opts):
        return _by_bitmap(df, key, values, how)
    if hot is None:
        return df.join(right, key, how)
    cols = df.columns
    x = df.join(F.broadcast(hot.select(F.col("value").alias(key), F.col("inset").alias(_HOT))), key, "left")
    decided_out = ~F.col(_HOT) if keep else F.col(_HOT)
    x = x.filter(~F.coalesce(decided_out, F.lit(False)))
    x = x.withColumn(_JK, _salted_key(x, key, opts.salts))
    r = values.select(F.col("value").alias(_JK))
    if keep:  # hot members carry fake keys: make them match
        spark = df.sparkSession
        r = r.unionByName(spark.range(-opts.salts, 0).select(F.col("id").alias(_JK)))
    return x.join(r, _JK, how).select(*cols)


def flag(
    df: DataFrame,
    key: str,
    values: DataFrame,
    n_values: int,
    name: str,
    *,
    hot: DataFrame | None = None,
    opts: Options = DEFAULT,
    card: int | None = None,
) -> DataFrame:
    """``df`` plus a non-null boolean column ``name``: is ``key`` in ``values``."""
    cols = df.columns
    right = values.select(F.col("value").alias(key), F.lit(True).alias(_IN))
    if n_values <= opts.broadcast_rows:
        return df.join(F.broadcast(right), key, "left").select(*cols, F.coalesce(F.col(_IN), F.lit(False)).alias(name))
    if bitmaps_fit(values, n_values, card, opts):
        return _by_bitmap(df, key, values, "left").select(*cols, F.col(_CHUNK).isNotNull().alias(name))
    if hot is None:
        return df.join(right, key, "left").select(*cols, F.coalesce(F.col(_IN), F.lit(False)).alias(name))
    x = df.join(F.broadcast(hot.select(F.col("value").alias(key), F.col("inset").alias(_HOT))), key, "left")
    x = x.withColumn(_JK, _salted_key(x, key, opts.salts))
    r = values.select(F.col("value").alias(_JK), F.lit(True).alias(_IN))
    return x.join(r, _JK, "left").select(*cols, F.coalesce(F.col(_HOT), F.col(_IN), F.lit(False)).alias(name))


def hot_values(vm: DataFrame, mode: int, total_tuples: int, members, opts: Options = DEFAULT) -> DataFrame:
    """Hot values of one dimension with their set membership (value, inset).

    ``vm`` has (mode, value, tuples); hot means ``tuples >= total / hot_parts``,
    which at most ``hot_parts`` values can satisfy. ``members`` is either a
    boolean Column over ``vm`` or a DataFrame with column ``value``.
    """
    h = vm.filter((F.col("mode") == mode) & (F.col("tuples") >= F.lit(-(-max(total_tuples, 1) // opts.hot_parts))))
    if not isinstance(members, DataFrame):
        return h.select("value", F.coalesce(members, F.lit(False)).alias("inset"))
    h = h.select("value")
    hot_members = members.select("value").join(F.broadcast(h), "value", "left_semi")
    return h.join(F.broadcast(hot_members.withColumn("inset", F.lit(True))), "value", "left").select(
        "value", F.coalesce("inset", F.lit(False)).alias("inset")
    )
