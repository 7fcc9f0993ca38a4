"""All blocks in one scan.

Block b (from 0) has bit b of a 64-bit mask. Each dimension is one table (value, mask of
the blocks that the value is in); the tuples are joined to the N tables one after the
other, the masks are anded, and a tuple whose mask becomes 0 is in no block and goes.
What is left, one row per tuple with the blocks it is in, gives mass, count and tuples of
every block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Options
from . import membership as mem

BITS = 63  # blocks of one mask


@dataclass
class BlockSet:
    """A block's sets: ``members`` (mode, value) without never-seen ids and their number per dimension."""

    members: DataFrame
    sizes: tuple[int, ...]


def _lookup(df: DataFrame, m: int, blocks: Sequence[BlockSet], bits: Sequence[int], default: int, vm: DataFrame, tuples: int, card: int, opts: Options):
    """(df with what it needs, mask column of dimension ``m``) for the blocks ``bits``."""
    key, name = f"a{m}", f"_m{m}"
    of = lambda b: blocks[b].members.where(F.col("mode") == m).select("value")
    bit = lambda b: F.lit(1 << b).cast("long")
    if sum(blocks[b].sizes[m] for b in bits) <= opts.broadcast_rows:
        rows = reduce(DataFrame.unionByName, [of(b).withColumn("bit", bit(b)) for b in bits])
        table = F.broadcast(rows.groupBy(F.col("value").alias(key)).agg(F.bit_or("bit").alias(name)))
        df = df.join(table, key, "left" if default else "inner")
        return df, F.coalesce(F.col(name), F.lit(0)) if default else F.col(name)
    mask = F.lit(0).cast("long")
    for b in bits:  # a large set is flagged by its bitmaps, or by a salted shuffle join
        values, n = of(b), blocks[b].sizes[m]
        hot = mem.hot_values(vm, m, tuples, values, opts) if mem.shuffles(values, n, opts, card) else None
        df = mem.flag(df, key, values, n, f"{name}_{b}", hot=hot, opts=opts, card=card)
        mask = mask.bitwiseOR(F.when(F.col(f"{name}_{b}"), bit(b)).otherwise(F.lit(0).cast("long")))
    return df, mask


def tag(
    df: DataFrame,
    blocks: Sequence[BlockSet],
    seen: Sequence[int],
    vm: DataFrame,
    tuples: int,
    cards: Sequence[int],
    opts: Options = DEFAULT,
) -> DataFrame:
    """The tuples of ``df`` that are in some block, with ``mask``: bag semantics, one scan
    for up to BITS blocks. ``seen`` is the number of seen values per dimension, ``vm`` the value
    table and ``tuples`` the size of ``df``, ``cards`` the largest ids + 1."""
    if len(blocks) > BITS:
        raise ValueError(f"at most {BITS} blocks in one scan")
    columns = df.columns
    every = (1 << len(blocks)) - 1
    df = df.withColumn("mask", F.lit(every).cast("long"))
    # the dimension in which the blocks are smallest comes first
    for m in sorted(range(len(seen)), key=lambda m: (sum(b.sizes[m] for b in blocks) / max(seen[m], 1), m)):
        bits = [b for b in range(len(blocks)) if blocks[b].sizes[m] < seen[m]]
        if not bits:  # every value is in every block
            continue
        default = every & ~sum(1 << b for b in bits)
        df, mask = _lookup(df, m, blocks, bits, default, vm, tuples, cards[m], opts)
        mask = F.col("mask").bitwiseAND(mask.bitwiseOR(F.lit(default).cast("long")))
        df = df.select(*columns, mask.alias("mask")).where("mask <> 0")
    return df


def per_block(tagged: DataFrame, n_blocks: int) -> DataFrame:
    """(block, ...): a row per tuple and block (from 1) that it is in. Every tagged tuple is in a sole one."""
    if n_blocks == 1:
        return tagged.select(F.lit(1).alias("block"), *[c for c in tagged.columns if c != "mask"])
    inside = F.filter(F.sequence(F.lit(1), F.lit(n_blocks)), lambda b: F.getbit(F.col("mask"), b - 1) == 1)
    rest = [c for c in tagged.columns if c != "mask"]
    return tagged.select(F.explode(inside).alias("block"), *rest)


def totals(tagged: DataFrame, n_blocks: int) -> dict[int, tuple[int, int]]:
    """Mass and number of tuples of every block (A6), from one aggregation; blocks without
    tuples are left out. ``n`` is the number of tuples that a row stands for."""
    rows = per_block(tagged, n_blocks).groupBy("block").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # a row per block
    return {int(r["block"]): (int(r["v"]), int(r["n"])) for r in rows}
