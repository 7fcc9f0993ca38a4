"""Blocks by masks, sets by bitmaps, tuples in buckets: plans and results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from denseblocks import Options, find_blocks, prepare
from denseblocks.operators import masks
from denseblocks.operators import membership as mem
from denseblocks.plans import search
from denseblocks.sources import sinks

from .conftest import blocks_summary, relation_of

N = 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def relation(spark, seed=1, n=400, size=30):
    rng = random.Random(seed)
    rows = [tuple(rng.randrange(size) for _ in range(N)) + (rng.choice([1, 2, 3]),) for _ in range(n)]
    rows += [(rng.randrange(4), rng.randrange(4), rng.randrange(4), 50) for _ in range(40)] + [(10 + rng.randrange(3), 10, 10, 30) for _ in range(20)]
    return rows, relation_of(spark, rows, N)


def members_of(res):
    got = {}
    for r in res.members().collect():
        got.setdefault(r["block"], [set() for _ in range(N)])[r["mode"]].add(r["value"])
    return got


@pytest.mark.parametrize("opts", [Options(), Options(broadcast_rows=2), Options(broadcast_rows=2, bitmap_bytes=0, hot_parts=4, salts=3)], ids=["rows", "bits", "shuffle"])
def test_all_blocks_from_one_scan(spark, opts):
    rows, rel = relation(spark)
    res = find_blocks(rel, k=3, measure="ari", policy="density", theta=2.5, opts=opts)
    sets = members_of(res)
    inside = lambda b: sorted(t for t in rows if all(t[m] in sets[b][m] for m in range(N)))
    report = {r["block"]: r for r in res.report().collect()}
    tuples = res.tuples().collect()
    for b in sets:
        assert (report[b]["mass"], report[b]["tuples"]) == (sum(t[N] for t in inside(b)), len(inside(b)))
        assert sorted(tuple(r)[1:] for r in tuples if r["block"] == b) == inside(b)
    if opts == Options():
        tagged = search.tag_blocks(res.ctx, res.ctx.rows, res.blocks, res.ctx.n_rows)
        text = plan_of(masks.per_block(tagged, len(res.blocks)).groupBy("block").agg(F.sum("v")))
        assert text.count("Scan ExistingRDD") == 1 and "SortMergeJoin" not in text


@pytest.mark.parametrize("whole", [True, False])
def test_sole_block_is_written_without_a_sort(spark, tmp_path, whole):
    """The tuples of a sole block, a part of the relation or all of it, go to the files as they come."""
    rows = [(a, b, c, 1) for a in range(3) for b in range(3) for c in range(3)] * 2 if whole else relation(spark)[0]
    res = find_blocks(relation_of(spark, rows, N), k=1, measure="geo", policy="density", theta=2.0)
    sets = members_of(res)[1]
    inside = sorted(t for t in rows if all(t[m] in sets[m] for m in range(N)))
    assert (len(inside) == len(rows)) == whole and bool(res.hits) != whole
    assert sorted(tuple(r) for r in res.tuples().collect()) == [(1, *t) for t in inside]
    assert "Generate" not in plan_of(res.tuples())
    # what a write by ``block`` asks of its input
    text = plan_of(res.tuples().sortWithinPartitions("block"))
    assert "Sort " not in text
    sinks.write_blocks(res, str(tmp_path))
    files = spark.read.csv(f"{tmp_path}/tuples", schema="a0 long, a1 long, a2 long, v long, block int")
    assert sorted((r["block"], r["a0"], r["a1"], r["a2"], r["v"]) for r in files.collect()) == [(1, *t) for t in inside]


def test_more_than_one_mask(spark, monkeypatch):
    monkeypatch.setattr(search, "BITS", 2)
    rows, rel = relation(spark, 2)
    res = find_blocks(rel, k=3, measure="ari", policy="density", theta=1.5)
    sets = members_of(res)
    got = [r["tuples"] for r in res.report().orderBy("block").collect()]
    assert got == [sum(all(t[m] in sets[b][m] for m in range(N)) for t in rows) for b in sorted(sets)]
    with pytest.raises(ValueError):
        masks.tag(rel.df, [masks.BlockSet(None, (1, 1, 1))] * 64, (2, 2, 2), None, 1, (2, 2, 2))


def test_bitmaps_equal_sets(spark):
    rng = random.Random(3)
    values = sorted({0, 1, 63, 64, 32767, 32768, 32769, 65536, 10**12, 10**12 + 1, *[rng.randrange(10**6) for _ in range(3000)]})
    v = spark.createDataFrame([(x,) for x in values], "value long")
    probe = sorted({*values, *[x + 1 for x in values], *range(200)})
    t = spark.createDataFrame([(x, 1) for x in probe for _ in range(2)], "a0 long, v long")
    opts = Options(broadcast_rows=10)
    inside = set(values)
    kept = mem.restrict(t, "a0", v, len(values), keep=True, opts=opts)
    assert sorted(r["a0"] for r in kept.collect()) == sorted(x for x in probe for _ in range(2) if x in inside)
    left = mem.restrict(t, "a0", v, len(values), keep=False, opts=opts)
    assert sorted(r["a0"] for r in left.collect()) == sorted(x for x in probe for _ in range(2) if x not in inside)
    flagged = mem.flag(t, "a0", v, len(values), "f", opts=opts).distinct().collect()
    assert {r["a0"] for r in flagged if r["f"]} == inside and len(flagged) == len(probe)
    text = plan_of(kept)
    # the probed side reaches the join without an exchange; the set's side has its aggregation
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning(a0" not in text


def test_bitmaps_are_chosen_by_their_size(spark):
    few = spark.createDataFrame([(i * 10**6,) for i in range(50)], "value long")
    chunk = mem.CHUNK_BYTES
    assert mem.bitmaps_fit(few, 50, None, Options(bitmap_bytes=60 * chunk))  # bounded by the number of values
    assert not mem.bitmaps_fit(few, 50, 50 * 10**6, Options(bitmap_bytes=40 * chunk))  # each in a chunk of its own
    dense = spark.range(5000).withColumnRenamed("id", "value")
    assert mem.bitmaps_fit(dense, 5000, 5000, Options(bitmap_bytes=2 * chunk))  # bounded by the largest id
    assert mem.bitmaps_fit(dense, 5000, 10**12, Options(bitmap_bytes=2 * chunk))  # counted
    assert not mem.bitmaps_fit(dense, 5000, 5000, Options(bitmap_bytes=0))


def test_bucketed_tuples_are_not_moved(spark):
    rows, rel = relation(spark, 4, n=1500, size=60)
    rows = rows + [(7, i % 60, i % 50, 1) for i in range(600)] + [(60 + i, 0, 0, 1) for i in range(40)]  # a hot value of the largest dimension
    rel = relation_of(spark, rows, N)
    opts = Options(broadcast_rows=2, bitmap_bytes=0, hot_parts=8, salts=3, layout="bucketed", merge="never")
    ctx = prepare(rel, opts)
    seen = list(ctx.distinct)
    base = search.write_base(ctx, ctx.rows, ctx.all_values, seen, ctx.n_rows, None)
    cold, hot, hot_values = search.open_base(ctx, base, ctx.rows)
    key = f"a{base.key}"
    assert cold.count() + hot.count() == len(rows) and hot.count() >= 600
    removed = ctx.all_values.withColumn("rpass", F.when((F.col("mode") == base.key) & (F.col("value") % 2 == 1), 0))
    n = [0] * N
    n[base.key] = removed.where("rpass = 0").count()
    kept = [s - r for s, r in zip(seen, n)]
    out, shuffled = search.surviving_tuples(cold, removed, 0, n, kept, ctx.n_rows, opts, ctx.ids, (base.key, hot_values, hot))
    assert not shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # or the few values here are broadcast
    try:
        text = plan_of(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = text[text.index("SortMergeJoin") :]
    tuples_side = side[: side.index("Bucketed: true")]
    assert not re.search(r"Exchange", tuples_side), tuples_side
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(t for t in rows if t[base.key] % 2 == 0)
    # a session that did not write it can open it
    spark.sql(f"DROP TABLE {base.name}")
    again, _, _ = search.open_base(ctx, base, ctx.rows)
    assert again.count() == cold.count() and key in again.columns


@pytest.mark.parametrize("opts", [Options(broadcast_rows=2), Options(broadcast_rows=2, bitmap_bytes=0, hot_parts=8, salts=3, layout="bucketed"), Options(update="delta", histogram="delta")], ids=["bits", "buckets", "moved"])
def test_whole_searches_agree(spark, opts):
    _, rel = relation(spark, 5)
    usual = blocks_summary(find_blocks(rel, k=2, measure="geo", policy="density", theta=1.8))
    assert blocks_summary(find_blocks(rel, k=2, measure="geo", policy="density", theta=1.8, opts=opts)) == usual
