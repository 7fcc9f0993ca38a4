
import pytest
from pyspark.sql import functions as F

from denseblocks import Options, find_blocks, prepare
from denseblocks.operators import membership as mem
from denseblocks.operators.profile import mass_check, value_masses
from denseblocks.sources.tables import planted_relation

from .conftest import F1, blocks_summary, relation_of

SF = "/root/testdata/sf0.001"


def test_mass_equal_in_every_dimension(spark):
    rel = planted_relation(spark, SF)
    rows = mass_check(value_masses(rel.df, 3)).collect()
    assert len({r["mass"] for r in rows}) == 1


def test_delta_equals_recompute_and_partitions_do_not_matter(spark):
    rel = planted_relation(spark, SF)
    a = blocks_summary(find_blocks(rel, k=2, measure="susp", policy="density", theta=2.0))
    b = blocks_summary(find_blocks(rel, k=2, measure="susp", policy="density", theta=2.0, opts=Options(update="delta")))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        c = blocks_summary(find_blocks(rel, k=2, measure="susp", policy="density", theta=2.0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b == c


def test_salted_shuffle_join_equals_broadcast(spark):
    ctx = prepare(planted_relation(spark, SF))
    vals = ctx.all_values.filter("mode = 0 AND mass > 5000").select("value")
    n = vals.count()
    hot = mem.hot_values(ctx.all_values, 0, ctx.tuples, vals, Options(hot_parts=8))
    assert hot.count() < 8
    b = mem.restrict(ctx.original, "a0", vals, n, keep=True)
    s = mem.restrict(ctx.original, "a0", vals, n, keep=True, hot=hot, opts=Options(broadcast_rows=0, bitmap_bytes=0, hot_parts=8, salts=4))
    a = mem.restrict(ctx.original, "a0", vals, n, keep=False, hot=hot, opts=Options(broadcast_rows=0, bitmap_bytes=0, hot_parts=8, salts=4))
    assert sorted(b.collect()) == sorted(s.collect())
    assert s.count() + a.count() == ctx.original.count()
    f = mem.flag(ctx.original, "a0", vals, n, "f", hot=hot, opts=Options(broadcast_rows=0, bitmap_bytes=0, hot_parts=8, salts=4))
    assert f.filter("f").count() == b.count()


def test_deflation_lowers_mass_by_search_mass(spark):
    res = find_blocks(relation_of(spark, F1, 3), k=2, measure="geo", policy="density", theta=1.0)
    b1, b2 = res.blocks
    assert b1.found.search_mass == 32
    # block 2 was searched on 41 - 32 = 9 units of mass
    assert b2.found.log[0].mass_before == 9


def test_theta_below_one_rejected(spark):
    with pytest.raises(ValueError):
        find_blocks(relation_of(spark, F1, 3), k=1, theta=0.5)


def test_invalid_rows_failfast_or_drop(spark):
    rel = relation_of(spark, F1 + [(1, 1, 1, 0), (-1, 0, 0, 3)], 3)
    with pytest.raises(ValueError):
        find_blocks(rel, k=1)
    ctx = prepare(rel, validate="drop")
    assert ctx.tuples == 12


def test_single_dimension_one_tuple_and_large_mass(spark):
    res = find_blocks(relation_of(spark, [(3, 2**33)], 1), k=1, measure="geo", policy="density", theta=1.0)
    r = res.report().collect()[0]
    assert r["mass"] == 2**33 and r["card_0"] == 1
    assert r["tuples"] == 1


def test_k_beyond_exhaustion(spark):
    res = find_blocks(relation_of(spark, [(0, 0, 1), (1, 1, 1)], 2), k=4, measure="geo", policy="density", theta=1.0)
    rep = res.report().orderBy("block").collect()
    assert len(rep) == 4
    # once nothing is left the next block is the whole relation (reference behaviour)
    assert rep[-1]["card_0"] == 2 and rep[-1]["card_1"] == 2
    res2 = find_blocks(relation_of(spark, [(0, 0, 1), (1, 1, 1)], 2), k=4, stop_when_empty=True)
    assert len(res2.blocks) <= 4


def test_distinct_cardinality_option(spark):
    rel = relation_of(spark, [(0, 0, 5), (10, 0, 5), (10, 7, 1)], 2)
    ctx = prepare(rel, cardinality="distinct")
    assert ctx.cards == (2, 2) and ctx.phantoms == (0, 0)
    ctx2 = prepare(rel)
    assert ctx2.cards == (11, 8) and ctx2.phantoms == (9, 6)
    # phantoms that belong to a block are enumerated in its members
    res = find_blocks(ctx2, k=1, measure="geo", policy="density", theta=1.0)
    n = res.members().filter(F.col("block") == 1).count()
    assert n == sum(res.blocks[0].found.cards)


def test_early_exit_finds_the_same_blocks(spark):
    import random

    from . import bruteforce

    rng = random.Random(7)
    for i in range(3):
        n = 3
        rows = [tuple(rng.randint(0, 5) for _ in range(n)) + (rng.choice([1, 2, 5]),) for _ in range(20)]
        measure = ["geo", "ari", "susp"][i]
        exp = bruteforce.find_blocks(rows, n, 2, measure, "density", 1.0)
        res = find_blocks(relation_of(spark, rows, n), k=2, measure=measure, policy="density", theta=1.0,
                          opts=Options(early_exit=True))
        for (sets, rep), e in zip(blocks_summary(res), exp):
            assert [set(x) for x in sets] == e["members"]
            assert rep["mass"] == e["mass"]
            assert rep["density"] == pytest.approx(e["density"], rel=1e-9, abs=1e-9)
            assert rep["passes"] <= e["passes"]


def test_shuffle_paths_give_the_same_blocks(spark):
    """Force every membership join onto the salted shuffle path (tiny
    broadcast limit, few hot-key partitions) for a whole k = 2 search."""
    rel = planted_relation(spark, SF)
    a = blocks_summary(find_blocks(rel, k=2, measure="geo", policy="cardinality", theta=2.0))
    forced = Options(broadcast_rows=3, bitmap_bytes=0, hot_parts=16, salts=4)
    b = blocks_summary(find_blocks(rel, k=2, measure="geo", policy="cardinality", theta=2.0, opts=forced))
    assert a == b
