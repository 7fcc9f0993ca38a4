"""F2 (planted block in lineitem) and F3 (events) at sf0.001 (FIXTURES.md §4, §5)."""

import pytest

from denseblocks import find_blocks, prepare
from denseblocks.sources.tables import events_relation, planted_relation

from . import bruteforce

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted_ctx(spark):
    return prepare(planted_relation(spark, SF))


@pytest.mark.parametrize(
    "measure,policy,members,mass,tuples,density,passes",
    [
        ("geo", "density", (10, 10, 1), 1_002_901, 159, 216_068.470507, 5),
        ("geo", "cardinality", (10, 5, 3), 1_004_027, 213, 188_965.116194, 4),
        ("ari", "density", (10, 10, 1), 1_002_901, 159, 143_271.571429, 5),
        ("ari", "cardinality", (10, 5, 3), 1_004_027, 213, 167_337.833333, 4),
        ("susp", "density", (10, 10, 1), 1_002_901, 159, 2_983_296.977954, 5),
        ("susp", "cardinality", (10, 5, 3), 1_004_027, 213, 2_590_255.749486, 4),
    ],
)
def test_planted_block(spark, planted_ctx, measure, policy, members, mass, tuples, density, passes):
    ctx = planted_ctx
    assert (ctx.tuples, ctx.cards, ctx.mass) == (6050, (200, 10, 3), 1_152_257)
    res = find_blocks(ctx, k=1, measure=measure, policy=policy, theta=2.0)
    r = res.report().collect()[0]
    assert tuple(r[f"card_{i}"] for i in range(3)) == members
    assert (r["mass"], r["tuples"], r["passes"]) == (mass, tuples, passes)
    assert r["density"] == pytest.approx(density, abs=1e-6)
    got = res.members().collect()
    for m, size in enumerate(members):
        assert sorted(x["value"] for x in got if x["mode"] == m) == list(range(size))


def test_events_block(spark):
    res = find_blocks(events_relation(spark, SF), k=1, measure="susp", policy="density", theta=2.0)
    r = res.report().collect()[0]
    assert tuple(r[f"card_{i}"] for i in range(3)) == (15, 5, 124)
    assert r["density"] == pytest.approx(128.426928, abs=1e-6)
    assert r["passes"] == 4
    assert res.ctx.cards[2] == 720 and res.ctx.distinct[2] == 531  # phantoms in the hour dimension


def test_three_blocks_at_theta_1(spark):
    """Blocks, densities and pass counts of a long search against the plain-Python peel."""
    rel = planted_relation(spark, SF)
    rows = [tuple(r) for r in rel.df.select("a0", "a1", "a2", "v").collect()]
    expected = bruteforce.find_blocks(rows, 3, 3, "geo", "density", 1.0)
    report = find_blocks(rel, k=3, measure="geo", policy="density", theta=1.0).report().orderBy("block").collect()
    assert max(e["passes"] for e in expected) > 10
    for r, e in zip(report, expected, strict=True):
        assert [r[f"card_{i}"] for i in range(3)] == e["cards"]
        assert (r["mass"], r["tuples"], r["search_mass"], r["passes"]) == (e["mass"], e["tuples"], e["search_mass"], e["passes"])
        assert r["density"] == pytest.approx(e["density"], rel=1e-9) and r["search_density"] == pytest.approx(e["search_density"], rel=1e-9)
