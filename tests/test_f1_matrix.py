"""F1 hand fixture: all measures x policies x theta, two blocks (FIXTURES.md §3)."""

import pytest

from denseblocks import find_blocks

from .conftest import F1, blocks_summary, relation_of

# block 2: (members, mass, tuples, density, search density, passes)
BLOCK2 = {
    ("ari", "density", 1.0): ([[4], [3, 4], [3]], 5, 2, 3.75, 3.75, 8),
    ("ari", "density", 2.0): ([[4], [3, 4], [3]], 5, 2, 3.75, 3.75, 6),
    ("ari", "cardinality", 1.0): ([[2, 4], [3, 4], [3]], 6, 3, 3.6, 3.6, 6),
    ("ari", "cardinality", 2.0): ([[4], [4], [3]], 3, 1, 3.0, 3.0, 6),
    ("geo", "density", 1.0): ([[4], [3, 4], [3]], 5, 2, 3.968503, 3.968503, 8),
    ("geo", "density", 2.0): ([[4], [3, 4], [3]], 5, 2, 3.968503, 3.968503, 6),
    ("geo", "cardinality", 1.0): ([[2, 4], [3, 4], [3]], 6, 3, 3.779763, 3.779763, 6),
    ("geo", "cardinality", 2.0): ([[4], [4], [3]], 3, 1, 3.0, 3.0, 6),
    ("susp", "density", 1.0): ([[4], [3, 4], [3]], 5, 2, 5.634385, 12.682789, 7),
    ("susp", "density", 2.0): ([[4], [3, 4], [3]], 5, 2, 5.634385, 12.682789, 6),
    ("susp", "cardinality", 1.0): ([[2, 4], [3, 4], [3]], 6, 3, 4.242975, 12.274394, 6),
    ("susp", "cardinality", 2.0): ([[4], [4], [3]], 3, 1, 3.859263, 8.141638, 6),
}
BLOCK1_DENSITY = {"ari": 16.0, "geo": 16.0, "susp": 49.460183}


@pytest.mark.parametrize("measure,policy,theta", sorted(BLOCK2))
def test_f1_two_blocks(spark, measure, policy, theta):
    res = find_blocks(relation_of(spark, F1, 3), k=2, measure=measure, policy=policy, theta=theta)
    (m1, r1), (m2, r2) = blocks_summary(res)
    assert m1 == [[0, 1], [0, 1], [0, 1]]
    assert r1["mass"] == 32 and r1["tuples"] == 6
    assert r1["density"] == pytest.approx(BLOCK1_DENSITY[measure], abs=1e-6)
    assert r1["passes"] == (9 if theta == 1.0 else 6)
    members, mass, tuples, dens, search, passes = BLOCK2[(measure, policy, theta)]
    assert m2 == members
    assert (r2["mass"], r2["tuples"], r2["passes"]) == (mass, tuples, passes)
    assert r2["density"] == pytest.approx(dens, abs=1e-6)
    assert r2["search_density"] == pytest.approx(search, abs=1e-6)
    assert [r2[f"card_{i}"] for i in range(3)] == [len(s) for s in members]


def test_f1_trace_geo_density_theta1(spark):
    res = find_blocks(relation_of(spark, F1, 3), k=1, measure="geo", policy="density", theta=1.0)
    log = res.blocks[0].found.log
    # pass, mode, mass before, alive before, removed (FIXTURES.md §3 trace)
    expected = [
        (0, 41, (6, 5, 4), 4), (1, 32, (2, 5, 4), 3), (2, 32, (2, 2, 4), 2), (2, 32, (2, 2, 2), 1),
        (1, 20, (2, 2, 1), 1), (0, 11, (2, 1, 1), 1), (2, 6, (1, 1, 1), 1),
    ]
    got = [(p.mode, p.mass_before, p.alive_before, p.k) for p in log]
    assert got == expected
    assert log[0].threshold == pytest.approx(6.8333, abs=1e-4)
    assert res.blocks[0].found.passes == 9
