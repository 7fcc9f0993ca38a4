"""Random small relations (F5) against the plain-Python peel."""

import random

import pytest

from denseblocks import Options, find_blocks

from . import bruteforce
from .conftest import relation_of


def _cases():
    rng = random.Random(42)
    cases = []
    for i in range(10):
        n = rng.choice([1, 2, 3, 4])
        rows = []
        for _ in range(rng.randint(1, 25)):
            rows.append(tuple(rng.randint(0, 6) for _ in range(n)) + (rng.choice([1, 1, 2, 3]),))
        measure = ["ari", "geo", "susp"][i % 3]
        policy = ["density", "cardinality"][(i // 3) % 2]
        theta = [1.0, 1.3, 2.0, 4.0][i % 4]
        cases.append((i, n, rows, measure, policy, theta))
    return cases


@pytest.mark.parametrize("case", _cases(), ids=lambda c: f"case{c[0]}-{c[3]}-{c[4]}-{c[5]}")
def test_matches_bruteforce(spark, case):
    _, n, rows, measure, policy, theta = case
    k = 2
    expected = bruteforce.find_blocks(rows, n, k, measure, policy, theta)
    opts = [Options(merge="never"), Options(broadcast_rows=1, bitmap_bytes=0), Options(broadcast_rows=1, merge="always"), Options(histogram="delta")][case[0] % 4]
    res = find_blocks(relation_of(spark, rows, n), k=k, measure=measure, policy=policy, theta=theta, opts=opts)
    mem = res.members().collect()
    rep = {r["block"]: r for r in res.report().collect()}
    for b, exp in enumerate(expected, start=1):
        got_sets = [set(r["value"] for r in mem if r["block"] == b and r["mode"] == m) for m in range(n)]
        assert got_sets == exp["members"], f"block {b}"
        r = rep[b]
        assert [r[f"card_{i}"] for i in range(n)] == exp["cards"]
        assert r["mass"] == exp["mass"] and r["tuples"] == exp["tuples"]
        assert r["passes"] == exp["passes"]
        assert r["search_mass"] == exp["search_mass"]
        assert r["density"] == pytest.approx(exp["density"], rel=1e-9, abs=1e-9)
        assert r["search_density"] == pytest.approx(exp["search_density"], rel=1e-9, abs=1e-9)
