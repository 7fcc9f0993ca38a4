"""Per-value cut path: built-in measures and a user-defined measure."""

import random
from dataclasses import dataclass

import pytest

from denseblocks import Options, find_blocks
from denseblocks.plans.search import prepare

from . import bruteforce
from .conftest import relation_of


def _rows(seed, n=3, count=20):
    rng = random.Random(seed)
    return [tuple(rng.randint(0, 5) for _ in range(n)) + (rng.choice([1, 2, 3]),) for _ in range(count)]


@pytest.mark.parametrize("measure", ["geo", "susp"])
def test_value_path_equals_bruteforce(spark, measure):
    rows = _rows(3)
    exp = bruteforce.find_blocks(rows, 3, 1, measure, "density", 1.0)[0]
    res = find_blocks(relation_of(spark, rows, 3), k=1, measure=measure, policy="density", theta=1.0,
                      opts=Options(cut_path="values"))
    mem = res.members().collect()
    assert [set(r["value"] for r in mem if r["mode"] == m) for m in range(3)] == exp["members"]
    rep = res.report().collect()[0]
    assert rep["search_density"] == pytest.approx(exp["search_density"], rel=1e-9)


@dataclass(frozen=True)
class MassMinusValues:
    """A user measure: mass minus half the number of values in the block."""

    name: str = "mass_minus_values"

    def sql(self, mass: str, prod: str, csum: str) -> str:
        return f"(CAST({mass} AS DOUBLE) - 0.5D * CAST({csum} AS DOUBLE))"

    def value(self, mass, cards):
        return float(mass) - 0.5 * float(sum(cards))


def test_user_measure(spark):
    rows = _rows(11)
    f = lambda mass, prod, csum: float(mass) - 0.5 * float(csum)
    exp = bruteforce.find_blocks(rows, 3, 1, f, "density", 1.0)[0]
    ctx = prepare(relation_of(spark, rows, 3))
    res = find_blocks(ctx, k=1, measure=MassMinusValues(), policy="density", theta=1.0)
    mem = res.members().collect()
    assert [set(r["value"] for r in mem if r["mode"] == m) for m in range(3)] == exp["members"]
    rep = res.report().collect()[0]
    assert rep["search_density"] == pytest.approx(exp["search_density"], rel=1e-9)
    assert rep["passes"] == exp["passes"]
