"""Density measures (arithmetic, geometric, suspiciousness) as Spark SQL
expressions.

A measure is evaluated in three shapes, and each keeps the operation order of
the published definition so that strict comparisons between densities of one
run compare like with like:

* ``of_cards``   -- density of a block given its N cardinalities (the product
  is always re-multiplied in dimension order, never updated by division);
* ``if_removed`` -- density after removing ``k`` values of one dimension whose
  masses add up to ``s``, with the product scaled as ``prod / c * (c - k)``
  (used only to rank dimensions);
* ``sql``        -- density from SQL expressions of mass, product and sum.

``-1`` is the sentinel for an empty block (product 0, or mass 0 for
suspiciousness). Divisions and logarithms are guarded, so the expressions
are safe under ANSI mode. Expressions are built as SQL text and turned into
a ``Column`` once (``F.expr``), which keeps plan building cheap in a loop.
Each measure also has ``value`` for plain Python numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dlit(x: float) -> str:
    """SQL double literal."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError(f"non-finite literal {x}")
    return f"{x!r}D"


def sql_of(x) -> str:
    """SQL text of a number or of an expression given as text."""
    if isinstance(x, bool):
        raise TypeError("boolean is not a cardinality")
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, float):
        return dlit(x)
    return f"({x})"


def product_sql(cards: Sequence) -> str:
    """Double product of the cardinalities, multiplied in dimension order."""
    out = dlit(1.0)
    for c in cards:
        out = f"({out} * CAST({sql_of(c)} AS DOUBLE))"
    return out


def total_sql(cards: Sequence) -> str:
    return "(" + " + ".join(f"CAST({sql_of(c)} AS BIGINT)" for c in cards) + ")"


def product_py(cards: Sequence[int]) -> float:
    out = 1.0
    for c in cards:
        out *= float(c)
    return out


class Measure(Protocol):
    """Extension point: anything that maps (mass, product, sum) to a density."""

    name: str

    def sql(self, mass: str, prod: str, csum: str) -> str: ...

    def value(self, mass: int, cards: Sequence[int]) -> float: ...


@dataclass(frozen=True)
class Arithmetic:
    """Average mass per value: ``M / sum(c) * N``."""

    n_dims: int
    name: str = "ari"

    def sql(self, mass: str, prod: str, csum: str) -> str:
        s = f"CAST({csum} AS DOUBLE)"
        return (
            f"(CASE WHEN {s} = 0.0D THEN -1.0D "
            f"ELSE CAST({mass} AS DOUBLE) / (CASE WHEN {s} = 0.0D THEN 1.0D ELSE {s} END) * {dlit(self.n_dims)} END)"
        )

    def value(self, mass: int, cards: Sequence[int]) -> float:
        s = float(sum(int(c) for c in cards))
        return -1.0 if s == 0.0 else float(mass) / s * self.n_dims


@dataclass(frozen=True)
class Geometric:
    """Mass over the geometric mean of the cardinalities: ``M / prod(c)^(1/N)``."""

    n_dims: int
    name: str = "geo"

    def sql(self, mass: str, prod: str, csum: str) -> str:
        p = f"CAST({prod} AS DOUBLE)"
        return (
            f"(CASE WHEN {p} = 0.0D THEN -1.0D "
            f"ELSE CAST({mass} AS DOUBLE) / pow({p}, {dlit(1.0 / self.n_dims)}) END)"
        )

    def value(self, mass: int, cards: Sequence[int]) -> float:
        p = product_py(cards)
        return -1.0 if p == 0.0 else float(mass) / math.pow(p, 1.0 / self.n_dims)


@dataclass(frozen=True)
class Suspiciousness:
    """Negative log-likelihood of the block under a uniform (Poisson) model.

    ``M (ln(M/M0) - 1) + M0 p/P - M ln(p/P)`` with ``p`` the product of the
    block's cardinalities and ``M0``, ``P`` the mass and product of the relation
    the measure was initialised with.
    """

    n_dims: int
    mass_all: int
    prod_all: float
    name: str = "susp"

    def sql(self, mass: str, prod: str, csum: str) -> str:
        if self.mass_all <= 0 or self.prod_all == 0.0:
            return "-1.0D"
        p = f"CAST({prod} AS DOUBLE)"
        m = f"CAST({mass} AS DOUBLE)"
        m0, pa = dlit(self.mass_all), dlit(self.prod_all)
        sm = f"(CASE WHEN {m} = 0.0D THEN 1.0D ELSE {m} END)"
        sp = f"(CASE WHEN {p} = 0.0D THEN 1.0D ELSE {p} END)"
        value = f"{sm} * (ln({sm} / {m0}) - 1.0D) + {m0} * {sp} / {pa} - {sm} * ln({sp} / {pa})"
        return f"(CASE WHEN {p} = 0.0D OR {m} = 0.0D THEN -1.0D ELSE {value} END)"

    def value(self, mass: int, cards: Sequence[int]) -> float:
        p = product_py(cards)
        m = float(mass)
        if p == 0.0 or m == 0.0 or self.mass_all <= 0 or self.prod_all == 0.0:
            return -1.0
        m0, pa = float(self.mass_all), float(self.prod_all)
        return m * (math.log(m / m0) - 1.0) + m0 * p / pa - m * math.log(p / pa)


MEASURES = ("ari", "geo", "susp")


def make_measure(name: str, n_dims: int, mass_all: int, cards_all: Sequence[int]) -> Measure:
    """Measure by case-insensitive name, initialised on (mass, cardinalities)."""
    key = name.strip().lower()
    if key in ("ari", "arithmetic"):
        return Arithmetic(n_dims)
    if key in ("geo", "geometric"):
        return Geometric(n_dims)
    if key in ("susp", "suspiciousness"):
        return Suspiciousness(n_dims, int(mass_all), product_py(cards_all))
    raise ValueError(f"unknown density measure {name!r}; expected one of {MEASURES}")


def of_cards_sql(measure: Measure, mass, cards: Sequence) -> str:
    """Density of a block from its mass and cardinalities (D4, D7, D8); the
    arguments are numbers or SQL text."""
    return measure.sql(sql_of(mass), product_sql(cards), total_sql(cards))


def if_removed_sql(measure: Measure, mass, prod: float, csum: int, card, k, s) -> str:
    """Density after removing ``k`` values of mass sum ``s`` from a dimension
    with ``card`` alive values (D5; D6 is ``k = 1``)."""
    c = f"CAST({sql_of(card)} AS DOUBLE)"
    scaled = f"({dlit(prod)} / (CASE WHEN {c} = 0.0D THEN 1.0D ELSE {c} END) * ({c} - CAST({sql_of(k)} AS DOUBLE)))"
    return measure.sql(f"{sql_of(mass)} - {sql_of(s)}", scaled, f"{sql_of(csum)} - {sql_of(k)}")


def of_cards(measure: Measure, mass, cards: Sequence) -> Column:
    return F.expr(of_cards_sql(measure, mass, cards))


def if_removed(measure: Measure, mass, prod: float, csum: int, card, k, s) -> Column:
    return F.expr(if_removed_sql(measure, mass, prod, csum, card, k, s))
