"""The relation: N integer dimension columns plus one positive measure.

Internally the columns are always named ``a0 .. a{N-1}`` and ``v`` (all
BIGINT); :class:`Relation` remembers the user's names. Tuples are a bag:
duplicates are legal and are never merged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dim_names(n: int) -> list[str]:
    return [f"a{i}" for i in range(n)]


@dataclass
class Relation:
    df: DataFrame  # columns a0..aN-1, v
    n_dims: int
    source_dims: list[str] = field(default_factory=list)
    source_measure: str = "v"
    dictionaries: dict = field(default_factory=dict)  # mode -> DataFrame(value, key)
    # True when df is a plain scan (plus narrow steps) of files: its partition
    # count can be read without running anything, and a relation that arrives
    # in too few partitions is spread once.
    scan_based: bool = False
    # True when df comes out of shuffles (e.g. an aggregation): every job of a
    # search reads it, so it is checkpointed once instead of recomputed.
    derived: bool = False
    # What the job that stored the relation has counted (``operators.profile.Profile``),
    # so that a search need not read it for that again.
    profile: object = None
    counts: dict = field(default_factory=dict)  # further counters of that job, by name

    @property
    def dims(self) -> list[str]:
        return dim_names(self.n_dims)

    @property
    def columns(self) -> list[str]:
        return self.dims + ["v"]


def whole(df: DataFrame, column: str) -> Column:
    """``column`` as BIGINT; null where it is no whole number, so that validation
    counts the tuple instead of bending its value."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    n = c.try_cast("long")
    if kind.startswith("decimal"):  # compared as decimals: a double would lose a fraction beyond 2^53
        return F.when(n.cast("decimal(38,18)" if kind.endswith(",18)") else "decimal(38,0)") == c, n)
    return F.when(n.cast("double") == c.try_cast("double"), n)


def from_columns(df: DataFrame, dims: Sequence[str], measure: str | Column | None = None) -> Relation:
    """Project ``df`` to a relation; ``measure=None`` counts every row as 1."""
    dims = list(dims)
    if not dims:
        raise ValueError("a relation needs at least one dimension")
    m = F.lit(1).cast("long") if measure is None else (whole(df, measure) if isinstance(measure, str) else measure)
    cols = [whole(df, d).alias(f"a{i}") for i, d in enumerate(dims)]
    out = df.select(*cols, m.cast("long").alias("v"))
    return Relation(out, len(dims), dims, measure if isinstance(measure, str) else "v")


def validation_columns(rel: Relation, allow_zero: bool = False) -> list[Column]:
    """Aggregates that count invalid tuples; combined with the profile scan."""
    bad = F.col("v").isNull() | (F.col("v") < (0 if allow_zero else 1))
    for d in rel.dims:
        bad = bad | F.col(d).isNull() | (F.col(d) < 0)
    return [F.sum(F.when(bad, 1).otherwise(0)).alias("invalid")]


def valid_only(rel: Relation, allow_zero: bool = False) -> Relation:
    ok = F.col("v").isNotNull() & (F.col("v") >= (0 if allow_zero else 1))
    for d in rel.dims:
        ok = ok & F.col(d).isNotNull() & (F.col(d) >= 0)
    return Relation(rel.df.filter(ok), rel.n_dims, rel.source_dims, rel.source_measure, rel.dictionaries, rel.scan_based, rel.derived)
