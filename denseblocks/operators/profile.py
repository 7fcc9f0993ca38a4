"""Measuring a relation: tuple count, mass, cardinalities, value masses.

All of these are single declarative aggregations; Catalyst plans them as
partial (map-side) + final hash aggregates, so a hot attribute value is
combined inside each task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relation import Relation, validation_columns


@dataclass(frozen=True)
class Profile:
    tuples: int
    mass: int
    cards: tuple[int, ...]  # max + 1 per dimension
    invalid: int = 0
    coordinates: int | None = None  # estimated number of distinct coordinates


def coordinates(n_dims: int, among=None):
    """Estimated number of distinct coordinates (of the rows ``among``), as an aggregate."""
    key = F.xxhash64(*[F.col(f"a{i}") for i in range(n_dims)])
    return F.approx_count_distinct(key if among is None else F.when(among, key))


def profile_df(rel: Relation, allow_zero: bool = False) -> DataFrame:
    """One-row DataFrame: tuples, mass, card_i = max(a_i)+1, invalid count."""
    return rel.df.agg(*_profile_columns(rel, allow_zero))


def _profile_columns(rel: Relation, allow_zero: bool = False) -> list:
    aggs = [F.count(F.lit(1)).alias("tuples"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("mass")]
    aggs += [F.coalesce(F.max(d) + 1, F.lit(0)).cast("long").alias(f"card_{i}") for i, d in enumerate(rel.dims)]
    return aggs + validation_columns(rel, allow_zero)


def profile(rel: Relation, allow_zero: bool = False, estimate: bool = False) -> Profile:
    """The profile as numbers; ``estimate`` adds the number of distinct coordinates."""
    df = profile_df(rel, allow_zero)
    if estimate:
        df = rel.df.agg(*_profile_columns(rel, allow_zero), coordinates(rel.n_dims).alias("coordinates"))
    return profile_of(df.collect()[0].asDict(), rel.n_dims)


def profile_of(row: dict, n_dims: int) -> Profile:
    return Profile(
        int(row["tuples"]), int(row["mass"] or 0), tuple(int(row[f"card_{i}"] or 0) for i in range(n_dims)), int(row.get("invalid") or 0), row.get("coordinates")
    )


def unpivot_dims(df: DataFrame, n_dims: int, keep: list[str] | None = None, without: int | None = None) -> DataFrame:
    """One row per (tuple, dimension but ``without``): columns mode INT, value BIGINT, + ``keep``.

    The exploded array is a constant, the value is picked per row: no array of structs is built
    for each tuple."""
    modes = [i for i in range(n_dims) if i != without]
    value = F.col(f"a{modes[-1]}")
    for i in modes[-2::-1]:
        value = F.when(F.col("mode") == i, F.col(f"a{i}")).otherwise(value)
    rows = df.withColumn("mode", F.explode(F.array(*[F.lit(i) for i in modes])))
    return rows.select(*(keep or []), "mode", value.alias("value"))


def value_masses(df: DataFrame, n_dims: int) -> DataFrame:
    """Mass of every attribute value seen in ``df`` (A3, A4): mode, value, mass.

    Expand-like unpivot, partial sum per task, one exchange on (mode, value).
    """
    return unpivot_dims(df, n_dims, ["v"]).groupBy("mode", "value").agg(F.sum("v").cast("long").alias("mass"))


def value_table(df: DataFrame, n_dims: int) -> DataFrame:
    """Mass and number of tuples of every attribute value: mode, value, mass, tuples."""
    values = unpivot_dims(df, n_dims, ["v"]).groupBy("mode", "value")
    return values.agg(F.sum("v").cast("long").alias("mass"), F.count(F.lit(1)).alias("tuples"))


def value_masses_filled(df: DataFrame, n_dims: int, cards: tuple[int, ...]) -> DataFrame:
    """A3 plus the never-seen ids 0..card-1 with mass 0.

    Only for dense ids: with sparse ids ``card`` is the largest id + 1 and the
    range grows with it; ``operators.ranges.value_mass_ranges`` has the unseen ids as
    intervals. The search itself keeps them as per-dimension counts.
    """
    spark = df.sparkSession
    seen = value_masses(df, n_dims)
    ranges = None
    for i, c in enumerate(cards):
        r = spark.range(0, c).select(F.lit(i).alias("mode"), F.col("id").alias("value"))
        ranges = r if ranges is None else ranges.unionByName(r)
    return ranges.join(seen, ["mode", "value"], "left").select(
        "mode", "value", F.coalesce("mass", F.lit(0)).cast("long").alias("mass")
    )


def mass_check(vm: DataFrame) -> DataFrame:
    """Total mass per dimension (A2); every row must equal the relation's mass."""
    return vm.groupBy("mode").agg(F.sum("mass").cast("long").alias("mass"), F.count(F.lit(1)).alias("values"))


def mass_histogram(vm: DataFrame) -> DataFrame:
    """(mode, mass, cnt): how many values of each dimension have each mass.

    At most about sqrt(2 * total mass) rows per dimension, whatever the
    number of values.
    """
    return vm.groupBy("mode", "mass").agg(F.count(F.lit(1)).alias("cnt"))
