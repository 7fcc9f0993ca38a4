"""One pass of greedy peeling, as one Spark plan over the mass histogram.

Removing values of one dimension does not change the masses of the other
values of that same dimension, so every decision of a pass follows from the
masses at its start. With ``hist(mode, mass, cnt)``:

1. candidates are the histogram rows with ``mass <= M * theta / c_mode``;
2. running ``k = sum(cnt)`` and ``s = sum(cnt * mass)`` in mass order per
   dimension give, for every cut between two runs of equal masses, the block
   that would be left (``M - s`` mass, ``c_mode - k`` values);
3. the density of each such block, the best cut per dimension and the
   score of removing all candidates are aggregated per dimension.

The driver receives one row per dimension. Cuts inside a run of equal masses
never beat both ends of the run for the three measures, so the order among
equal masses does not matter and no total order of values is needed.

The running sums are a two-level prefix sum: masses fall into buckets by their
logarithm (BUCKETS for each factor of 2, so at most 63 * BUCKETS of a
dimension), a window runs inside each bucket, and the sums of the buckets before
it come from a broadcast table of one row per bucket. No window holds a
dimension's whole histogram.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.density import Measure, dlit, if_removed_sql, of_cards_sql, product_py

BUCKETS = 64  # mass buckets for each factor of 2
# Grows with the mass, so that the order of buckets is the order of masses.
_BUCKET = f"CAST(floor(log2(CAST(mass AS DOUBLE) + 1) * {BUCKETS}) AS INT)"


@dataclass(frozen=True)
class PassState:
    mass: int  # current mass M
    alive: tuple[int, ...]  # alive values per dimension, phantoms included
    phantoms: tuple[int, ...]  # alive never-seen values (mass 0) per dimension
    theta: float

    def thresholds(self) -> dict[int, float]:
        return {m: float(self.mass) * self.theta / c for m, c in enumerate(self.alive) if c > 0}


@dataclass(frozen=True)
class ModeStats:
    mode: int
    k: int  # candidates (mass <= threshold)
    s: int  # their mass sum
    score: float  # density if all candidates were removed (D5)
    best_density: float  # best density over the cuts of this pass (D7)
    best_mass: int  # mass of the last value removed at the best cut
    best_k: int
    best_s: int
    start_density: float  # density of the block at the start (D4 shape)


def _per_mode_sql(mapping: dict[int, float | int], default: str = "NULL") -> str:
    """CASE over ``mode`` with one literal per dimension."""
    if not mapping:
        return default
    arms = " ".join(
        f"WHEN mode = {m} THEN {dlit(v) if isinstance(v, float) else f'CAST({v} AS BIGINT)'}"
        for m, v in sorted(mapping.items())
    )
    return f"(CASE {arms} ELSE {default} END)"


def histogram(alive_values: DataFrame, phantoms: Sequence[int]) -> DataFrame:
    """(mode, mass, cnt) over alive values plus the never-seen ones at mass 0."""
    return add_unseen(alive_values.select("mode", "mass", F.lit(1).cast("long").alias("cnt")), phantoms, always=True)


def add_unseen(hist: DataFrame, phantoms: Sequence[int], always: bool = False) -> DataFrame:
    """Histogram rows with the never-seen values at mass 0, each (mode, mass) once."""
    ph = [(m, 0, int(c)) for m, c in enumerate(phantoms) if c > 0]
    if ph:
        hist = hist.unionByName(hist.sparkSession.createDataFrame(ph, "mode int, mass long, cnt long"))
    return hist.groupBy("mode", "mass").agg(F.sum("cnt").cast("long").alias("cnt")) if ph or always else hist


def moved_histogram(hist: DataFrame, changed: DataFrame) -> DataFrame:
    """``hist`` after the masses of some values have changed (``changed``: mode, old, mass):
    each goes from the row of its old mass to that of its new one."""
    moves = F.array(F.struct(F.col("old").alias("mass"), F.lit(-1).cast("long").alias("cnt")), F.struct("mass", F.lit(1).cast("long").alias("cnt")))
    rows = hist.select("mode", "mass", "cnt").unionByName(changed.select("mode", F.inline(moves)))
    return rows.groupBy("mode", "mass").agg(F.sum("cnt").cast("long").alias("cnt")).where("cnt <> 0")


def candidates(hist: DataFrame, state: PassState) -> DataFrame:
    """Histogram rows at or below the removal threshold of their dimension."""
    thr = _per_mode_sql(state.thresholds())
    return hist.filter(F.expr(f"CAST(mass AS DOUBLE) <= {thr}"))


def prefix_densities(hist: DataFrame, state: PassState, measure: Measure) -> DataFrame:
    """Every cut of the pass: (mode, mass, cnt, k, s, density)."""
    cand = candidates(hist, state).withColumn("bucket", F.expr(_BUCKET)).repartition("mode", "bucket")
    sums = cand.groupBy("mode", "bucket").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("mass")).alias("m"))
    before = Window.partitionBy("mode").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 63 * BUCKETS rows at most
    starts = sums.select("mode", "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "m")])
    w = Window.partitionBy("mode", "bucket").orderBy("mass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cand = cand.withColumn("k", F.sum("cnt").over(w)).withColumn("s", F.sum(F.col("cnt") * F.col("mass")).over(w))
    cand = cand.join(F.broadcast(starts), ["mode", "bucket"]).select("mode", "mass", "cnt", (F.col("k") + F.col("n0")).alias("k"), (F.col("s") + F.col("m0")).alias("s"))
    cards = [f"CASE WHEN mode = {m} THEN CAST({c} AS BIGINT) - k ELSE CAST({c} AS BIGINT) END" for m, c in enumerate(state.alive)]
    return cand.withColumn("density", F.expr(of_cards_sql(measure, f"CAST({state.mass} AS BIGINT) - s", cards)))


def mode_stats_df(hist: DataFrame, state: PassState, measure: Measure) -> DataFrame:
    """One row per dimension with candidates: counts, score, best cut."""
    pre = prefix_densities(hist, state, measure)
    best = F.max(F.struct(F.col("density").alias("d"), (-F.col("mass")).alias("neg_mass"), "k", "s"))
    agg = pre.groupBy("mode").agg(F.max("k").alias("k"), F.max("s").alias("s"), best.alias("best"))
    prod = product_py(state.alive)
    csum = sum(state.alive)
    card = _per_mode_sql(dict(enumerate(state.alive)), "CAST(0 AS BIGINT)")
    score = if_removed_sql(measure, state.mass, prod, csum, card, "k", "s")
    start = of_cards_sql(measure, state.mass, list(state.alive))
    return agg.selectExpr(
        "mode",
        "k",
        "s",
        f"{score} AS score",
        "best.d AS best_density",
        "-best.neg_mass AS best_mass",
        "best.k AS best_k",
        "best.s AS best_s",
        f"{start} AS start_density",
    )


def collect_mode_stats(df: DataFrame) -> dict[int, ModeStats]:
    out = {}
    for r in df.collect():
        out[int(r["mode"])] = ModeStats(
            int(r["mode"]), int(r["k"]), int(r["s"]), float(r["score"]), float(r["best_density"]),
            int(r["best_mass"]), int(r["best_k"]), int(r["best_s"]), float(r["start_density"]),
        )
    return out


POLICIES = ("density", "cardinality")


def choose_mode(policy: str, stats: dict[int, ModeStats], alive: Sequence[int]) -> int:
    """Dimension to peel (P2-P4); among equal scores the last dimension wins."""
    key = policy.strip().lower()
    if key not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    chosen, best = 0, None
    for m, c in enumerate(alive):
        if c <= 0:
            continue
        if key == "cardinality":
            score = float(c)
        else:
            st = stats.get(m)
            if st is None or st.k < 1:
                continue
            score = st.score
        if best is None or score >= best:
            chosen, best = m, score
    return chosen


def choose_mode_df(stats_df: DataFrame, policy: str, alive: Sequence[int]) -> DataFrame:
    """Same choice as :func:`choose_mode`, as a one-row DataFrame (the
    ``limit(1)`` is the arg-max itself)."""
    key = policy.strip().lower()
    if key not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    card = _per_mode_sql(dict(enumerate(alive)), "CAST(0 AS BIGINT)")
    df = stats_df.filter(F.expr(f"{card} > 0"))
    score = f"CAST({card} AS DOUBLE)" if key == "cardinality" else "score"
    df = df.withColumn("policy_score", F.expr(score))
    return df.orderBy(F.col("policy_score").desc(), F.col("mode").desc()).limit(1)


@dataclass(frozen=True)
class ValueCut:
    density: float
    k: int
    s: int
    mass: int
    value: int  # last value removed at the cut; -1 when only never-seen values go


def best_cut_by_value(
    alive_values: DataFrame,
    mode: int,
    state: PassState,
    measure: Measure,
    partitions: int,
) -> ValueCut | None:
    """Best cut of one dimension scanning values one by one in (mass, value)
    order (P5, P6 for measures without the run property of §4.4).

    A distributed prefix sum: candidates are range-partitioned by (mass,
    value), a window runs inside each range partition, and the counts and sums of
    the partitions before it are joined from one row per partition. Never-seen
    values (mass 0) form a prefix and are cut as a whole.
    """
    from ..config import materialize

    thr = state.thresholds()[mode]
    ph = state.phantoms[mode]
    cand = alive_values.filter((F.col("mode") == mode) & (F.col("mass").cast("double") <= F.lit(thr)))
    ranged = materialize(
        cand.select("mass", "value").repartitionByRange(max(1, partitions), "mass", "value").withColumn("pid", F.spark_partition_id())
    )
    cards = [f"CASE WHEN {m} = {mode} THEN CAST({c} AS BIGINT) - k ELSE CAST({c} AS BIGINT) END" for m, c in enumerate(state.alive)]
    best = None
    if ph:
        d0 = measure.value(state.mass, [c - ph if m == mode else c for m, c in enumerate(state.alive)])
        best = ValueCut(float(d0), ph, 0, 0, -1)
    sizes = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("m"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "m")])
    w = Window.partitionBy("pid").orderBy("mass", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("mass").over(w)).join(F.broadcast(starts), "pid")
    rows = rows.select("mass", "value", (F.col("k") + F.col("n0") + F.lit(ph)).alias("k"), (F.col("s") + F.col("m0")).alias("s"))
    dens = F.expr(of_cards_sql(measure, f"CAST({state.mass} AS BIGINT) - s", cards))
    top = rows.select(F.struct(dens.alias("d"), (-F.col("k")).alias("neg_k"), "k", "s", "mass", "value").alias("t"))
    r = top.agg(F.max("t").alias("t")).first()["t"]
    if r is not None:
        cut = ValueCut(float(r["d"]), int(r["k"]), int(r["s"]), int(r["mass"]), int(r["value"]))
        if best is None or cut.density > best.density:
            best = cut
    return best
