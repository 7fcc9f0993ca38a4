"""The search: find one dense block by peeling, then k blocks by deflation.

Per pass the driver runs one small job (N rows back, see
``operators.peel``), then ships a predicate ``mode = n AND mass <= thr``
back into the state:

* ``B``  -- the tuples still alive (anti join on one dimension);
* ``A``  -- the alive attribute values (mode, value, mass), shrinking;
* a removal log: per pass the values it removed, with their mass at removal.
  The block is ``rpass > p* OR (rpass = p* AND mass > m*)`` over the log,
  plus whatever is still alive.

Identical coordinates are searched once: the working tuples have the added measure ``v`` and
the number ``n`` of tuples that they stand for. Values never seen in the data (ids below
the largest one) are *phantoms*: mass 0, removed in the first pass that peels their
dimension. They are kept as one count per dimension and written as intervals, so sparse ids
cost nothing.

Lineage is cut every pass with a Parquet table in the session's checkpoint folder, or in
that of a journal, from which another driver can go on; a lost executor only recomputes
from the last one.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Options, bucketed, counted, open_bucketed, persist, release, size_of, stored
from ..functions.density import Arithmetic, Geometric, Suspiciousness, make_measure, product_py
from ..operators import membership as mem
from ..operators.masks import BITS, BlockSet, per_block, tag, totals
from ..operators.peel import (
    PassState,
    add_unseen,
    best_cut_by_value,
    choose_mode,
    collect_mode_stats,
    histogram,
    mode_stats_df,
    moved_histogram,
)
from ..operators.profile import profile, unpivot_dims, value_table
from ..operators.ranges import expand, unseen_ranges
from ..relation import Relation, valid_only
from .journal import Journal


@dataclass
class PassLog:
    mode: int
    k: int
    s: int
    threshold: float
    mass_before: int
    alive_before: tuple[int, ...]
    best_density: float
    seconds: float
    # What the pass has read: rows by its statistics, rows of tuples, and bytes of
    # the tables that the search has written.
    stat_rows: int = 0
    tuple_rows: int = 0
    bytes: int = 0


@dataclass
class BlockFound:
    """Result of one search. ``cut`` is None when nothing beat the start."""

    cut_pass: int | None
    cut_mass: int | None
    search_density: float
    search_mass: int  # mass of the block in the relation searched
    cards: tuple[int, ...]
    passes: int
    values: DataFrame  # alive values + removal log: (mode, value, mass, rpass)
    phantom_pass: tuple[int | None, ...]
    log: list[PassLog] = field(default_factory=list)
    cut_value: int | None = None  # set by the per-value path: ties broken by value
    tables: list[str] = field(default_factory=list)  # that ``values`` reads

    def members_observed(self) -> DataFrame:
        """(mode, value) of the block among values seen in the data."""
        v = self.values
        if self.cut_pass is None:
            return v.select("mode", "value")
        p, m = self.cut_pass, self.cut_mass
        after = F.col("mass") > m
        if self.cut_value is not None:
            after = after | ((F.col("mass") == m) & (F.col("value") > self.cut_value))
        keep = F.col("rpass").isNull() | (F.col("rpass") > p) | ((F.col("rpass") == p) & after)
        return v.filter(keep).select("mode", "value")

    def phantom_members(self) -> list[bool]:
        if self.cut_pass is None:
            return [True] * len(self.phantom_pass)
        return [pp is None or pp > self.cut_pass for pp in self.phantom_pass]


@dataclass
class Context:
    """Everything fixed for a run: the original relation and its profile."""

    spark: SparkSession
    original: DataFrame  # a0..aN-1, v: the bag
    rows: DataFrame  # a0..aN-1, v, n: what is searched, identical coordinates merged if that pays
    n_dims: int
    cards: tuple[int, ...]  # full cardinalities (max + 1, or distinct)
    distinct: tuple[int, ...]  # values seen per dimension
    ids: tuple[int, ...]  # largest id + 1
    mass: int
    tuples: int
    n_rows: int  # of ``rows``
    all_values: DataFrame  # (mode, value, mass, tuples) on ``rows``, materialised
    opts: Options
    partitions: int = 1  # partitions of the searched relation
    dictionaries: dict = field(default_factory=dict)  # mode -> DataFrame(key, id)
    tables: list[str] = field(default_factory=list)  # written by ``prepare``
    cached: list[DataFrame] = field(default_factory=list)

    @property
    def phantoms(self) -> tuple[int, ...]:
        return tuple(c - d for c, d in zip(self.cards, self.distinct))

    @property
    def merged(self) -> bool:
        return self.n_rows < self.tuples

    def close(self) -> None:
        """Give back the tables and the memory of :func:`prepare`."""
        for df in self.cached:
            df.unpersist()
        for path in self.tables:
            release(self.spark, path)
        self.cached, self.tables = [], []


def prepare(rel: Relation, opts: Options = DEFAULT, cardinality: str = "max_plus_one", validate: str = "failfast") -> Context:
    """Profile the relation and build its value table.

    A relation derived through shuffles is stored once; a file scan
    arriving in fewer partitions than cores is spread (and kept) once; a
    plain scan is simply re-read (column-pruned) by every job. What the job that read the
    relation has counted (``rel.profile``) is not counted again. Where the coordinates
    repeat (``Options.merge``) they are merged into one row each.
    """
    spark = rel.df.sparkSession
    original = rel.df
    tables, cached = [], []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rel.derived:
        original, path = stored(original, "relation")
        tables.append(path)
        parts = max(1, original.rdd.getNumPartitions())
    elif rel.scan_based:
        spread_df, parts = spread(original, rel.n_dims)
        if spread_df is not original:
            original = persist(spread_df)
            cached.append(original)
    rel = replace(rel, df=original)
    estimate = opts.merge == "auto"
    prof = rel.profile or profile(rel, estimate=estimate)
    if prof.invalid:
        if validate == "failfast":
            raise ValueError(
                f"{prof.invalid} tuples have a null or negative id or a non-positive measure; "
                "pass validate='drop' to skip them"
            )
        rel = valid_only(rel)
        original = rel.df
        prof = profile(rel, estimate=estimate)
    if opts.merge == "always" or (estimate and prof.coordinates is not None and 2 * prof.coordinates <= prof.tuples):
        rows, path, seen = counted(merged_rows(original, rel.n_dims), "coordinates", {"n_rows": F.count(F.lit(1))})
        n_rows = int(seen["n_rows"])
        tables.append(path)
        parts = max(1, rows.rdd.getNumPartitions())
    else:
        rows, n_rows = original.withColumn("n", F.lit(1).cast("long")), prof.tuples
    # Short lineage (source scan + one aggregation): persisted, not checkpointed.
    vm = persist(value_table(rows, rel.n_dims))
    cached.append(vm)
    counts = {int(r["mode"]): int(r["n"]) for r in vm.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).collect()}
    distinct = tuple(counts.get(i, 0) for i in range(rel.n_dims))
    if cardinality == "max_plus_one":
        cards = prof.cards
    elif cardinality == "distinct":
        cards = distinct
    else:
        raise ValueError("cardinality must be 'max_plus_one' or 'distinct'")
    return Context(spark, original, rows, rel.n_dims, tuple(cards), distinct, prof.cards, prof.mass, prof.tuples, n_rows, vm, opts, parts, rel.dictionaries, tables, cached)


def merged_rows(df: DataFrame, n_dims: int) -> DataFrame:
    """Each coordinate once, with its added measure ``v`` and the number ``n`` of its tuples."""
    return df.groupBy(*[f"a{i}" for i in range(n_dims)]).agg(F.sum("v").cast("long").alias("v"), F.count(F.lit(1)).alias("n"))


def _start_values(ctx: Context, current: DataFrame) -> DataFrame:
    """Values at the start of a later search: every value of the original relation,
    with its mass in ``current`` (0 if absent). One aggregation over the union
    of the value rows and the unpivoted tuples; no join."""
    return _update_values(ctx.all_values, current, ctx.n_dims, ctx.opts)


def _values_without(ctx: Context, R: DataFrame, V: DataFrame, block: Block) -> DataFrame:
    """:func:`_start_values` of what ``block`` leaves of ``R``, whose values are ``V``: only
    the tuples of the block are added up, and subtracted."""
    gone = block_tuples(ctx, R, block.members, block.sizes, V, _count_tuples(V))
    return _update_values_delta(V, gone, ctx.n_dims)


def _count_tuples(values: DataFrame) -> int:
    """Rows of the relation whose value table this is: every row has one value of
    the first dimension."""
    return int(values.filter(F.col("mode") == 0).agg(F.coalesce(F.sum("tuples"), F.lit(0))).first()[0])


# ---------------------------------------------------------------------------
# the working tuples
# ---------------------------------------------------------------------------


@dataclass
class Base:
    """The working tuples as last written: one table, or (``key`` set) a table bucketed by
    that dimension with the tuples of its hot values, and those values, beside it."""

    path: str | None = None  # None: the relation as it came
    key: int | None = None
    name: str = ""
    buckets: int = 0
    hot: str | None = None
    hot_values: str | None = None

    def paths(self) -> list[str]:
        return [p for p in (self.path, self.hot, self.hot_values) if p]


def write_base(ctx: Context, df: DataFrame, values: DataFrame, alive_obs: Sequence[int], tuples: int, folder: str | None, joined: bool = True) -> Base:
    """Write working tuples; in buckets of the dimension with the largest sets if
    ``Options.layout`` asks for it and those are too large to be broadcast. ``joined``: they come
    out of joins, else they are the relation or a table and are read twice as they are."""
    opts = ctx.opts
    key = bucket_key(ctx, values, alive_obs) if opts.layout == "bucketed" else None
    if key is None:
        return Base(stored(df, "alive", folder)[1])
    # tuples out of joins are written once before they are dealt into two tables
    whole, path = stored(df, "whole", folder) if joined else (df, None)
    hot, hot_path = stored(mem.hot_values(values, key, tuples, F.lit(True), opts).select("value"), "hot_values", folder)  # hot_parts rows at most
    hot = F.broadcast(hot.withColumnRenamed("value", f"a{key}"))
    n = int(ctx.spark.conf.get("spark.sql.shuffle.partitions"))
    name, cold = bucketed(whole.join(hot, f"a{key}", "left_anti").select(*whole.columns), "bucketed", f"a{key}", n, folder)
    hot_tuples = stored(whole.join(hot, f"a{key}", "left_semi").select(*whole.columns), "hot", folder)[1]
    if path:
        release(ctx.spark, path)
    return Base(cold, key, name, n, hot_tuples, hot_path)


def bucket_key(ctx: Context, values: DataFrame, alive_obs: Sequence[int]) -> int | None:
    """Dimension with the most alive values among those whose sets would have to be shuffled."""
    of = lambda m: values.where(F.col("mode") == m).select("value")
    large = [m for m in range(ctx.n_dims) if mem.shuffles(of(m), alive_obs[m], ctx.opts, ctx.ids[m])]
    return max(large, key=lambda m: (alive_obs[m], m), default=None)


def open_base(ctx: Context, base: Base, B: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(tuples, tuples of hot values, hot values): the last two of a bucketed base only."""
    if base.path is None:
        return B, None, None
    read = lambda p, schema: ctx.spark.read.schema(schema).parquet(p)
    if base.key is None:
        return read(base.path, B.schema), None, None
    cold = open_bucketed(ctx.spark, base.name, base.path, f"a{base.key}", base.buckets, B.schema)
    return cold.select(*B.columns), read(base.hot, B.schema), read(base.hot_values, "value long")


def surviving_tuples(
    B_base: DataFrame,
    V: DataFrame,
    base_pass: int,
    removed_obs: Sequence[int],
    alive_obs: Sequence[int],
    base_tuples: int,
    opts: Options,
    ids: Sequence[int] | None = None,
    apart: tuple[int, DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, bool]:
    """Tuples of ``B_base`` none of whose values was removed since pass
    ``base_pass`` (P10, J3). Returns (tuples, used_shuffle).

    Per dimension the removals since the base form one set, so the plan has
    at most N membership joins however many passes it covers. Each join uses
    the smaller of (removed since base, still alive) when it is broadcastable.
    ``apart`` = (dimension, hot values, their tuples) says that ``B_base`` is bucketed by that
    dimension, without its hot values: the join on it then moves no tuples.
    """
    out, hot_out = B_base, apart[2] if apart else None
    shuffled = False
    for m, r in enumerate(removed_obs):
        if r == 0:
            continue
        key = f"a{m}"
        card = ids[m] if ids else None
        vm_m = V.filter(F.col("mode") == m)
        gone = F.col("rpass").isNotNull() & (F.col("rpass") >= base_pass)
        alive = F.col("rpass").isNull()
        kept = alive_obs[m]
        inside = kept <= r and not mem.shuffles(vm_m.filter(alive).select("value"), kept, opts, card)
        values, n = (vm_m.filter(alive).select("value"), kept) if inside else (vm_m.filter(gone).select("value"), r)
        if apart and m == apart[0] and mem.shuffles(values, n, opts, card):
            few = values.join(F.broadcast(apart[1]), "value", "left_semi")  # hot_parts rows at most
            hot_out = hot_out.join(F.broadcast(few.withColumnRenamed("value", key)), key, "left_anti")
            out = out.join(values.withColumnRenamed("value", key), key, "left_anti")
            continue
        hot = None
        if mem.shuffles(values, n, opts, card):
            shuffled = True
            hot = mem.hot_values(vm_m.filter(alive | gone), m, base_tuples, gone, opts)
        out = mem.restrict(out, key, values, n, keep=inside, hot=hot, opts=opts, card=card)
        if apart:
            hot_out = mem.restrict(hot_out, key, values, n, keep=inside, hot=hot, opts=opts, card=card)
    columns = B_base.columns
    return (out.select(*columns).unionByName(hot_out.select(*columns)) if apart else out), shuffled


def spread(df: DataFrame, n_dims: int) -> tuple[DataFrame, int]:
    """Deal a relation that arrives in fewer partitions than the cluster has
    cores (e.g. one large parquet row group) evenly over them, identical tuples
    too. Returns (relation, partitions)."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= par:
        return df, have
    return df.repartition(par), par


def shrink(B: DataFrame, parts: int, tuples: int, ctx: Context) -> tuple[DataFrame, int]:
    """Re-partition the surviving tuples to a count proportional to the share
    of the original tuples that they are, so late passes do not schedule
    thousands of nearly empty tasks. An even exchange (not ``coalesce``) keeps
    the join that produces them parallel; only the small output moves."""
    want = max(ctx.opts.min_partitions, -(-ctx.partitions * max(tuples, 0) // max(ctx.n_rows, 1)))
    if want * 2 > parts:
        return B, parts
    return B.repartition(want), want


# ---------------------------------------------------------------------------
# one block
# ---------------------------------------------------------------------------


@dataclass
class State:
    """A search between two passes, in numbers and paths only, so that it can be
    written down and taken up by another driver."""

    p: int
    mass: int
    alive: list[int]  # alive values per dimension, phantoms included
    phantoms: list[int]
    phantom_pass: list[int | None]
    tuples: int  # rows at the start of the pass
    base_tuples: int
    parts: int
    since_base: list[int]  # observed values removed since the base, per dimension
    best: float | None = None
    cut: list | None = None  # pass, mass, k, s, mode, mass before, value
    table: str | None = None  # alive values; None: those of the start
    removed: list[list] = field(default_factory=list)  # per pass: table, mode, threshold
    log: list[dict] = field(default_factory=list)
    base: dict = field(default_factory=lambda: asdict(Base()))
    base_pass: int = 0
    hist: str | None = None
    stat_rows: int = 0
    written: list[str] = field(default_factory=list)  # tables to give back at the end
    done: bool = False
    passes: int = 0


class _Peel:
    """Greedy peeling of one block (P1-P15) on tuples ``B`` and values ``V``
    (mode, value, mass, tuples: every value of the relation, masses in ``B``).

    The values are kept as a shrinking *alive* table, written every pass, plus an
    append-only removal log. A log entry is a filter of the (written) alive table of its
    pass, so logging costs no job and each pass only touches the values still alive.
    """

    def __init__(self, ctx, B, V, mass, measure, policy, theta, folder, state):
        self.ctx, self.B, self.V, self.mass = ctx, B, V, mass
        self.opts, self.N, self.policy, self.theta, self.folder = ctx.opts, ctx.n_dims, policy, theta, folder
        self.meas = measure if not isinstance(measure, str) else make_measure(measure, self.N, mass, ctx.cards)
        # The histogram shortcut relies on §4.4 (no best cut inside a run of equal
        # masses), proven for the built-in measures only.
        self.by_value = self.opts.cut_path == "values" or type(self.meas) not in (Arithmetic, Geometric, Suspiciousness)
        self.moving = self.opts.histogram == "delta"
        if state is None:
            rows = _count_tuples(V)
            state = State(0, mass, list(ctx.cards), list(ctx.phantoms), [None] * self.N, rows, rows, ctx.partitions, [0] * self.N)
            if self.opts.layout == "bucketed":
                self.s = state
                if bucket_key(ctx, V, self.seen()) is not None:
                    state.base = asdict(write_base(ctx, B, V, self.seen(), rows, folder, joined=False))
        self.s = state

    # -- tables -------------------------------------------------------------

    def values(self, path: str | None) -> DataFrame:
        """(mode, value, mass, tuples) alive at the start of a pass."""
        if path is None:
            return self.V.select("mode", "value", "mass", "tuples")
        more = ", old long, changed boolean" if self.moving else ""
        return self.ctx.spark.read.schema("mode int, value long, mass long, tuples long" + more).parquet(path).select("mode", "value", "mass", "tuples")

    def logged(self, since: int = 0) -> list[DataFrame]:
        """(mode, value, mass, tuples, rpass) per pass: the values that it removed."""
        out = []
        for p, (table, mode, threshold) in enumerate(self.s.removed[since:], start=since):
            out.append(self.values(table).filter(_gone(mode, threshold)).withColumn("rpass", F.lit(p)))
        return out

    def seen(self) -> list[int]:
        """Alive values that occur in the data, per dimension."""
        return [a - p for a, p in zip(self.s.alive, self.s.phantoms)]

    def histogram(self, alive: DataFrame) -> DataFrame:
        s = self.s
        if not self.moving:
            s.stat_rows = sum(self.seen())
            return histogram(alive.select("mode", "mass"), s.phantoms)
        if s.hist is None:
            _, s.hist, n = counted(histogram(alive.select("mode", "mass"), []), "histogram", {"rows": F.count(F.lit(1))}, self.folder)
            s.stat_rows = sum(self.seen()) + int(n["rows"])
            s.written.append(s.hist)
        return add_unseen(self.kept_histogram(), s.phantoms)

    def kept_histogram(self) -> DataFrame:
        return self.ctx.spark.read.schema("mode int, mass long, cnt long").parquet(self.s.hist)

    # -- one pass -----------------------------------------------------------

    def step(self) -> None:
        t0, s, ctx, opts, N = time.time(), self.s, self.ctx, self.opts, self.N
        alive = self.values(s.table)
        state = PassState(s.mass, tuple(s.alive), tuple(s.phantoms), self.theta)
        hist = self.histogram(alive)
        size = lambda *paths: sum(size_of(ctx.spark, p) for p in paths)
        read = size(s.hist if self.moving else s.table)
        stats = collect_mode_stats(mode_stats_df(hist, state, self.meas))
        if s.best is None:
            s.best = next(iter(stats.values())).start_density if stats else 0.0
        n = choose_mode(self.policy, stats, s.alive)
        st = stats.get(n)
        if st is None or st.k < 1:
            raise RuntimeError(f"pass {s.p}: no removable value in dimension {n} (theta below 1?)")
        thr = float(s.mass) * self.theta / s.alive[n]
        cut_value = None
        if self.by_value:
            vc = best_cut_by_value(alive, n, state, self.meas, ctx.partitions)
            st = replace(st, best_density=vc.density, best_k=vc.k, best_s=vc.s, best_mass=vc.mass)
            cut_value = vc.value
        if st.best_density > s.best:
            s.best = st.best_density
            s.cut = [s.p, st.best_mass, st.best_k, st.best_s, n, s.mass, cut_value]
        log = PassLog(n, st.k, st.s, thr, s.mass, tuple(s.alive), st.best_density, 0.0, s.stat_rows)
        before_base, before_seen = list(s.since_base), self.seen()
        s.removed.append([s.table, n, thr])
        removed_obs = st.k - s.phantoms[n]
        s.since_base[n] += removed_obs
        if s.phantoms[n]:
            s.phantom_pass[n] = s.p
            s.phantoms[n] = 0
        s.mass -= st.s
        s.alive[n] -= st.k
        s.p += 1
        if not self._ends():
            base = Base(**s.base)
            tuples, hot, hot_values = open_base(ctx, base, self.B)
            apart = (base.key, hot_values, hot) if hot is not None else None
            kept = alive.filter(~_gone(n, thr))
            view = _values_view(kept, self.logged(s.base_pass))
            now, shuffled = surviving_tuples(tuples, view, s.base_pass, s.since_base, self.seen(), s.base_tuples, opts, ctx.ids, apart)
            log.tuple_rows = s.base_tuples
            read += size(s.table if self.moving else None, *base.paths())
            if opts.update == "delta":
                gone = self._leaving(alive, tuples, before_base, before_seen, apart, n, thr, removed_obs)
            new_base = None
            if shuffled or 2 * s.tuples <= s.base_tuples:
                # a shuffle join's output is already sized by AQE; a broadcast join keeps its partitions
                if not shuffled:
                    now, s.parts = shrink(now, s.parts, s.tuples, ctx)
                new_base = write_base(ctx, now, view.filter("rpass IS NULL"), self.seen(), s.tuples, self.folder)
                cold, hot, _ = open_base(ctx, new_base, self.B)
                now = cold if hot is None else cold.unionByName(hot)
                log.tuple_rows += s.tuples
                read += size(*new_base.paths())
            new = _update_values_delta(kept, gone, N, n) if opts.update == "delta" else _update_values(kept, now, N, opts)
            if new_base:
                s.written += base.paths()
                s.base, s.base_pass, s.base_tuples, s.since_base = asdict(new_base), s.p, s.tuples, [0] * N
            self._write_values(new, n, thr)
        log.bytes, log.seconds = read, time.time() - t0
        s.log.append(asdict(log))

    def _ends(self) -> bool:
        """Is the search decided? Then its passes are counted and the phantoms' passes set."""
        s, N = self.s, self.N
        if self.opts.early_exit and s.mass > 0 and not self.by_value and upper_bound(self.meas, s.mass, s.alive, self.mass, self.ctx.cards) <= s.best:
            # No block inside what is left can beat the best: all
            # remaining values are removed after the cut, so they are members.
            last = s.p
        elif (s.mass == 0 and not self.by_value) or sum(s.alive) == 0:
            # Every later density is 0 or the -1 sentinel, below the best: the
            # remaining values all belong to the block. The full peel would take
            # one more pass per dimension still alive.
            last = s.p + sum(1 for c in s.alive if c > 0)
        else:
            return False
        for m in range(N):
            if s.phantoms[m]:
                s.phantom_pass[m] = last
        s.done, s.passes = True, last
        return True

    def _leaving(self, alive, tuples, since_base, seen, apart, n, thr, removed_obs) -> DataFrame:
        """The tuples that leave in this pass."""
        view = _values_view(alive, self.logged(self.s.base_pass)[:-1])
        before, _ = surviving_tuples(tuples, view, self.s.base_pass, since_base, seen, self.s.base_tuples, self.opts, self.ctx.ids, apart)
        values = alive.filter(_gone(n, thr)).select("value")
        hot = None
        if mem.shuffles(values, removed_obs, self.opts, self.ctx.ids[n]):
            hot = mem.hot_values(alive, n, self.s.tuples, _gone(n, thr), self.opts)
        return mem.restrict(before, f"a{n}", values, removed_obs, keep=True, hot=hot, opts=self.opts, card=self.ctx.ids[n])

    def _write_values(self, new: DataFrame, n: int, thr: float) -> None:
        """Write the next alive values; with a kept histogram, move the changed ones in it."""
        s = self.s
        rows = {"tuples": F.sum(F.when(F.col("mode") == 0, F.col("tuples")))}
        if not self.moving:
            new = new.select("mode", "value", "mass", "tuples")
            _, s.table, seen = counted(new, "values", rows, self.folder)
        else:
            new = new.withColumn("changed", F.col("old") != F.col("mass"))
            rows["changed"] = F.sum(F.col("changed").cast("long"))
            table, s.table, seen = counted(new, "values", rows, self.folder, partition="changed")
            hist = moved_histogram(self.kept_histogram().filter(~_gone(n, thr)), table.filter("changed"))
            _, s.hist, count = counted(hist, "histogram", {"rows": F.count(F.lit(1))}, self.folder)
            s.stat_rows = int(seen["changed"] or 0) + int(count["rows"])  # the changed values, then the histogram
            s.written.append(s.hist)
        s.written.append(s.table)
        s.tuples = int(seen["tuples"] or 0)

    # -- result ---------------------------------------------------------------

    def found(self) -> BlockFound:
        s, ctx = self.s, self.ctx
        log = [PassLog(**{**x, "alive_before": tuple(x["alive_before"])}) for x in s.log]
        if s.cut is None:
            cut_pass = cut_mass = cut_value = None
            cards, search_mass = tuple(ctx.cards), self.mass
        else:
            cut_pass, cut_mass, cut_k, cut_s, cut_mode, m_before, cut_value = s.cut
            removed = [0] * self.N
            for x in log[:cut_pass]:
                removed[x.mode] += x.k
            removed[cut_mode] += cut_k
            cards = tuple(c - r for c, r in zip(ctx.cards, removed))
            search_mass = m_before - cut_s
        last = s.removed[-1] if s.removed else None
        alive = self.values(s.table) if last is None or last[0] != s.table else self.values(s.table).filter(~_gone(*last[1:]))
        final = _values_view(alive, self.logged())
        return BlockFound(
            cut_pass, cut_mass, float(s.best or 0.0), int(search_mass), cards, s.passes, final, tuple(s.phantom_pass), log, cut_value,
            [*s.written, *Base(**s.base).paths()],
        )


def _gone(mode: int, threshold: float):
    """Removed in a pass that peels ``mode``."""
    return (F.col("mode") == mode) & (F.col("mass").cast("double") <= F.lit(threshold))


def find_block(
    ctx: Context,
    B: DataFrame,
    V: DataFrame,
    mass: int,
    measure: str = "geo",
    policy: str = "density",
    theta: float = 1.0,
    folder: str | None = None,
    state: dict | None = None,
    after_pass: Callable[[dict], None] | None = None,
) -> BlockFound:
    """Greedy peeling of one block (P1-P15), see :class:`_Peel`. ``after_pass`` receives the state
    after every pass; a search that is given such a ``state`` goes on from there."""
    if theta < 1.0:
        raise ValueError("theta must be at least 1")
    peel = _Peel(ctx, B, V, mass, measure, policy, theta, folder, State(**state) if state else None)
    while not peel.s.done and sum(peel.s.alive) > 0:
        peel.step()
        if after_pass:
            after_pass(asdict(peel.s))
    return peel.found()


def upper_bound(meas, mass: int, alive: Sequence[int], mass_all: int, cards_all: Sequence[int]) -> float:
    """Largest density any non-empty block inside the current one can reach.

    ``geo`` and ``ari``: a block's density is at most its mass, which is at
    most the mass left. ``susp`` = M ln(M / L) - M + L with L = M0 p / P is
    jointly convex in (M, L), so its maximum over [0, M] x [M0 / P, L_now] is
    at a corner.
    """
    name = getattr(meas, "name", "")
    if name in ("geo", "ari"):
        return float(mass)
    if name != "susp" or mass_all <= 0:
        return float("inf")
    p_all = product_py(cards_all)
    lam_now = float(mass_all) * product_py(alive) / p_all
    lam_min = float(mass_all) / p_all

    def f(m: float, lam: float) -> float:
        return lam if m <= 0 else m * math.log(m / lam) - m + lam

    m = float(mass)
    return max(f(0.0, lam_now), f(0.0, lam_min), f(m, lam_now), f(m, lam_min))


def _values_view(alive: DataFrame, logs: list[DataFrame]) -> DataFrame:
    """(mode, value, mass, tuples, rpass): alive values (rpass null) and logged removals."""
    out = alive.select("mode", "value", "mass", "tuples", F.lit(None).cast("int").alias("rpass"))
    for d in logs:
        out = out.unionByName(d.select("mode", "value", "mass", "tuples", F.col("rpass").cast("int")))
    return out


def _update_values(alive: DataFrame, B_next: DataFrame, n_dims: int, opts: Options) -> DataFrame:
    """New masses of the alive values from the surviving tuples (P12), with the ``old`` ones.

    One aggregation over the union of the alive value rows (mass 0) and the
    unpivoted tuples: the tuples are pre-aggregated in each task and the plan
    has a single exchange, no join and no sort. Every value of a surviving
    tuple is alive, so no new key appears.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    vrows = alive.select("mode", "value", zero.alias("nm"), zero.alias("nt"), F.col("mass").alias("om"))
    trows = unpivot_dims(B_next, n_dims, ["v"]).select("mode", "value", F.col("v").alias("nm"), one.alias("nt"), zero.alias("om"))
    sums = F.sum("nm").cast("long").alias("mass"), F.sum("nt").cast("long").alias("tuples"), F.sum("om").cast("long").alias("old")
    return vrows.unionByName(trows).groupBy("mode", "value").agg(*sums)


def _update_values_delta(alive: DataFrame, gone: DataFrame, n_dims: int, peeled: int | None = None) -> DataFrame:
    """P11 form: subtract the masses of the tuples that left this pass
    (``gone``) instead of recomputing from the survivors. In the dimension ``peeled`` every value of
    a tuple that left was removed, and none of those is alive: nothing is added up for it."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    vrows = alive.select("mode", "value", F.col("mass").alias("nm"), F.col("tuples").alias("nt"), F.col("mass").alias("om"), F.lit(1).alias("is_alive"))
    without = peeled if n_dims > 1 else None
    trows = unpivot_dims(gone, n_dims, ["v"], without).select("mode", "value", (-F.col("v")).alias("nm"), (-one).alias("nt"), zero.alias("om"), F.lit(0).alias("is_alive"))
    sums = F.sum("nm").cast("long").alias("mass"), F.sum("nt").cast("long").alias("tuples"), F.sum("om").cast("long").alias("old")
    agg = vrows.unionByName(trows).groupBy("mode", "value").agg(*sums, F.max("is_alive").alias("is_alive"))
    # tuples that left also carry the values removed this pass: keep alive keys only
    return agg.filter(F.col("is_alive") == 1).select("mode", "value", "mass", "tuples", "old")


# ---------------------------------------------------------------------------
# blocks: members, evaluation, deflation, the k-block loop
# ---------------------------------------------------------------------------


@dataclass
class Block:
    index: int  # 1-based
    found: BlockFound
    members: DataFrame  # (mode, value), stored; never-seen ids are in ``unseen``
    unseen: tuple[int, ...]  # never-seen ids that belong to the block, per dimension
    mass: int  # on the original relation
    tuples: int  # on the original relation
    density: float  # on the original relation, measure initialised on it
    seconds: float

    @property
    def sizes(self) -> tuple[int, ...]:
        """Members among the seen values, per dimension."""
        return tuple(c - u for c, u in zip(self.found.cards, self.unseen))


def block_unseen(ctx: Context, found: BlockFound) -> tuple[int, ...]:
    """Never-seen ids that belong to the block, per dimension."""
    return tuple(p if m else 0 for p, m in zip(ctx.phantoms, found.phantom_members()))


def unseen_members(ctx: Context, block: Block) -> DataFrame:
    """(mode, from, to): the never-seen ids of the block as intervals."""
    out = ctx.spark.createDataFrame([], "mode int, `from` long, to long")
    for m, n in enumerate(block.unseen):
        if n:
            gaps = unseen_ranges(member_set(ctx.all_values, m), ctx.cards[m])
            out = out.unionByName(gaps.select(F.lit(m).alias("mode"), "from", "to"))
    return out


def member_set(members: DataFrame, mode: int) -> DataFrame:
    return members.filter(F.col("mode") == mode).select("value")


def block_tuples(ctx: Context, rel_df: DataFrame, members: DataFrame, sizes: Sequence[int], vm: DataFrame, tuples: int) -> DataFrame:
    """Tuples with every value in the block (J1): N semi joins, most selective
    first; bag semantics (duplicates kept). ``sizes`` counts the members among seen values."""
    opts = ctx.opts
    out = rel_df
    for m in sorted(range(ctx.n_dims), key=lambda m: (sizes[m] / max(ctx.distinct[m], 1), m)):
        if sizes[m] >= ctx.distinct[m]:
            continue  # every value of this dimension is a member
        vals = member_set(members, m)
        hot = mem.hot_values(vm, m, tuples, vals, opts) if mem.shuffles(vals, sizes[m], opts, ctx.ids[m]) else None
        out = mem.restrict(out, f"a{m}", vals, sizes[m], keep=True, hot=hot, opts=opts, card=ctx.ids[m])
    return out


def deflate(ctx: Context, R: DataFrame, members: DataFrame, sizes: Sequence[int], vm: DataFrame, tuples: int) -> DataFrame:
    """R without the tuples inside the block (J2): a tuple goes only if *all*
    its values are members, so this is N membership flags, not N anti joins."""
    opts = ctx.opts
    cols = R.columns
    out = R
    inside = F.lit(True)
    for m in range(ctx.n_dims):
        if sizes[m] >= ctx.distinct[m]:
            continue
        vals = member_set(members, m)
        hot = mem.hot_values(vm, m, tuples, vals, opts) if mem.shuffles(vals, sizes[m], opts, ctx.ids[m]) else None
        out = mem.flag(out, f"a{m}", vals, sizes[m], f"_f{m}", hot=hot, opts=opts, card=ctx.ids[m])
        inside = inside & F.col(f"_f{m}")
    return out.filter(~inside).select(*cols)


def tag_blocks(ctx: Context, df: DataFrame, blocks: Sequence[Block], tuples: int) -> DataFrame:
    """The tuples of ``df`` in some of the blocks (at most 63), with the mask of those they are in."""
    sets = [BlockSet(b.members, b.sizes) for b in blocks]
    return tag(df, sets, ctx.distinct, ctx.all_values, tuples, ctx.ids, ctx.opts)


def evaluate(ctx: Context, blocks: list[Block], measure) -> list[tuple[list[Block], DataFrame, str]]:
    """Mass, tuples and density of all blocks on the original relation (A6): one scan, whose
    tuples are stored with their masks for the sinks. Returns (blocks, tagged tuples, path) for
    each group of up to 63 blocks; blocks of every seen value need no scan."""
    hits = []
    some = [b for b in blocks if any(s < d for s, d in zip(b.sizes, ctx.distinct))]
    for b in blocks:
        b.mass, b.tuples = ctx.mass, ctx.tuples
    for at in range(0, len(some), BITS):
        group = some[at : at + BITS]
        tagged, path = stored(tag_blocks(ctx, ctx.rows, group, ctx.n_rows), "hits")
        found = totals(tagged, len(group))
        for i, b in enumerate(group, start=1):
            b.mass, b.tuples = found.get(i, (0, 0))
        hits.append((group, tagged, path))
    for b in blocks:
        b.density = float(measure.value(b.mass, b.found.cards))
    return hits


@dataclass
class Result:
    ctx: Context
    blocks: list[Block]
    measure: str
    policy: str
    theta: float
    seconds: float
    hits: list = field(default_factory=list)  # of ``evaluate``
    tables: list[str] = field(default_factory=list)

    def report(self) -> DataFrame:
        """One row per block (T4, A9): cardinalities, mass and density on the
        original, search density, passes of the full peel, passes that had to be run,
        running time."""
        n = self.ctx.n_dims
        schema = (
            "block int, "
            + ", ".join(f"card_{i} long" for i in range(n))
            + ", mass long, tuples long, density double, search_density double, search_mass long, passes int, passes_run int, seconds double"
        )
        rows = [
            (b.index, *[int(c) for c in b.found.cards], b.mass, b.tuples, float(b.density), float(b.found.search_density),
             int(b.found.search_mass), int(b.found.passes), len(b.found.log), float(b.seconds))
            for b in self.blocks
        ]
        return self.ctx.spark.createDataFrame(rows, schema)

    def passes(self) -> DataFrame:
        """One row per pass that was run (T9): what it removed, what was alive before, rows that its
        statistics and its joins have read, bytes of the tables behind them, seconds."""
        n = self.ctx.n_dims
        schema = (
            "block int, pass int, mode int, k long, s long, mass_before long, " + ", ".join(f"alive_{i} long" for i in range(n))
            + ", stat_rows long, tuple_rows long, bytes long, seconds double"
        )
        rows = [
            (b.index, p, x.mode, x.k, x.s, x.mass_before, *x.alive_before, x.stat_rows, x.tuple_rows, x.bytes, x.seconds)
            for b in self.blocks
            for p, x in enumerate(b.found.log)
        ]
        return self.ctx.spark.createDataFrame(rows, schema)

    def member_ranges(self) -> DataFrame:
        """(block, mode, from, to) for all blocks: seen values one by one, never-seen ids as
        intervals. The lengths add up to the cardinalities."""
        out = self.ctx.spark.createDataFrame([], "block int, mode int, `from` long, to long")
        for b in self.blocks:
            one = b.members.select("mode", F.col("value").alias("from"), F.col("value").alias("to"))
            out = out.unionByName(one.unionByName(unseen_members(self.ctx, b)).select(F.lit(b.index).alias("block"), "mode", "from", "to"))
        return out

    def members(self) -> DataFrame:
        """(block, mode, value) for all blocks, never-seen ids written out."""
        out = self.ctx.spark.createDataFrame([], "block int, mode int, value long")
        for b in self.blocks:
            d = b.members
            if any(b.unseen):
                d = d.unionByName(expand(unseen_members(self.ctx, b), ["mode"]))
            out = out.unionByName(d.select(F.lit(b.index).alias("block"), "mode", "value"))
        return out

    def tuples(self) -> DataFrame:
        """(block, a0.., v): the original tuples of every block (T6). They are those that the
        evaluation stored; merged coordinates are read again from the original, in one scan.
        A sole block is a constant column, by which a partitioned write need not sort."""
        ctx = self.ctx
        columns = ctx.original.columns
        parts = []
        for group, tagged, _ in self.hits:
            if ctx.merged:
                tagged = tag_blocks(ctx, ctx.original, group, ctx.tuples)
            names = [F.lit(b.index) for b in group]
            index = F.element_at(F.array(*names), F.col("block")) if len(group) > 1 else names[0]
            parts.append(per_block(tagged, len(group)).select(index.alias("block"), *columns))
        tagged = {b.index for group, _, _ in self.hits for b in group}
        whole = [F.lit(b.index) for b in self.blocks if b.index not in tagged]
        if whole:
            block = F.explode(F.array(*whole)) if len(whole) > 1 else whole[0]
            parts.append(ctx.original.select(block.alias("block"), *columns))
        if not parts:
            return ctx.original.limit(0).select(F.lit(0).alias("block"), *columns)
        return reduce(DataFrame.unionByName, parts)

    def best_density(self) -> float:
        return max((b.density for b in self.blocks), default=0.0)

    def text(self) -> str:
        """Human report in the reference's shape (Block / Volume / Density / Mass)."""
        lines = []
        for b in self.blocks:
            lines.append(f"Block: {b.index}")
            lines.append("Volume: " + " X ".join(str(c) for c in b.found.cards))
            lines.append(f"Density: {b.density}")
            lines.append(f"Mass: {b.mass}")
        lines.append(f"Running time: {self.seconds:.3f} seconds")
        return "\n".join(lines)

    def close(self) -> None:
        """Give back every table of this result; its DataFrames cannot be read afterwards."""
        for path in [*self.tables, *(h[2] for h in self.hits)]:
            release(self.ctx.spark, path)
        self.tables, self.hits = [], []
        self.ctx.close()


def find_blocks(
    rel: Relation | Context,
    k: int = 1,
    measure: str = "geo",
    policy: str = "density",
    theta: float = 1.0,
    opts: Options = DEFAULT,
    cardinality: str = "max_plus_one",
    stop_when_empty: bool = False,
    journal: str | None = None,
    after_pass: Callable[[int, int], None] | None = None,
) -> Result:
    """The k densest blocks, each searched on what the earlier ones left.
    An empty relation has no blocks.

    ``journal`` names a folder of the shared storage in which every pass is written down: the
    same call on the same relation goes on after the last pass found there, in
    whatever driver it runs. ``after_pass`` is called with (block, passes done) after each.
    """
    t_start = time.time()
    if isinstance(rel, Context):
        ctx = rel if opts is DEFAULT else replace(rel, opts=opts)
    else:
        ctx = prepare(rel, opts, cardinality)
    if isinstance(measure, str):
        key = measure.strip().lower()
        report_measure = make_measure(key, ctx.n_dims, ctx.mass, ctx.cards)
    else:  # a user measure: initialised by its own factory on (mass, cards)
        key, report_measure = measure, measure
    spark, rows_schema = ctx.spark, ctx.rows.schema
    book, folder, past = None, None, {}
    run = {"measure": getattr(measure, "name", key), "policy": policy, "theta": theta, "mass": ctx.mass, "tuples": ctx.n_rows, "cards": list(ctx.cards), "histogram": ctx.opts.histogram}
    if journal:
        book, folder = Journal(spark, journal), journal.rstrip("/")
        past = book.load() or {}
        if past and past["run"] != run:
            raise ValueError(f"{journal} belongs to another search: {past['run']}, not {run}")
    done = past.get("blocks", [])
    R_path, V_path, R_mass = past.get("rest", (None, None, ctx.mass))
    state = past.get("state")
    R = spark.read.schema(rows_schema).parquet(R_path) if R_path else ctx.rows
    V = spark.read.schema("mode int, value long, mass long, tuples long").parquet(V_path) if V_path else ctx.all_values
    tables: list[str] = []

    def take_out(block: Block) -> None:
        """Go on with what the block leaves of the relation."""
        nonlocal R, V, R_path, V_path, R_mass
        if block.found.cut_pass is None:
            light, left, R_mass = False, ctx.rows.filter(F.lit(False)), 0
        else:
            light = 2 * block.found.search_mass <= R_mass  # most of the tuples are likely left: add up the block's
            left, R_mass = deflate(ctx, R, block.members, block.sizes, V, _count_tuples(V)), R_mass - block.found.search_mass
        before, (R, R_path) = R, stored(left, "rest", folder)
        start = _values_without(ctx, before, V, block) if light else _start_values(ctx, R)
        V, V_path = stored(start.select(F.col("mode").cast("int"), "value", "mass", "tuples"), "start", folder)

    blocks: list[Block] = []

    def note(state: dict | None) -> None:
        if book:
            book.save({"run": run, "blocks": done, "rest": (R_path, V_path, R_mass), "state": state})

    for i in range(k if ctx.tuples else 0):
        t0 = time.time()
        if i < len(done):  # found by an earlier driver
            b = done[i]
            members = spark.read.schema("mode int, value long").parquet(b["members"])
            log = [PassLog(**{**x, "alive_before": tuple(x["alive_before"])}) for x in b["log"]]
            found = BlockFound(b["cut"][0], b["cut"][1], b["density"], b["mass"], tuple(b["cards"]), b["passes"], members, tuple(b["phantom_pass"]), log, b["cut"][2])
            blocks.append(Block(i + 1, found, members, block_unseen(ctx, found), 0, 0, 0.0, b["seconds"]))
            tables.append(b["members"])
            if len(done) < k and not past["rest"][0]:  # more blocks are wanted now than then
                take_out(blocks[-1])
            continue
        if stop_when_empty and R_mass == 0:
            break

        def pass_done(s: dict) -> None:
            note(s)
            if after_pass:
                after_pass(i + 1, s["p"])

        found = find_block(ctx, R, V, R_mass, key, policy, theta, folder, state, pass_done)
        state = None
        members, path = stored(found.members_observed().select(F.col("mode").cast("int"), "value"), "members", folder)
        tables.append(path)
        block = Block(i + 1, found, members, block_unseen(ctx, found), 0, 0, 0.0, 0.0)
        blocks.append(block)
        old = [p for p in (R_path, V_path) if p]
        R_path = V_path = None
        if i + 1 < k:  # no deflation after the last block
            take_out(block)
        else:
            R_mass = ctx.mass
        block.seconds = time.time() - t0
        done.append({
            "members": path, "cut": [found.cut_pass, found.cut_mass, found.cut_value], "density": found.search_density, "mass": found.search_mass, "cards": list(found.cards),
            "passes": found.passes, "phantom_pass": list(found.phantom_pass), "log": [asdict(x) for x in found.log], "seconds": block.seconds,
        })
        note(None)
        for p in {*found.tables, *old}:  # nothing reads the tables of a finished search any more
            release(spark, p)
    tables += [p for p in (R_path, V_path) if p]  # after an early stop
    t0 = time.time()
    hits = evaluate(ctx, blocks, report_measure) if blocks else []
    for b in blocks:  # the one scan for all blocks, in equal shares
        b.seconds += (time.time() - t0) / len(blocks)
    return Result(ctx, blocks, key, policy, theta, time.time() - t_start, hits, tables)
