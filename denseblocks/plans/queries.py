"""Named queries over the test tables: every operator of the inventory as a
callable ``(spark, sf_dir) -> DataFrame``.

Relations: ``L`` lineitem, ``P`` lineitem plus a planted block, ``E``
events (see ``sources.tables``). Densities are rounded to 6 digits (3 for
suspiciousness) so that one-ulp differences of pow/ln between runtimes do
not matter. Every query does its own work.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Options, ensure_checkpoint_dir
from ..functions.density import if_removed_sql, make_measure, of_cards, product_py
from ..operators import membership as mem
from ..operators.peel import (
    PassState,
    choose_mode,
    choose_mode_df,
    collect_mode_stats,
    histogram,
    mode_stats_df,
    prefix_densities,
)
from ..operators.masks import per_block
from ..operators.ranges import value_mass_ranges
from ..operators.profile import mass_check, mass_histogram, profile, profile_df, value_masses, value_masses_filled
from ..relation import from_columns
from ..sources.encode import dictionary, encode_column
from ..sources.sinks import publish_blocks, published, write_blocks
from ..sources.tables import RELATIONS, planted_block, table
from ..sources.text import classify_lines, read_relation_text
from . import job
from .search import (
    Context,
    Result,
    _update_values,
    _update_values_delta,
    _values_view,
    block_tuples,
    deflate,
    find_blocks,
    prepare,
    surviving_tuples,
    tag_blocks,
)

def relation(spark: SparkSession, sf_dir: str, name: str):
    return RELATIONS[name](spark, sf_dir)


def context(spark: SparkSession, sf_dir: str, name: str) -> Context:
    return prepare(relation(spark, sf_dir, name), DEFAULT)


def result(spark: SparkSession, sf_dir: str, name: str, measure: str, policy: str, theta: float, k: int, opts: Options = DEFAULT, cardinality: str = "max_plus_one") -> Result:
    ctx = prepare(relation(spark, sf_dir, name), opts, cardinality)
    return find_blocks(ctx, k, measure, policy, theta, opts=opts)


def digits(measure: str) -> int:
    return 3 if measure == "susp" else 6


# ---------------------------------------------------------------------------
# profiling and aggregation
# ---------------------------------------------------------------------------


def q_profile(spark, sf_dir, rel="L"):
    return profile_df(relation(spark, sf_dir, rel))


def q_value_masses(spark, sf_dir, rel="L"):
    r = relation(spark, sf_dir, rel)
    return value_masses(r.df, r.n_dims)


def q_value_masses_filled(spark, sf_dir, rel="E"):
    ctx = context(spark, sf_dir, rel)
    return value_masses_filled(ctx.original, ctx.n_dims, ctx.cards)


def q_mass_check(spark, sf_dir, rel="L"):
    r = relation(spark, sf_dir, rel)
    return mass_check(value_masses(r.df, r.n_dims)).select("mode", "mass", F.col("values").alias("n_values"))


def q_mass_histogram(spark, sf_dir, rel="L"):
    r = relation(spark, sf_dir, rel)
    return mass_histogram(value_masses(r.df, r.n_dims))


def q_block_density(spark, sf_dir, measure, rel="L"):
    """Density of the block {every a0} x {every a1} x {one a2 value}, per a2
    value (D8 on given blocks; measure initialised on the whole relation)."""
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    per = ctx.original.groupBy(F.col("a2").alias("value")).agg(F.sum("v").cast("long").alias("mass"))
    d = of_cards(meas, "mass", [ctx.cards[0], ctx.cards[1], 1])
    return per.select("value", "mass", F.round(d, digits(measure)).alias("density"))


def q_start_density(spark, sf_dir, rel="L"):
    """Density of the whole relation under each measure."""
    r = relation(spark, sf_dir, rel)
    p = profile(r)
    cols = []
    for m in ("ari", "geo", "susp"):
        d = of_cards(make_measure(m, r.n_dims, p.mass, p.cards), "mass", [f"card_{i}" for i in range(r.n_dims)])
        cols.append(F.round(d, digits(m)).alias(f"density_{m}"))
    return profile_df(r).select(*cols)


# ---------------------------------------------------------------------------
# the first pass of a search, piece by piece
# ---------------------------------------------------------------------------


def _first_state(ctx: Context, theta: float) -> PassState:
    return PassState(ctx.mass, ctx.cards, ctx.phantoms, theta)


def _hist(ctx: Context):
    return histogram(ctx.all_values.select("mode", "mass"), ctx.phantoms)


def q_candidates(spark, sf_dir, rel="P", theta=2.0):
    ctx = context(spark, sf_dir, rel)
    meas = make_measure("geo", ctx.n_dims, ctx.mass, ctx.cards)
    return mode_stats_df(_hist(ctx), _first_state(ctx, theta), meas).select("mode", "k", "s")


def q_mode_scores(spark, sf_dir, measure, rel="P", theta=2.0):
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    df = mode_stats_df(_hist(ctx), _first_state(ctx, theta), meas)
    return df.select("mode", "k", "s", F.round("score", digits(measure)).alias("score"))


def q_prefix_densities(spark, sf_dir, measure="geo", rel="P", theta=2.0):
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    pre = prefix_densities(_hist(ctx), _first_state(ctx, theta), meas)
    return pre.select("mode", "mass", "k", "s", F.round("density", digits(measure)).alias("density"))


def q_best_cut(spark, sf_dir, measure="geo", rel="P", theta=2.0):
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    df = mode_stats_df(_hist(ctx), _first_state(ctx, theta), meas)
    return df.select("mode", F.round("best_density", digits(measure)).alias("best_density"), "best_mass")


def q_single_removal_scores(spark, sf_dir, measure="geo", rel="P", theta=2.0):
    """Density if only the lightest alive value of each dimension were removed
    (D6, the one-value form of D5)."""
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    state = _first_state(ctx, theta)
    light = _hist(ctx).groupBy("mode").agg(F.min("mass").alias("mass"))
    card = " ".join(f"WHEN mode = {m} THEN CAST({c} AS BIGINT)" for m, c in enumerate(state.alive))
    score = if_removed_sql(meas, ctx.mass, product_py(state.alive), sum(state.alive), f"CASE {card} END", 1, "mass")
    return light.select("mode", "mass", F.round(F.expr(score), digits(measure)).alias("score"))


def q_choose_mode(spark, sf_dir, policy, measure="geo", rel="P", theta=2.0):
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    df = mode_stats_df(_hist(ctx), _first_state(ctx, theta), meas)
    return choose_mode_df(df, policy, ctx.cards).select("mode")


def _first_pass(spark, sf_dir, rel="P", measure="geo", policy="density", theta=2.0):
    """(ctx, chosen mode, alive values after the removal, removal log, tuples
    left, removed count) after one pass."""
    ctx = context(spark, sf_dir, rel)
    meas = make_measure(measure, ctx.n_dims, ctx.mass, ctx.cards)
    state = _first_state(ctx, theta)
    stats = collect_mode_stats(mode_stats_df(_hist(ctx), state, meas))
    n = choose_mode(policy, stats, ctx.cards)
    thr = float(ctx.mass) * theta / ctx.cards[n]
    gone = (F.col("mode") == n) & (F.col("mass").cast("double") <= F.lit(thr))
    A = ctx.all_values
    A_kept = A.filter(~gone)
    logged = A.filter(gone).withColumn("rpass", F.lit(0))
    removed = [0] * ctx.n_dims
    removed[n] = stats[n].k - ctx.phantoms[n]
    alive = [c - ph for c, ph in zip(ctx.cards, ctx.phantoms)]
    alive[n] = ctx.cards[n] - stats[n].k
    B1, _ = surviving_tuples(ctx.original, _values_view(A_kept, [logged]), 0, removed, alive, ctx.tuples, ctx.opts)
    return ctx, n, A_kept, logged, B1, removed[n]


def q_remove_values(spark, sf_dir):
    return _first_pass(spark, sf_dir)[4]


def q_update_masses_recompute(spark, sf_dir):
    ctx, n, A_kept, logged, B1, _ = _first_pass(spark, sf_dir)
    return _values_view(_update_values(A_kept, B1, ctx.n_dims, ctx.opts), [logged]).drop("tuples")


def q_update_masses_delta(spark, sf_dir):
    ctx, n, A_kept, logged, B1, removed = _first_pass(spark, sf_dir)
    gone = mem.restrict(ctx.original, f"a{n}", logged.select("value"), removed, keep=True, opts=ctx.opts)
    return _values_view(_update_values_delta(A_kept, gone, ctx.n_dims), [logged]).drop("tuples")


# ---------------------------------------------------------------------------
# blocks
# ---------------------------------------------------------------------------


def _block1(spark, sf_dir, rel="P", measure="geo", policy="density", theta=2.0):
    res = result(spark, sf_dir, rel, measure, policy, theta, 1)
    return res.ctx, res.blocks[0]


def q_block_tuples(spark, sf_dir):
    ctx, b = _block1(spark, sf_dir)
    return block_tuples(ctx, ctx.original, b.members, b.sizes, ctx.all_values, ctx.tuples)


def q_block_mass(spark, sf_dir):
    t = q_block_tuples(spark, sf_dir)
    return t.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("mass"), F.count(F.lit(1)).alias("tuples"))


def q_block_cardinalities(spark, sf_dir):
    res = result(spark, sf_dir, "P", "geo", "density", 2.0, 1)
    return res.member_ranges().groupBy("mode").agg(F.sum(F.col("to") - F.col("from") + 1).alias("n_values"))


def q_deflate(spark, sf_dir):
    ctx, b = _block1(spark, sf_dir)
    return deflate(ctx, ctx.original, b.members, b.sizes, ctx.all_values, ctx.tuples)


def q_find_block(spark, sf_dir, rel, measure, policy, theta=2.0):
    res = result(spark, sf_dir, rel, measure, policy, theta, 1)
    return res.members().select("mode", "value")


def rounded_report(res: Result, places: int | None = None) -> DataFrame:
    dg = digits(res.measure) if places is None else places
    rep = res.report().drop("seconds")
    return rep.withColumn("density", F.round("density", dg)).withColumn("search_density", F.round("search_density", dg))


def q_find_blocks_report(spark, sf_dir, rel, measure, policy, theta=2.0, k=1):
    # densities of H are above 10^10: six places would be beyond a double
    return rounded_report(result(spark, sf_dir, rel, measure, policy, theta, k), 3 if rel == "H" else None)


def q_best_density(spark, sf_dir, rel, measure, policy, theta=2.0, k=2):
    """Best reported density over the k blocks."""
    rep = rounded_report(result(spark, sf_dir, rel, measure, policy, theta, k))
    return rep.agg(F.max("density").alias("best_density"))


#: Whole searches by other ways than the default.
WAYS = {
    "delta": Options(update="delta"),
    "shuffled": Options(broadcast_rows=3, bitmap_bytes=0, hot_parts=16, salts=4),
    "by_value": Options(cut_path="values"),
    "early_exit": Options(early_exit=True),
    # sets above the broadcast limit: by bitmaps, by tuples in buckets
    "bitmap": Options(broadcast_rows=3),
    "bucketed": Options(broadcast_rows=3, bitmap_bytes=0, hot_parts=16, layout="bucketed"),
    "moved_histogram": Options(update="delta", histogram="delta"),
}


def q_find_blocks_way(spark, sf_dir, way):
    rep = rounded_report(result(spark, sf_dir, "P", "geo", "density", 2.0, 2, WAYS[way]))
    # other ways run fewer or more of the passes; only an early exit leaves their number open
    return rep.drop(*{"by_value": ["passes_run"], "early_exit": ["passes", "passes_run"]}.get(way, []))


def q_block_totals(spark, sf_dir, rel="P", measure="ari", policy="cardinality", theta=2.0, k=3):
    """Mass and number of tuples of k blocks, from one scan of the relation."""
    res = result(spark, sf_dir, rel, measure, policy, theta, k)
    tagged = tag_blocks(res.ctx, res.ctx.rows, res.blocks, res.ctx.n_rows)
    return per_block(tagged, k).groupBy("block").agg(F.sum("v").alias("mass"), F.sum("n").alias("tuples"))


def q_blocks_tuples(spark, sf_dir, rel="P", measure="ari", policy="cardinality", theta=2.0, k=3):
    """The tuples of k blocks."""
    return result(spark, sf_dir, rel, measure, policy, theta, k).tuples()


def q_searched_rows(spark, sf_dir, rel="F"):
    """Tuples of a relation, and the rows that a search of it works on."""
    ctx = context(spark, sf_dir, rel)
    return ctx.rows.agg(F.sum("n").alias("tuples"), F.count(F.lit(1)).alias("n_rows"))


def q_member_ranges(spark, sf_dir, rel="G", k=6):
    return result(spark, sf_dir, rel, "geo", "density", 2.0, k).member_ranges()


def q_value_mass_ranges(spark, sf_dir, rel):
    ctx = context(spark, sf_dir, rel)
    return value_mass_ranges(ctx.original, ctx.n_dims, ctx.cards)


def q_passes(spark, sf_dir, opts=DEFAULT):
    """What each pass did, and the rows that its statistics have read."""
    log = result(spark, sf_dir, "P", "geo", "density", 2.0, 2, opts).passes()
    return log.select("block", "pass", "mode", "k", "s", "mass_before", "alive_0", "alive_1", "alive_2", "stat_rows")


class Stopped(Exception):
    pass


def q_resumed(spark, sf_dir, theta=1.3):
    """A search that is stopped twice and taken up again from its journal."""
    folder = _folder(spark, "journal")
    rel = lambda: relation(spark, sf_dir, "P")
    for stop in ((1, 2), (2, 1)):

        def after_pass(block, done):
            if (block, done) == stop:
                raise Stopped

        try:
            find_blocks(rel(), 2, "geo", "density", theta, journal=folder, after_pass=after_pass)
        except Stopped:
            continue
        raise RuntimeError(f"the search ended before {stop}")
    return rounded_report(find_blocks(rel(), 2, "geo", "density", theta, journal=folder))


def q_find_blocks_distinct(spark, sf_dir):
    return rounded_report(result(spark, sf_dir, "P", "geo", "density", 2.0, 1, cardinality="distinct"))


def q_find_blocks_empty(spark, sf_dir):
    """An empty relation (no quantity is negative) has no blocks."""
    df = table(spark, sf_dir, "lineitem").where("l_quantity < 0")
    return rounded_report(find_blocks(from_columns(df, ["l_partkey", "l_suppkey", "l_linenumber"], "l_quantity"), 2, "geo", "density", 2.0))


# ---------------------------------------------------------------------------
# dictionaries, rejected tuples, sinks and the job, read back from what they wrote
# ---------------------------------------------------------------------------


def q_dictionary(spark, sf_dir):
    return dictionary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k")), "k")


def q_rejected(spark, sf_dir):
    """Null keys (flag R) and fractional measures (halves on even lines) are counted."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("double")
    li = li.select("l_partkey", "l_suppkey", F.expr("nullif(l_returnflag, 'R')").alias("flag"), F.when(F.col("l_linenumber") % 2 == 0, qty / 2).otherwise(qty).alias("qty"))
    enc, _ = encode_column(li, "flag")
    return profile_df(from_columns(enc, ["l_partkey", "l_suppkey", "flag"], "qty"))


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _read_attributes(spark, out: str) -> DataFrame:
    return spark.read.csv(f"{out}/attributes", schema="mode int, value string, block int")


def _read_tuples(spark, out: str) -> DataFrame:
    return spark.read.csv(f"{out}/tuples", schema="a0 string, a1 string, a2 string, v long, block int")


def q_sink(spark, sf_dir, read):
    out = _folder(spark, "sink")
    write_blocks(result(spark, sf_dir, "P", "geo", "density", 2.0, 1), out)
    return read(spark, out)


def q_published(spark, sf_dir, read):
    """The outputs of two results under one folder: the newest manifest names the second."""
    out = _folder(spark, "published")
    publish_blocks(result(spark, sf_dir, "L", "geo", "density", 2.0, 1), out)
    publish_blocks(result(spark, sf_dir, "P", "geo", "density", 2.0, 1), out)
    return read(spark, published(spark, out))


def q_job_passes(spark, sf_dir):
    """The job with its further options, its passes read from the published output."""
    src, out = _folder(spark, "text"), _folder(spark, "job")
    table(spark, sf_dir, "lineitem").select(F.concat_ws(",", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long"))).write.text(src)
    options = ["--shuffle-partitions", "5", "--bitmap-bytes", "1000000", "--broadcast-rows", "3", "--journal", _folder(spark, "journal"), "--publish"]
    job.main([src, out, "3", "susp", "cardinality", "2.0", "1", *options])
    log = spark.read.option("header", True).csv(f"{published(spark, out)}/passes", schema="block int, pass int, mode int, k long, s long, mass_before long, alive_0 long, alive_1 long, alive_2 long, stat_rows long, tuple_rows long, bytes long, seconds double")
    timed = (F.col("seconds") > 0) & (F.col("tuple_rows") >= 0) & (F.col("bytes") >= 0)
    return log.select("block", "pass", "mode", "k", "s", "mass_before", "alive_0", "alive_1", "alive_2", timed.alias("timed"))


def q_job_csv(spark, sf_dir, read):
    """The command-line job on csv with integer columns and a string column."""
    src, out = _folder(spark, "csv"), _folder(spark, "job")
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("qty"))
    flag = li.agg(F.min("l_returnflag")).first()[0]  # the key with id 0
    rows.union(planted_block(spark).select("a0", "a1", F.lit(flag), "v")).write.option("header", True).csv(src)
    job.main([src, out, "3", "geo", "density", "2.0", "1", "--format", "csv", "--dims", "l_partkey,l_suppkey,l_returnflag", "--measure-column", "qty"])
    return read(spark, out)


# ---------------------------------------------------------------------------
# text source
# ---------------------------------------------------------------------------


def lineitem_lines(spark, sf_dir) -> DataFrame:
    """Text lines made from lineitem: ``partkey,suppkey,linenumber,qty,orderkey``;
    rows with return flag R carry the letter instead of the quantity
    (bad token) and rows with line number 7 stop after the quantity token
    without the line number (short)."""
    li = table(spark, sf_dir, "lineitem")
    qty = F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).otherwise(
        F.col("l_quantity").cast("long").cast("string")
    )
    full = F.concat_ws(",", "l_partkey", "l_suppkey", "l_linenumber", qty, "l_orderkey")
    short = F.concat_ws(",", "l_partkey", "l_suppkey", qty)
    return li.select(F.when(F.col("l_linenumber") == 7, short).otherwise(full).alias("value"))


def q_parse_text(spark, sf_dir):
    cls = classify_lines(lineitem_lines(spark, sf_dir), 3)
    return cls.filter(F.col("reason").isNull()).select("a0", "a1", "a2", "v")


def q_text_counters(spark, sf_dir):
    """Counters of the job that reads and stores the lines."""
    src = _folder(spark, "lines")
    lineitem_lines(spark, sf_dir).write.text(src)
    rel, _ = read_relation_text(spark, src, 3)
    p = rel.profile
    names = [*rel.counts, "tuples", "mass", *[f"card_{i}" for i in range(3)]]
    return spark.createDataFrame([(*rel.counts.values(), p.tuples, p.mass, *p.cards)], ", ".join(f"{n} long" for n in names))


def q_malformed(spark, sf_dir):
    cls = classify_lines(lineitem_lines(spark, sf_dir), 3)
    return cls.filter(F.col("reason").isNotNull()).select("line", "reason")


# ---------------------------------------------------------------------------
# catalogue
# ---------------------------------------------------------------------------


def catalogue() -> dict:
    q = {
        "profile_L": partial(q_profile, rel="L"),
        "profile_E": partial(q_profile, rel="E"),
        "value_masses_L": partial(q_value_masses, rel="L"),
        "value_masses_filled_E": partial(q_value_masses_filled, rel="E"),
        "mass_check_L": partial(q_mass_check, rel="L"),
        "mass_histogram_L": partial(q_mass_histogram, rel="L"),
        "start_density_L": partial(q_start_density, rel="L"),
        "candidates_theta2_P": q_candidates,
        "prefix_densities_geo_P": q_prefix_densities,
        "best_cut_geo_P": q_best_cut,
        "choose_mode_density_P": partial(q_choose_mode, policy="density"),
        "choose_mode_cardinality_P": partial(q_choose_mode, policy="cardinality"),
        "remove_values_P": q_remove_values,
        "update_masses_recompute_P": q_update_masses_recompute,
        "update_masses_delta_P": q_update_masses_delta,
        "block_tuples_P": q_block_tuples,
        "block_mass_P": q_block_mass,
        "block_cardinalities_P": q_block_cardinalities,
        "deflate_P": q_deflate,
        "parse_text_L": q_parse_text,
        "malformed_L": q_malformed,
    }
    for m in ("ari", "geo", "susp"):
        q[f"block_density_{m}_L"] = partial(q_block_density, measure=m, rel="L")
        q[f"mode_scores_{m}_P"] = partial(q_mode_scores, measure=m)
        for pol in ("density", "cardinality"):
            q[f"find_block_{m}_{pol}_P"] = partial(q_find_block, rel="P", measure=m, policy=pol)
            q[f"find_blocks_report_{m}_{pol}_P"] = partial(q_find_blocks_report, rel="P", measure=m, policy=pol)
    q["find_block_susp_density_E"] = partial(q_find_block, rel="E", measure="susp", policy="density")
    q["find_blocks_report_susp_density_E"] = partial(q_find_blocks_report, rel="E", measure="susp", policy="density")
    q["find_blocks_report_geo_density_L"] = partial(q_find_blocks_report, rel="L", measure="geo", policy="density")
    q["find_blocks_report_k2_geo_density_P"] = partial(q_find_blocks_report, rel="P", measure="geo", policy="density", k=2)
    q["best_density_k2_ari_cardinality_P"] = partial(q_best_density, rel="P", measure="ari", policy="cardinality")
    q["single_removal_scores_geo_P"] = q_single_removal_scores
    q["find_blocks_report_k3_geo_density_theta1_P"] = partial(q_find_blocks_report, rel="P", measure="geo", policy="density", theta=1.0, k=3)
    q["find_blocks_report_k2_geo_density_H"] = partial(q_find_blocks_report, rel="H", measure="geo", policy="density", k=2)
    for way in WAYS:
        q[f"find_blocks_report_k2_{way}_P"] = partial(q_find_blocks_way, way=way)
    q["find_blocks_report_distinct_P"] = q_find_blocks_distinct
    q["find_blocks_report_empty_L"] = q_find_blocks_empty
    q["block_totals_k3_P"] = q_block_totals
    q["blocks_tuples_k3_P"] = q_blocks_tuples
    q["searched_rows_F"] = q_searched_rows
    q["find_blocks_report_k3_geo_density_F"] = partial(q_find_blocks_report, rel="F", measure="geo", policy="density", k=3)
    q["blocks_tuples_k3_F"] = partial(q_blocks_tuples, rel="F", measure="geo", policy="density")
    q["find_blocks_report_k6_geo_density_G"] = partial(q_find_blocks_report, rel="G", measure="geo", policy="density", k=6)
    q["member_ranges_k6_G"] = q_member_ranges
    q["value_mass_ranges_G"] = partial(q_value_mass_ranges, rel="G")
    q["value_mass_ranges_E"] = partial(q_value_mass_ranges, rel="E")
    q["text_counters_L"] = q_text_counters
    q["passes_k2_P"] = q_passes
    q["passes_k2_moved_histogram_P"] = partial(q_passes, opts=WAYS["moved_histogram"])
    q["resumed_report_k2_P"] = q_resumed
    q["published_attributes_P"] = partial(q_published, read=_read_attributes)
    q["published_tuples_P"] = partial(q_published, read=_read_tuples)
    q["job_passes_lineitem"] = q_job_passes
    q["dictionary_orders"] = q_dictionary
    q["rejected_lineitem"] = q_rejected
    for name, run in (("sink", q_sink), ("job_csv", q_job_csv)):
        q[f"{name}_attributes_P"] = partial(run, read=_read_attributes)
        q[f"{name}_tuples_P"] = partial(run, read=_read_tuples)
    q["find_blocks_report_k2_ari_cardinality_P"] = partial(
        q_find_blocks_report, rel="P", measure="ari", policy="cardinality", k=2
    )
    return q
