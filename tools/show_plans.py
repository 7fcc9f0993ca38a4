"""Print the physical plans of the main operators (used to write docs/PLANS.md).

    python tools/show_plans.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from denseblocks import Options, local_session  # noqa: E402
from denseblocks.functions.density import make_measure  # noqa: E402
from denseblocks.operators import membership as mem  # noqa: E402
from denseblocks.operators.peel import PassState, histogram, mode_stats_df  # noqa: E402
from denseblocks.operators.profile import profile_df, value_masses  # noqa: E402
from denseblocks.plans import queries as Q  # noqa: E402
from denseblocks.plans.search import _update_values  # noqa: E402


def plan(df) -> str:
    import io
    from contextlib import redirect_stdout

    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    text = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", text)
    return text.strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    ctx = Q.context(spark, sf, "P")
    rel = Q.relation(spark, sf, "L")
    meas = make_measure("geo", 3, ctx.mass, ctx.cards)
    state = PassState(ctx.mass, ctx.cards, ctx.phantoms, 2.0)
    _, n, A_kept, logged, B1, removed = Q._first_pass(spark, sf)
    vals = logged.select("value")
    forced = Options(broadcast_rows=0, bitmap_bytes=0, hot_parts=64, salts=16)
    hot = mem.hot_values(ctx.all_values, n, ctx.tuples, vals, forced)
    sections = [
        ("Profile (S4, A1)", profile_df(rel)),
        ("Value masses (A3)", value_masses(rel.df, 3)),
        ("Pass statistics: histogram, running sums, best cut (A8, D5, D7, P1-P7)",
         mode_stats_df(histogram(ctx.all_values.select("mode", "mass"), ctx.phantoms), state, meas)),
        ("Tuples surviving a pass, broadcast path (P10)", B1),
        ("Tuples surviving a pass, salted shuffle path (forced: broadcast_rows=0)",
         mem.restrict(ctx.original, f"a{n}", vals, removed, keep=False, hot=hot, opts=forced)),
        ("Tuples surviving a pass, bitmaps (forced: broadcast_rows=0)",
         mem.restrict(ctx.original, f"a{n}", vals, removed, keep=False, opts=Options(broadcast_rows=0), card=ctx.ids[n])),
        ("Mass and tuples of three blocks in one scan (A6, J1)", Q.q_block_totals(spark, sf)),
        ("Alive value update (P12)", _update_values(A_kept, B1, 3, ctx.opts)),
        ("Block tuples (J1)", Q.q_block_tuples(spark, sf)),
        ("Deflation (J2)", Q.q_deflate(spark, sf)),
    ]
    print("# Physical plans\n")
    print(f"Generated by `tools/show_plans.py` on `{sf}` (local[8], AQE on, 8 shuffle partitions). Expression ids removed.\n")
    for title, df in sections:
        note = ""
        if "salted" in title:
            # A small set is still broadcast by Spark's own size check
            # (autoBroadcastJoinThreshold); show the plan a large set gets.
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            note = "Printed with `spark.sql.autoBroadcastJoinThreshold=-1`, i.e. the plan a set too large to broadcast gets.\n\n"
        print(f"## {title}\n\n{note}```\n{plan(df)}\n```\n")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


if __name__ == "__main__":
    main()
