"""Headline benchmark: dense-block searches on the test tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Every query runs end to end (read parquet, encode,
profile, search, evaluate on the original, collect the report); nothing is
shared between queries. A warm-up search on sf0.001 runs first and is
reported separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from denseblocks import Options, find_blocks  # noqa: E402
from denseblocks.config import local_session  # noqa: E402
from denseblocks.operators.profile import profile_df, value_masses  # noqa: E402
from denseblocks.sources.tables import events_relation, lineitem_relation, planted_relation  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# name -> (relation builder, measure, policy, theta, k[, early exit])
SEARCHES = {
    "planted_geo_density": (planted_relation, "geo", "density", 2.0, 1),
    "planted_geo_cardinality": (planted_relation, "geo", "cardinality", 2.0, 1),
    "planted_susp_density_k2": (planted_relation, "susp", "density", 2.0, 2),
    "planted_ari_density_theta1": (planted_relation, "ari", "density", 1.0, 1),
    "planted_ari_density_theta1_early_exit": (planted_relation, "ari", "density", 1.0, 1, True),
    "lineitem_geo_density": (lineitem_relation, "geo", "density", 2.0, 1),
    "events_susp_density": (events_relation, "susp", "density", 2.0, 1),
}


def run_search(spark, sf_dir, spec):
    builder, measure, policy, theta, k = spec[:5]
    opts = Options(early_exit=bool(spec[5:] and spec[5]))
    res = find_blocks(builder(spark, sf_dir), k=k, measure=measure, policy=policy, theta=theta, opts=opts)
    rows = res.report().collect()
    passes = sum(b.found.passes for b in res.blocks)
    jobs_passes = sum(len(b.found.log) for b in res.blocks)
    return rows, passes, jobs_passes


def main() -> None:
    parts = max(4, int(CPUS))
    spark = local_session(CPUS, shuffle_partitions=parts, app="denseblocks-bench")
    t = time.time()
    run_search(spark, SF_DIR.replace("sf0.1", "sf0.001") if "sf0.1" in SF_DIR else SF_DIR, SEARCHES["planted_geo_density"])
    warmup = time.time() - t

    times, detail = {}, {}
    t = time.time()
    rel = lineitem_relation(spark, SF_DIR)
    profile_df(rel).collect()
    value_masses(rel.df, 3).count()
    times["profile_value_masses_lineitem"] = round(time.time() - t, 3)
    for name, spec in SEARCHES.items():
        t = time.time()
        rows, passes, run_passes = run_search(spark, SF_DIR, spec)
        sec = time.time() - t
        times[name] = round(sec, 3)
        detail[name] = {
            "passes": passes,
            "passes_run": run_passes,
            "sec_per_pass": round(sec / max(run_passes, 1), 3),
            "volume": [[r[f"card_{i}"] for i in range(3)] for r in rows],
            "density": [r["density"] for r in rows],
        }
    total = round(sum(times.values()), 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_seconds_dense_block_searches",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": CPUS,
        "warmup_sec": round(warmup, 3),
        "detail": detail,
    }))


if __name__ == "__main__":
    main()
