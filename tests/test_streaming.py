"""Search re-run on arriving relation files."""

import os
import tempfile

from denseblocks.streaming import arrivals

from .conftest import F1


def test_arrivals_run_the_search(spark):
    d = tempfile.mkdtemp(prefix="denseblocks-stream-")
    inp = os.path.join(d, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "part1.txt"), "w") as f:
        f.write("\n".join(",".join(map(str, t)) for t in F1[:6]) + "\nbad,line\n")
    with open(os.path.join(inp, "part2.txt"), "w") as f:
        f.write("\n".join(",".join(map(str, t)) for t in F1[6:]) + "\n")
    q = arrivals.start(spark, inp, os.path.join(d, "table"), os.path.join(d, "out"), os.path.join(d, "ckpt"), 3,
                       k=1, measure="geo", policy="density", theta=1.0)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(os.path.join(d, "table")).count() == 12
    assert spark.read.parquet(os.path.join(d, "table", "_rejected")).count() == 1
    epochs = sorted(x for x in os.listdir(os.path.join(d, "out")) if x.startswith("epoch="))
    last = os.path.join(d, "out", epochs[-1], "attributes")
    attrs = spark.read.csv(last, schema="mode int, value long, block int").collect()
    assert sorted((r["mode"], r["value"]) for r in attrs) == [(m, v) for m in range(3) for v in (0, 1)]
