import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from denseblocks.config import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="denseblocks-tests")
    yield s


F1 = [
    (0, 0, 0, 5), (0, 1, 0, 6), (1, 0, 0, 4), (1, 1, 0, 5), (0, 0, 1, 5), (1, 1, 1, 7),
    (2, 2, 2, 1), (3, 0, 2, 1), (4, 3, 3, 2), (2, 3, 3, 1), (5, 4, 0, 1), (4, 4, 3, 3),
]


def relation_of(spark, rows, n):
    from denseblocks import from_columns

    cols = [f"x{i}" for i in range(n)]
    schema = ", ".join(f"{c} long" for c in cols) + ", w long"
    return from_columns(spark.createDataFrame(rows, schema), cols, "w")


def blocks_summary(res):
    """Per block: members per mode (sorted lists), report row as dict."""
    n = res.ctx.n_dims
    mem = res.members().collect()
    rep = {r["block"]: r.asDict() for r in res.report().drop("seconds").collect()}
    out = []
    for b in sorted(rep):
        sets = [sorted(r["value"] for r in mem if r["block"] == b and r["mode"] == m) for m in range(n)]
        out.append((sets, rep[b]))
    return out
