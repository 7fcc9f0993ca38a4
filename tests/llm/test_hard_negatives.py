"""Hard negatives against scoring all pairs, and the bounds of the summaries."""

import math

import numpy as np
import pytest

from denseblocks.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, r long, slot long, rank int"


def brute(rows, every=100):
    v = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        v.append((i, label, [math.floor(256 * x) for x in e]))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (i, label, q) in enumerate(v):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), j, m, b) for b, (j, m, p) in enumerate(v) if b != a]
        order = lambda s: (-s[0], *last(s[1]))
        for s, j, _, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            far = sorted((x for x in scored if x[2] != label and 30 * s <= 100 * x[0] <= 90 * s), key=order)[:10]
            out += [(i, j, n + 1, x[1], s, x[0]) for n, x in enumerate(far)]
    return sorted(out, key=lambda r: tuple(last(x) for x in r))


def same(df, rows, **more):
    got = [tuple(r) for r in H.mine(df, **more).collect()]
    assert sorted(got, key=lambda r: tuple((x is None, x or 0) for x in r)) == brute(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def clustered(n, width, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 0.4
    x[: n // 10] = np.round(x[: n // 10])  # ties
    return [(int(i), [float(c) for c in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


def test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    same(df, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("width", [1, 5, 64])
def test_clusters_waves_and_blocks(spark, monkeypatch, width):
    """Waves of a few anchors and blocks of a few rows give the same lists."""
    monkeypatch.setattr(H, "BLOCK_BYTES", 1)
    rows = clustered(700, width, seed=width)
    rows += rows[100:101] * 8 + rows[300:340]  # repeated rows, a repeated anchor
    same(frame(spark, rows), rows, wave_bytes=5000)


def test_nulls_lengths_and_signs(spark):
    rows = clustered(300, 4)
    rows += [(None, [1.0, 1.0, 0.5, 0.2], 1), (None, None, 1), (400, None, 2), (500, [1.0, None, 1.0, 1.0], 1), (600, [float("nan")] * 4, 1)]
    rows += [(700, [float("inf"), 0.0, 0.0, 0.0], 1), (800, [], 1), (900, [2.0], 1), (1000, [1.0] * 9, 2), (1100, [0.0] * 4, None), (-100, [-1.0, 0.1, 0.0, 3.0], -3)]
    same(frame(spark, rows), rows)
    opposite = [(i, [(-1.0) ** i * (1 + i / 1000)], 0 if i == 0 else 1 + i % 2) for i in range(40)] + [(100, [1.0], 5), (101, [-1.0], 5)]
    same(frame(spark, opposite), opposite)  # negative and no positives


def test_empty_and_few(spark):
    assert H.mine(frame(spark, [(0, [1.0], 1)]).limit(0)).count() == 0
    assert H.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor
    assert H.mine(frame(spark, [(100, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no positive


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i), float(2**20 - 3 * i), 1.0], i % 3) for i in range(1, 60)] + [(100, [2.0**21, 2.0**20, 5.0], 1)]
    rows += [(200 + i, [2.0**20 * (0.4 + 0.01 * i), 2.0**19, 1.0], 2) for i in range(30)]
    same(frame(spark, rows), rows)
    with pytest.raises(Exception, match="OverflowError"):
        H.mine(frame(spark, [(100, [1e15], 1), (1, [1e15], 1)])).collect()


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(0)
    q = np.floor(rng.normal(size=(60, 48)).cumsum(1) * 40).astype(np.int64)
    sums, devs = H.summaries(q)
    exact, at, widths = q @ q.T, 0, []
    for n in H.LEVELS:
        mean = sums[:, at : at + n].astype(float) @ sums[:, at : at + n].T / (48 // n)
        dev = devs[:, at : at + n].astype(float) @ devs[:, at : at + n].T
        at += n
        assert (exact <= mean + dev + 1e-6).all() and (exact >= mean - dev - 1e-6).all()
        widths.append(dev.mean())
    assert widths == sorted(widths, reverse=True)
