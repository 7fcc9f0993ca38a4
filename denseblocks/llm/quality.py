"""Quality scores learned from preference pairs (Bradley-Terry).

A document of label 1 is preferred to one of label 0. The probability of a preference
is the logistic function of the difference of two document scores, which are linear in
the features; the weights minimise the logistic loss on feature differences of pairs.
Documents above a quantile of the scores count as good; the published score is the
logistic function of the distance from that quantile, set so that 0.3 lies on it.

Features are shares of kinds of characters and words, each cut into bins at quantiles
of the sample, so that a score can bend. They need the text only. Texts are read whole.
Pairs and quantiles come from at most SAMPLE labelled documents, those with the
smallest hash of their id; the scores cover all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import python_tasks
from .spotsigs import _ANCHORS

SAMPLE = 20_000  # labelled documents that the model is fitted on, at most
PAIRS = 200_000  # preference pairs drawn from them, at most
BINS = 10
CUT_SCORE = 0.3  # the published score on the threshold
RIDGE = 1.0

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"#$%&*@^~", b"|<>{}[]=_\\/+", b".", b",", b"?:;\"'()-", b" ", b"\n"]
_KIND = np.zeros((256, len(_GROUPS)), np.float64)
for _i, _g in enumerate(_GROUPS):
    _KIND[list(_g), _i] = 1
FEATURES = 2 + len(_GROUPS) + 6


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES numbers for each text; zeros for one that is null or empty."""
    out = np.zeros((len(texts), FEATURES))
    row = 0
    for part in W._chunks(texts):
        h, n = W._runs(part)
        ends = np.cumsum(n)
        anchor = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)] == h
        same = np.append(False, h[1:] == h[:-1])
        for t, k, e in zip(part, n.tolist(), ends.tolist()):
            x, row = out[row], row + 1
            if not t:
                continue
            b = np.frombuffer(t, np.uint8)
            x[0], x[1] = np.log1p(len(b)), (b >= 128).mean()
            x[2 : 2 + len(_GROUPS)] = np.bincount(b, minlength=256) @ _KIND / len(b)
            if k:
                w = h[e - k : e]
                c = np.unique(w, return_counts=True)[1]
                x[-6:] = np.log1p(k), len(b) / k, len(c) / k, c.max() / k, anchor[e - k : e].mean(), same[e - k + 1 : e].sum() / k
    return out


@dataclass
class Model:
    edges: np.ndarray  # FEATURES x (BINS - 1) cuts
    weights: np.ndarray  # FEATURES * BINS
    cut: float  # the score quantile between the labels
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        return self.weights[at + np.arange(FEATURES) * BINS].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _one_hot(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), FEATURES * BINS))
    for i, (e, c) in enumerate(zip(edges, x.T)):
        out[np.arange(len(x)), i * BINS + np.searchsorted(e, c, side="right")] = 1
    return out


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Weights from preference pairs by Newton's method, then the threshold's quantile."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T if len(x) else np.zeros((FEATURES, BINS - 1))
    if len(good) == 0 or len(bad) == 0:  # nothing to prefer: every document passes
        return Model(edges, np.zeros(FEATURES * BINS), 0.0, 1.0)
    rng = np.random.Generator(np.random.PCG64(11))
    m = min(PAIRS, 20 * max(len(good), len(bad)))
    one = _one_hot(edges, x)
    a, b = good[rng.integers(0, len(good), m)], bad[rng.integers(0, len(bad), m)]
    w = np.zeros(one.shape[1])
    for _ in range(12):
        g, hess = -RIDGE * w, RIDGE * np.eye(len(w))
        for i in range(0, m, 20_000):
            d = one[a[i : i + 20_000]] - one[b[i : i + 20_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g += d.T @ (1 - p)
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = one @ w
    grid = np.quantile(s, np.arange(1, 400) / 400)
    right = np.array([(s[good] >= c).sum() + (s[bad] < c).sum() for c in grid])
    best = grid[right == right.max()]  # the quantiles that sort most documents right
    cut = (best[0] + best[-1]) / 2
    under = s[s < cut]
    cut = (cut + under.max()) / 2 if len(under) else cut  # between two documents
    return Model(edges, w, float(cut), float(max(s.std(), 1e-6)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, x): label and features of at most SAMPLE labelled documents
    (``labels``: doc_id, quality) whose crc32 of the id is not divisible by 5. Rows without
    a label, and labels other than 0 and 1, take no part; of rows with equal ids the one
    with the smallest hash of its text does, so that a hot id adds one row only."""
    python_tasks(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(fold).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches):
        for b in batches:
            x = features(b.column("text").cast(pa.binary()).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("o"), lists], names=["doc_id", "quality", "o", "x"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = found.select("doc_id", "quality", F.xxhash64("text").alias("o"), "text").mapInArrow(run, "doc_id long, quality int, o long, x array<double>")
    return rows.groupBy("doc_id", "quality").agg(F.min_by("x", "o").alias("x"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample of labelled documents."""
    rows = sample(docs, labels).select("quality", "x").toArrow()
    x = np.array(rows.column("x").combine_chunks().values if rows.num_rows else [], np.float64).reshape(-1, FEATURES)
    label = rows.column("quality").to_numpy()
    order = np.lexsort([*x.T, label])  # the same model whatever the order of the rows
    return fit(x[order], label[order])


def scorer(docs: DataFrame, model: Model):
    """Column with the score of the ``text`` of ``docs``. Null and empty texts have the
    score of all features zero."""
    python_tasks(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(features(text.cast(pa.binary()).to_pylist())))

    return scored(F.col("text").cast("string"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns kept, that the model does not reject."""
    return docs.where(scorer(docs, model) >= CUT_SCORE)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``. A null doc_id is
    held out of nothing (``held_out`` false). An empty table gives an empty result; without
    labels of both kinds every document passes."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = docs.select("doc_id", scorer(docs, train(docs, labels)).alias("score"))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
