"""Hard-negative mining with segment summaries.

Every vector is cut into segments, at LEVELS finenesses, and of each segment its sum (the
mean times its length) and its deviation (the norm of what is left without the mean) are
stored. The inner product of two segments is the product of their means times their length, plus
or minus at most the product of their deviations, so the summaries bound a score from both sides: pairs
whose bounds fall out of the wanted range are dropped at the coarsest level that shows it, the rest is
refined, and only what the finest level leaves open is scored exactly.

Anchors are a stated query set. They are taken in waves of bounded bytes, broadcast and held
against all rows in blocks; a wave first meets one row in PILOT, which gives a lower bound of
each list's last score, and then all rows, so that tasks hand on few rows that do not end up in a
list. No task holds more than its blocks and the lists of a wave.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, python_tasks

LEVELS = (1, 4, 16)  # segments of a vector, coarse to fine
WAVE_BYTES = 32 << 20  # of anchors, their summaries and lists
BLOCK_BYTES = 8 << 20  # of scores of one block of anchors and rows
ANCHOR_BLOCK = 256
PILOT = 16
SPARSE = 0.05  # share of pairs below which they are refined one by one
EXACT = 2**53  # products of norms below it have exact scores in doubles

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score lies between so many hundredths of its positive's


def quantised(embeddings: DataFrame) -> DataFrame:
    """(r, vec_id, label, q): rows that take part, numbered, with whole-number components."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & sound)
    q = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("r"), F.col("vec_id").cast("long"), label.alias("label"), q.alias("q"))


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """Vectors of any lengths as rows of ``width`` components; what is missing counts 0."""
    lengths = np.diff(q.offsets.to_numpy())
    flat = q.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and deviations of the segments of all levels, side by side; deviations are
    rounded up."""
    sums, devs = [], []
    for n in LEVELS:
        parts = q.reshape(len(q), n, -1).astype(np.float64)
        mean = parts.mean(2, keepdims=True)
        sums.append(q.reshape(len(q), n, -1).sum(2))
        devs.append(np.sqrt(((parts - mean) ** 2).sum(2)) * (1 + 1e-12))
    return np.concatenate(sums, 1), np.nextafter(np.concatenate(devs, 1).astype(np.float32), np.float32(np.inf))


def summarised(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with the summaries of their vectors (``sums``, ``devs``)."""
    python_tasks(rows.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                sums, devs = summaries(_matrix(b.column("q"), width))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in (sums, devs)]
                lists = [x.cast(pa.list_(x.type.value_type)) for x in lists]
                yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=["r", "vec_id", "label", "q", "sums", "devs"])

    return rows.mapInArrow(run, "r long, vec_id long, label long, q array<long>, sums array<long>, devs array<float>")


@dataclass
class Block:
    """Vectors with their summaries, as arrays."""

    r: np.ndarray
    label: np.ndarray
    q: np.ndarray
    sums: np.ndarray
    devs: np.ndarray
    ids: np.ndarray
    noid: np.ndarray  # rows without an id, which come last among equal scores

    @staticmethod
    def of(table: pa.RecordBatch, width: int) -> "Block":
        flat = lambda c, n: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        n = sum(LEVELS)
        ids = table.column("vec_id")
        return Block(
            table.column("r").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("q"), width).astype(np.float64),
            flat(table.column("sums"), n).astype(np.float64), flat(table.column("devs"), n).astype(np.float64),
            ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
        )

    def cut(self, a: int, b: int) -> "Block":
        return Block(*[getattr(self, f)[a:b] for f in ("r", "label", "q", "sums", "devs", "ids", "noid")])

    def largest(self) -> float:
        return float(np.sqrt((self.q**2).sum(1)).max()) if len(self.q) else 0.0


@dataclass
class Lists:
    """What is wanted of every anchor: J lists of the ``k`` first rows with a score from
    ``low`` to ``high`` (anchors x J); ``least`` is a score that k rows are known to reach."""

    k: int
    same: bool  # rows of the anchor's label, or of all others
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all pairs; OverflowError beyond 64 bits."""
    size = lambda m: np.sqrt((m**2).sum(1)).max(initial=0)
    if size(a) * size(b) < EXACT:
        return a @ b.T
    whole = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return whole.astype(np.int64)


def _open_pairs(a: Block, b: Block, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> np.ndarray:
    """Pairs (anchor, row) whose score the summaries leave between ``floor`` and ``ceiling``."""
    alive = (a.label[:, None] == b.label) == same
    alive &= a.r[:, None] != b.r
    slack = 1e-9 * a.largest() * b.largest() + 0.5
    at = 0
    for n in LEVELS:
        length = a.q.shape[1] // n
        part = slice(at, at + n)
        at += n
        share = np.count_nonzero(alive) / max(alive.size, 1)
        if share == 0:
            break
        if share < SPARSE:
            i, j = np.nonzero(alive)
            mean = np.einsum("ij,ij->i", a.sums[i, part], b.sums[j, part]) / length
            dev = np.einsum("ij,ij->i", a.devs[i, part], b.devs[j, part])
            out = (mean + dev + slack < floor[i]) | (mean - dev - slack > ceiling[i])
            alive[i[out], j[out]] = False
        else:
            mean = a.sums[:, part] @ b.sums[:, part].T / length
            dev = a.devs[:, part] @ b.devs[:, part].T
            alive &= (mean + dev >= (floor - slack)[:, None]) & (mean - dev <= (ceiling + slack)[:, None])
    return alive


def _block_hits(a: Block, b: Block, lists: Lists, first: int):
    """(slot, score, id, noid) of rows of ``b`` that may be in the lists of ``a``; the slot of
    list j of anchor i of the wave is i * J + j."""
    bound = np.maximum(lists.low, lists.least)
    floor, ceiling = bound.min(1), lists.high.max(1)
    alive = _open_pairs(a, b, floor, ceiling, lists.same)
    if np.count_nonzero(alive) < SPARSE * alive.size:
        i, j = np.nonzero(alive)
        if len(i) == 0:
            return None
        if a.largest() * b.largest() < EXACT:
            score = np.einsum("ij,ij->i", a.q[i], b.q[j])
        else:
            score = np.array([exact_scores(a.q[x : x + 1], b.q[y : y + 1])[0, 0] for x, y in zip(i, j)])
        fit = (score >= floor[i]) & (score <= ceiling[i])
        i, j, score = i[fit], j[fit], score[fit]
    else:
        scores = exact_scores(a.q, b.q)
        alive &= (scores >= floor[:, None]) & (scores <= ceiling[:, None])
        if np.count_nonzero(alive) > 8 * lists.k * alive.shape[0] and alive.shape[1] > lists.k:
            for s in range(bound.shape[1]):  # the k-th score of this block is reached by k rows
                inside = np.where(alive & (scores <= lists.high[:, s : s + 1]) & (scores >= bound[:, s : s + 1]), scores, -np.inf)
                kth = np.partition(inside, -lists.k, axis=1)[:, -lists.k]
                bound[:, s] = np.maximum(bound[:, s], kth)
            alive &= scores >= bound.min(1)[:, None]
        i, j = np.nonzero(alive)
        score = scores[i, j]
    found = []
    for s in range(bound.shape[1]):
        m = (score >= bound[i, s]) & (score <= lists.high[i, s])
        found.append(((i[m] + first) * bound.shape[1] + s, score[m].astype(np.int64), b.ids[j[m]], b.noid[j[m]]))
    return [np.concatenate(x) for x in zip(*found)]


def _first_of_each(hits: list[np.ndarray], k: int) -> list[np.ndarray]:
    slot, score, ids, noid = hits
    order = np.lexsort((ids, noid, -score, slot))
    hits = [x[order] for x in hits]
    start = np.flatnonzero(np.diff(hits[0], prepend=-1))
    place = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return [x[place < k] for x in hits]


def scan(rows: DataFrame, anchors: Block, lists: Lists, width: int) -> DataFrame:
    """(slot, score, vec_id, rank): the lists over all ``rows``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((anchors, lists))
    names = ("slot", "score", "vec_id")

    def run(batches):
        anchors, lists = sent.value
        least = lists.least.copy()
        state = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        step = max(64, BLOCK_BYTES // (8 * ANCHOR_BLOCK))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = Block.of(batch.slice(at, step), width)
                new = [state]
                for i in range(0, len(anchors.r), ANCHOR_BLOCK):
                    z = slice(i, i + ANCHOR_BLOCK)
                    found = _block_hits(anchors.cut(i, i + ANCHOR_BLOCK), b, Lists(lists.k, lists.same, lists.low[z], lists.high[z], least[z]), i)
                    if found is not None:
                        new.append(found)
                if len(new) == 1:
                    continue
                state = _first_of_each([np.concatenate(x) for x in zip(*new)], lists.k)
                ends = np.flatnonzero(np.diff(state[0], append=-1))
                full = np.diff(ends, prepend=-1) == lists.k
                least.ravel()[state[0][ends[full]]] = np.maximum(least.ravel()[state[0][ends[full]]], state[1][ends[full]])
        for at in range(0, len(state[0]), 50_000):
            slot, score, ids, noid = (x[at : at + 50_000] for x in state)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ids, mask=noid)], names=names)

    found = rows.mapInArrow(run, "slot long, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= lists.k)


def _kth(lists: Lists, found) -> np.ndarray:
    """``least`` of the lists that have k rows in ``found`` (slot, score)."""
    out = lists.least.copy()
    slot, score = (found.column(c).to_numpy() for c in ("slot", "score"))
    n = np.bincount(slot, minlength=out.size)
    low = np.full(out.size, np.inf)
    np.minimum.at(low, slot, score)
    full = n == lists.k
    out.ravel()[full] = np.maximum(out.ravel()[full], low[full])
    return out


def _search(rows: DataFrame, pilot: DataFrame, anchors: Block, lists: Lists, width: int, stage: Stage, name: str) -> DataFrame:
    """``scan`` of all rows, with bounds from the pilot rows."""
    first = scan(pilot, anchors, lists, width).select("slot", "score").toArrow()  # k rows a slot of the wave at most
    return stage.put(scan(rows, anchors, Lists(lists.k, lists.same, lists.low, lists.high, _kth(lists, first)), width), name)


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for
    ``embeddings`` (vec_id, embedding, label; other columns are ignored).

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Missing components of shorter vectors count 0, so an empty vector scores 0 with all.
    Rows without a vec_id are no anchors; they can be positives and negatives, last among equal scores.
    Repeated rows are rows of their own: each is an anchor, and a positive of the others.
    Ties go to the smaller vec_id. An empty table, or one without anchors, gives an empty result.
    Scores beyond 64 bits raise an OverflowError.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    plain = stage.put(quantised(embeddings), "quantised")
    longest = plain.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(1, -(-longest // LEVELS[-1])) * LEVELS[-1]
    rows = stage.put(summarised(plain, width), "rows")
    pilot = stage.put(rows.where(F.pmod(F.xxhash64("r"), F.lit(PILOT)) == 0).repartition(max(1, rows.rdd.getNumPartitions() // PILOT)), "pilot")
    queries = stage.put(rows.where(F.col("vec_id") % anchor_every == 0), "anchors")
    a_wave = max(1, wave_bytes // (8 * (width + 2 * sum(LEVELS) + 4 * (1 + positives))))
    waves = -(-queries.count() // a_wave)
    out = None
    for w in range(waves):
        wave = queries.where(F.pmod(F.xxhash64("r"), F.lit(waves)) == w).toArrow().combine_chunks().to_batches()
        if not wave:
            continue
        anchors = Block.of(wave[0], width)
        n = len(anchors.r)
        wide = lambda v, j: np.full((n, j), v, dtype=np.float64)
        near = Lists(positives, True, wide(-np.inf, 1), wide(np.inf, 1), wide(-np.inf, 1))
        found = _search(rows, pilot, anchors, near, width, stage, f"positives-{w}").toArrow()  # of one wave
        anchor, place = found.column("slot").to_numpy(), found.column("rank").to_numpy() - 1
        score = found.column("score").to_pylist()
        low, high = wide(np.inf, positives), wide(-np.inf, positives)
        low[anchor, place] = [-(-LOW * s // 100) for s in score]
        high[anchor, place] = [HIGH * s // 100 for s in score]
        far = Lists(negatives, False, low, high, wide(-np.inf, positives))
        hard = _search(rows, pilot, anchors, far, width, stage, f"negatives-{w}")
        ids = [None if x else int(v) for v, x in zip(anchors.ids[anchor], anchors.noid[anchor])]
        slots = list(zip((anchor * positives + place).tolist(), ids, found.column("vec_id").to_pylist(), score))
        slots = F.broadcast(spark.createDataFrame(slots, "slot long, anchor_id long, positive_id long, positive_score long"))  # of one wave
        part = hard.join(slots, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def sql() -> str:
    """The same in DuckDB's SQL, by scoring all pairs."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
near AS (SELECT a.r, a.vec_id AS anchor_id, a.label, a.q, p.vec_id AS positive_id, list_inner_product(a.q, p.q)::BIGINT AS positive_score
    FROM v a JOIN v p ON a.label = p.label AND a.r <> p.r WHERE a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.q, p.q) DESC, p.vec_id) <= {POSITIVES}),
slots AS (SELECT *, row_number() OVER () AS slot FROM near),
far AS (SELECT s.*, n.vec_id AS negative_id, list_inner_product(s.q, n.q)::BIGINT AS negative_score FROM slots s JOIN v n ON s.label <> n.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY slot ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM far WHERE {LOW} * positive_score <= 100 * negative_score AND 100 * negative_score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY slot ORDER BY negative_score DESC, negative_id) <= {NEGATIVES}
"""
