"""N-gram Jaccard join of whole documents by set relations.

Two documents link when the Jaccard similarity of their sets of distinct 5-word
shingles is at least ``num / den`` (0.8). The join is exact up to collisions of
64-bit shingle hashes. It uses relations between sets twice, after the idea of
set-relation skipping:

* *Answers from a similar set.* Equal sets are one class with one answer. Then
  every class is compared with one of the classes that share one of its minimum
  hashes (its leader), and later, on the index, with the set of a list that has the
  fewest shingles of its own: a verified link puts it into the leader's component,
  and no pair inside a component has to be looked at again. A group of m near
  copies costs about m comparisons, not m * m.
* *Skipping in the index.* A set whose smallest shingles by hash are mostly in no
  other set can have no link and leaves. The others keep their shingles in one
  global order: those of no other set first, those that many share last. Two
  linked sets share a shingle among their first ``n - ceil(t n) + 1``. The index
  lists hold (set size, position) and are cut into blocks by set size: a probe
  reads its own and the next block only, and skips entries whose position leaves
  too few shingles for the threshold, and every entry of its own component.

The components are closed under links, so that all links of a set are found among the
sets of its component: ``ngram_links`` counts them exactly, from what each set differs in
from one of the component (its pivot, the one with the most links found). Two sets that differ
in x and y shingles from the pivot differ in ``|x xor y|`` from each other, so the pivot's
answers are only corrected by short lists. Their lengths bound that number: sets
in bands by length are linked or apart band by band, without a look at them. Bands that are
left open are dealt out in cells of bounded size; a task gets two cells and counts what
their lists share by a matrix product.

Shuffled rows: one per document for the classes, the pre-aggregated counts of the
smallest shingles (a first look) and of all shingles of the sets that remain, and
index entries of shared shingles. The bitmaps sent to the workers have a fixed size
(8, 8 and 1 MB). A full bitmap only costs time: any global order is valid, a set bit
only lets a set or an entry through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_BYTES, Stage, hot_join, keyed_rows, python_tasks, small
from .components import components

NUM, DEN = 4, 5
LEADERS = 6  # minimum hashes by which a class looks for leaders
COMMON = 16  # a shingle counted more often goes to the back of the order
COMMON_BITS = 23  # bitmap of common shingles: 2 ** 23 bits, 1 MB
SHARED_BITS = 26  # bitmaps of shingles seen more than once: 8 MB
CELL = 512  # sets of a component that a task compares with as many others
CELL_SHINGLES = 1 << 20  # shingles of these sets
COLUMNS = 4096  # shingles that one matrix product takes
BANDS = 256  # by the number of shingles in which a set differs from its pivot
# Sets are linked if they differ in at most NEAR / FAR of the sum of their sizes.
NEAR, FAR = DEN - NUM, DEN + NUM

_SEED = [np.uint64(0x2545F4914F6CDD1D * (2 * i + 1) & (1 << 64) - 1) for i in range(LEADERS)]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray], to=_long) -> pa.Array:
    """A list column from one array per row."""
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), to(flat))


def _prefix(n: int) -> int:
    """Shingles of which a linked set must share one: n - ceil(n * NUM / DEN) + 1."""
    return n - -(-n * NUM // DEN) + 1


def _texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _least(n: int) -> int:
    """Shingles that a linked set has in common with the other one at least."""
    return -(-n * NUM // DEN)


def _profile(batches):
    from hashlib import blake2b

    for b in batches:
        sets = W.shingle_sets(_texts(b))
        keys = [np.array([W.mix(s ^ k).min() for k in _SEED], np.uint64) if len(s) else s for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), b.column("text"), pa.array(map(len, sets), pa.int64()),
             pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists(keys),
             pa.array([s[: 2 * _prefix(len(s))].tobytes() for s in sets], pa.binary())],
            names=["uid", "doc_id", "text", "n", "digest", "keys", "low"],
        )


def _added(parts: list[np.ndarray]) -> pa.RecordBatch:
    t, c = np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]), return_counts=True)
    return pa.RecordBatch.from_arrays([_long(t), pa.array(c, pa.int64())], names=["token", "c"])


def _low_counts(batches):
    """(shingle, count) of the smallest shingles of each set, added up within a batch."""
    for b in batches:
        yield _added([np.frombuffer(x, np.uint64) for x in b.column("low").to_pylist()])


def _counts(batches):
    """(shingle, count) of all shingles of each set, added up within a batch."""
    for b in batches:
        yield _added(W.shingle_sets(_texts(b)))


def _bits(tokens: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the low bits of the tokens: at most 2 ** (bits - 6) rows reach the driver."""
    at = F.expr(f"token & {(1 << bits) - 1}L")
    rows = (
        tokens.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((token & {(1 << bits) - 1}L) & 63L as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bit"))
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy()
    return out.view(np.uint64)


def _has(bitmap: np.ndarray, bits: int, t: np.ndarray) -> np.ndarray:
    at = t & np.uint64((1 << bits) - 1)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _related(shared):
    """Sets that may have a link: enough of their smallest shingles are among the
    smallest of other sets.

    Let sets of n and m shingles have o >= 4/9 (n + m) in common, and let k(m) = 2 floor(m/5) + 2
    of the smaller hashes be looked at. If the other set's look ends first, it has at
    least k(m) - (m - o) common shingles, all of them in this set's look too; as
    4/5 m <= n <= 5/4 m, that is at least floor(n/5) more than -2. Else all common
    shingles of this set's look are in the other's, at least k(n) - (n - o) >= floor(n/5) + 2.
    """

    def run(batches):
        for b in batches:
            keep = []
            for u, n, x in zip(b.column("uid").to_pylist(), b.column("n").to_pylist(), b.column("low").to_pylist()):
                s = np.frombuffer(x, np.uint64)
                if n and _has(shared.value, SHARED_BITS, s).sum() + n - len(s) >= _least(n) - 2:
                    keep.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["uid"])

    return run


def _index(shared, common):
    """Index entries of each set: of its first shingles in the global order, those
    that some other set has too."""

    def run(batches):
        for b in batches:
            uid, toks, poss, ns, owns = [], [], [], [], []
            for u, s in zip(b.column("uid").to_pylist(), W.shingle_sets(_texts(b))):
                some, many = _has(shared.value, SHARED_BITS, s), _has(common.value, COMMON_BITS, s)
                own, n = len(s) - int(some.sum()), len(s)
                first = np.concatenate([s[some & ~many], s[some & many]])[: max(0, _prefix(n) - own)]
                if len(first):
                    uid.append(u)
                    ns.append(n)
                    owns.append(own)
                    toks.append(first)
                    poss.append(np.arange(own, own + len(first)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(ns, pa.int64()), pa.array(owns, pa.int64()), _lists(toks), _lists(poss, lambda x: pa.array(x.astype(np.int32), pa.int32()))],
                names=["uid", "n", "own", "tokens", "poss"],
            )

    return run


def _verify(batches):
    for b in batches:
        keep, last, s = [], None, None
        for i, (x, ta, r) in enumerate(zip(b.column("a").to_pylist(), _texts(b, "ta"), W.shingle_sets(_texts(b, "tb")))):
            if x != last:
                last, s = x, W.shingle_sets([ta])[0]
            both = len(np.intersect1d(s, r, assume_unique=True))
            if DEN * both >= NUM * (len(s) + len(r) - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])


def _links(pairs: DataFrame, prof: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that reach the threshold."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    texts = prof.select("uid", "text").join(small(need), "uid", "left_semi")
    both = (
        pairs.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )
    return both.mapInArrow(_verify, "a long, b long")


def _differ(batches):
    """Of each set the shingles that only it or only the set of its component's pivot has."""
    for b in batches:
        comps = b.column("comp").to_numpy()
        at, row = np.unique(comps, return_index=True)
        pivots = dict(zip(at.tolist(), W.shingle_sets(_texts(b.select(["pivot"]).take(pa.array(row)), "pivot"))))
        diffs = [np.setxor1d(x, pivots[c], assume_unique=True) for x, c in zip(W.shingle_sets(_texts(b)), comps.tolist())]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("cls", "comp", "n", "n_copies")], pa.array(map(len, diffs), pa.int64()), pa.array([x.tobytes() for x in diffs], pa.binary())],
            names=["cls", "comp", "n", "n_copies", "d", "diff"],
        )


def _partners(key, group):
    """(cls, links): for each set of two cells the rows of the other one (of its own one,
    if both are the same) whose sets are linked to it."""
    _, low, high = (k.as_py() for k in key)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("diff").to_pylist()]
    n, d, copies, home = (group.column(c).to_numpy() for c in ("n", "d", "n_copies", "home"))
    token, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, many = np.repeat(np.arange(len(sets)), d), count[at] > 1
    at = (np.cumsum(count > 1) - 1)[at[many]]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[many][order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, [start, start + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[who[i:j], at[i:j] - start] = 1
        both += (x @ x.T).astype(np.int64)
    linked = FAR * (d[:, None] + d[None, :] - 2 * both) <= NEAR * (n[:, None] + n[None, :])
    linked &= home[:, None] != home[None, :] if low != high else ~np.eye(len(sets), dtype=bool)
    return pa.table({"cls": group.column("cls"), "links": pa.array((linked * copies[None, :]).sum(1), pa.int64())})


def _differences(prof: DataFrame, label: DataFrame, linked: DataFrame, stage: Stage) -> DataFrame:
    """(cls, comp, n, n_copies, d, diff): the classes of components of several, with
    what each differs in from the pivot, the class with the most links found so far."""
    sizes = label.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1")
    degree = linked.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    best = degree.join(label.select("cls", "comp"), "cls").groupBy("comp").agg(F.max(F.struct("links", "cls"))["cls"].alias("uid"))
    pivots = stage.put(sizes.join(best, "comp"), "pivots")
    members = stage.put(label.join(small(pivots.select("comp")), "comp").select(F.col("cls").alias("uid"), "comp", "n", "n_copies"), "members")
    texts = prof.select("uid", "text")
    pivots = stage.put(texts.join(small(pivots), "uid").select("comp", "m", F.col("text").alias("pivot")), "pivot-texts")
    rows = texts.join(small(members), "uid").withColumnRenamed("uid", "cls")
    size = pivots.agg(F.sum(F.octet_length("pivot") + 16)).first()[0] or 0
    rows = rows.join(F.broadcast(pivots), "comp") if size <= BROADCAST_BYTES else hot_join(rows, pivots, "comp", "m")
    rows = rows.select("cls", "comp", "n", "n_copies", "text", "pivot")
    return stage.put(rows.mapInArrow(_differ, "cls long, comp long, n long, n_copies long, d long, diff binary"), "differences")


def _link_counts(prof: DataFrame, label: DataFrame, linked: DataFrame, stage: Stage) -> DataFrame:
    """(cls, links): for each class that has links to others, the rows of those."""
    diffs = _differences(prof, label, linked, stage)
    sizes = diffs.groupBy("comp").agg(F.count("*").alias("m"), F.sum("d").alias("all"), F.max("d").alias("most"))
    large = (F.col("m") > CELL) | (F.col("all") > CELL_SHINGLES)
    block = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)))).otherwise(F.lit(0)).cast("long")
    band = F.when(large, F.floor(F.col("d") * BANDS / (F.col("most") + 1))).otherwise(F.lit(0)).cast("long")
    narrow = diffs.select("cls", "comp", "n", "n_copies", "d").join(small(sizes), "comp")
    narrow = stage.put(narrow.select("cls", "comp", "n", "n_copies", "d", block.alias("block"), band.alias("band")), "bands")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("n", "d") for f in (F.min, F.max)]
    cells = F.ceil(F.greatest(F.count("*") / CELL, F.sum("d") / CELL_SHINGLES)).cast("long").alias("cells")
    cells = stage.put(narrow.groupBy("comp", "block", "band").agg(cells, F.sum("n_copies").alias("rows"), *ends), "cells")
    # sets of one size block, or of two next to each other, may be linked; the sizes of the
    # differences decide most of them: two sets differ by their sum at most and by what one exceeds the other at least
    other = cells.select("comp", *[F.col(c).alias(f"o_{c}") for c in cells.columns if c != "comp"])
    meets = cells.join(other, "comp").where("abs(block - o_block) <= 1")
    sure = FAR * (F.col("max_d") + F.col("o_max_d")) <= NEAR * (F.col("min_n") + F.col("o_min_n"))
    never = F.greatest(F.col("min_d") - F.col("o_max_d"), F.col("o_min_d") - F.col("max_d")) * FAR > NEAR * (F.col("max_n") + F.col("o_max_n"))
    verdict = F.when(never, 0).when(sure, 1).otherwise(2)
    meets = stage.put(meets.withColumn("verdict", verdict).where("verdict > 0"), "meets")
    whole = meets.where("verdict = 1").groupBy("comp", "block", "band").agg(
        F.sum("o_rows").alias("rows"), F.max((F.col("block") == F.col("o_block")) & (F.col("band") == F.col("o_band"))).alias("own"))
    known = narrow.join(small(whole), ["comp", "block", "band"]).select("cls", (F.col("rows") - F.when(F.col("own"), F.col("n_copies")).otherwise(0)).alias("links"))
    code = lambda block, band: F.shiftleft(block, 40) + F.shiftleft(band, 30)
    home = (code("block", "band") + F.pmod(F.xxhash64("cls"), F.col("cells"))).alias("home")
    away = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_cells") - 1), lambda i: code("o_block", "o_band") + i)).alias("away")
    open_ = meets.where("verdict = 2").select("comp", "block", "band", "cells", "o_block", "o_band", "o_cells")
    dealt = narrow.join(small(open_), ["comp", "block", "band"]).select("cls", home, away)
    dealt = dealt.select("cls", "home", F.least("home", "away").alias("low"), F.greatest("home", "away").alias("high"))
    found = diffs.join(small(dealt), "cls").groupBy("comp", "low", "high").applyInArrow(_partners, "cls long, links long")
    return known.unionByName(found).groupBy("cls").agg(F.sum("links").alias("links"))


def ngram_links(docs: DataFrame) -> DataFrame:
    """The rows of ``ngram_components`` with one more column, ``n_links``: the exact
    number of other rows whose sets reach the threshold with this one's, those with an
    equal set among them. Rows without shingles have none."""
    stage, prof, label = _classes(docs)
    found = [stage.spark.read.schema("a long, b long").parquet(stage.path(x)) for x in ("star-links", "best-links", "links")]
    counts = stage.put(_link_counts(prof, label, found[0].unionByName(found[1]).unionByName(found[2]), stage), "link-counts")
    links = label.select(F.col("cls").alias("of"), "digest").join(counts, F.col("of") == F.col("cls")).select("digest", "links")
    label = label.join(links, "digest", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("links", F.lit(0)))
    return _rows(prof, label, F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    ``doc_id, n_shingles, component_id, n_copies, text_hash, group``.

    component_id is the smallest doc_id reachable by links, the document's own
    included; n_copies counts the rows with an equal set; text_hash is the xxhash64 of the
    text; group numbers the components (null without shingles), also where ids are null. Null, empty and blank
    texts have no shingle, no link and their own doc_id as component. Rows with a
    null doc_id link like others; a component of such rows only has a null id.
    Repeated rows come back repeated. An empty table gives an empty result.
    """
    _, prof, label = _classes(docs)
    return _rows(prof, label)


def _rows(prof: DataFrame, label: DataFrame, *more) -> DataFrame:
    label = label.select("digest", "component_id", "n_copies", F.col("comp").alias("group"), *[c for c in label.columns if c == "n_links"])
    rows = prof.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"), F.xxhash64("text").alias("text_hash"))
    return hot_join(rows, label, "digest", "n_copies").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_copies")).otherwise(F.lit(1).cast("long")).alias("n_copies"),
        "text_hash", "group", *more,
    )


def _classes(docs: DataFrame) -> tuple[Stage, DataFrame, DataFrame]:
    """The stage, the profile of each row, and (cls, digest, n, n_copies, comp,
    component_id) of each class of equal sets."""
    spark = docs.sparkSession
    python_tasks(spark)
    stage = Stage(spark, "ngram")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prof = stage.put(rows.mapInArrow(_profile, "uid long, doc_id long, text string, n long, digest binary, keys array<long>, low binary"), "profile")

    classes = stage.put(
        prof.where("n > 0").groupBy("digest").agg(
            F.min("uid").alias("cls"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("n_copies")
        ),
        "classes",
    )
    # 1. answers from leaders
    keyed = classes.select("cls", F.posexplode("keys").alias("i", "key"))
    lead = keyed.groupBy("i", "key").agg(F.min(F.struct(F.xxhash64("cls", "i"), "cls"))["cls"].alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    star = stage.put(keyed.join(lead, ["i", "key"]).where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "star")
    linked = stage.put(_links(star, prof), "star-links")
    first = stage.put(components(linked, "a", "b", stage, "near"), "near")

    # 2. the index of what is left
    sent = spark.sparkContext.broadcast
    low = prof.select("low").mapInArrow(_low_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 1")
    seen = sent(_bits(low.select("token"), SHARED_BITS))
    comp = F.coalesce("component", "cls").alias("comp")
    owner = classes.join(first, classes.cls == first.vertex, "left").select(F.col("cls").alias("uid"), comp)
    maybe = prof.select("uid", "n", "low").mapInArrow(_related(seen), "uid long")
    owner = stage.put(owner.join(maybe, "uid"), "related")
    texts = prof.select("uid", "text").join(small(owner.select("uid")), "uid", "left_semi")
    counts = stage.put(texts.select("text").mapInArrow(_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 1"), "counts")
    shared, common = sent(_bits(counts, SHARED_BITS)), sent(_bits(counts.where(F.col("c") > COMMON), COMMON_BITS))
    entries = texts.mapInArrow(_index(shared, common), "uid long, n long, own long, tokens array<long>, poss array<int>")
    entries = stage.put(
        entries.join(owner, "uid").withColumnRenamed("uid", "cls")
        .select("cls", "comp", "n", "own", F.explode(F.arrays_zip("tokens", "poss")).alias("e"))
        .select("cls", "comp", "n", "own", F.col("e.tokens").alias("token"), F.col("e.poss").alias("pos"),
                F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int").alias("block")),
        "index",
    )
    # lists with sets of more than one component: first each set with the one that has
    # the fewest shingles of its own, then the pairs of what is still apart
    few = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "cls", "comp", "n")).alias("f")
    best = entries.groupBy("token").agg(few, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    best = entries.join(best, "token").where(f"comp <> f.comp AND {DEN} * least(n, f.n) >= {NUM} * greatest(n, f.n)")
    best = stage.put(best.select(F.col("f.cls").alias("a"), F.col("cls").alias("b")).distinct(), "best")
    linked = stage.put(linked.unionByName(_links(best, prof)), "best-links")
    near = components(linked, "a", "b", stage, "nearer")
    entries = entries.drop("comp").join(near, entries.cls == near.vertex, "left").select("cls", comp, "n", "token", "pos", "block")
    entries = stage.put(entries, "index-2")
    mixed = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    index = entries.join(mixed, "token", "left_semi")
    probe = index.select("token", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"),
                         F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    entry = index.select("token", "block", F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    pairs = (
        probe.join(entry, ["token", "block"])
        .where("ca <> cb AND (na < nb OR (na = nb AND a < b))")
        .where(f"{DEN} * na >= {NUM} * nb")
        .where(f"{NUM + DEN} * (1 + least(na - 1 - pa, nb - 1 - pb)) >= {NUM} * (na + nb)")
        .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .where(f"{NUM + DEN} * (c + least(na - 1 - pa, nb - 1 - pb)) >= {NUM} * (na + nb)")
        .select("a", "b")
    )
    pairs = stage.put(pairs, "pairs")
    more = stage.put(_links(pairs, prof), "links")

    last = components(linked.unionByName(more), "a", "b", stage, "all")
    for name in ("star", "related", "counts", "index", "best", "index-2", "pairs"):
        stage.drop(name)
    label = classes.join(last, classes.cls == last.vertex, "left").select("cls", "digest", "n", "n_copies", "first_id", comp)
    names = stage.put(label.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")), "names")
    return stage, prof, stage.put(hot_join(label, names, "comp", "classes").drop("first_id", "classes"), "label")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns kept) without all but one of each group of linked documents:
    the one with the smallest id stays (null ids last; of equal ids the smallest hash of the
    text), of repeated rows one. Rows without words belong to no group and stay. An empty
    table gives an empty result."""
    stage = Stage(docs.sparkSession, "groups")
    rows = ngram_components(docs).where("group IS NOT NULL").select("group", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    rows = stage.put(rows.groupBy("group", "_d", "_t").agg(F.count("*").alias("n")), "rows")
    first = stage.put(rows.groupBy("group").agg(F.min(F.struct(F.col("_d").isNull(), "_d", "_t")).alias("f"), F.count("*").alias("k")), "first")
    marked = hot_join(rows, first, "group", "k").withColumn("stays", F.col("_d").eqNullSafe(F.col("f._d")) & (F.col("_t") == F.col("f._t")))
    gone = stage.put(marked.where("NOT stays").select("_d", "_t"), "gone")
    again = stage.put(marked.where("stays AND n > 1").select("_d", "_t"), "again")
    keyed = keyed_rows(docs)
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))
    rest = keyed.join(small(gone), same, "left_anti")
    once = rest.join(small(again), same, "left_semi").dropDuplicates(["_id", "_h"])
    return rest.join(small(again), same, "left_anti").unionByName(once).select("row.*")
