"""Document fingerprints by spot signatures.

At every anchor (a very common word) a chain of the next three content words, anchors
skipped, makes a signature. A document's fingerprint is the set of its signatures, as
sorted 32-bit hashes in hexadecimal. Anchors stand in running prose, so menus and lists
add little, and a text that is embedded or cut keeps most of its signatures.

``likeness`` is the Jaccard similarity of two fingerprints. ``similar`` finds all pairs
of different fingerprints above a threshold, ``links`` counts them for each document: sets are partitioned by length, and only sets of a
partition and the next one are compared, from the inverted lists of their first
signatures. Equal fingerprints are one class; long lists are dealt out in cells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Stage, default_partitions, hot_join, python_tasks, small

CHAIN = 3
TASK_BYTES = 512 << 20  # of text that a task reads in order, more in a task only for rows of one id
CELL = 1024  # entries of an inverted list that one task compares with the probes of that list
# Very common words of English, German, French and Spanish.
ANCHORS = """
the of and to in is it that was for on are as with be this by at from have or an not which
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch
le la les de des du et un une en que qui dans pour pas sur au avec il est
el los las del y a se por con su para como más lo al es una
""".split()

_ANCHORS = np.unique(np.concatenate(W.word_hashes([w.encode() for w in ANCHORS])))


def signatures(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text. A text with words but without a
    whole chain has one signature, of all its words; one without words has none."""
    out = []
    for part in W._chunks(texts):
        h, n = W._runs(part)
        ends = np.cumsum(n)
        if len(h) == 0:
            out += [np.empty(0, np.uint32)] * len(part)
            continue
        anchor = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)] == h
        content, at = np.flatnonzero(~anchor), np.flatnonzero(anchor)
        k = np.searchsorted(content, at)
        at, k = at[k + CHAIN <= len(content)], k[k + CHAIN <= len(content)]
        doc = np.searchsorted(ends, at, side="right")
        inside = content[k + CHAIN - 1] < ends[doc] if len(k) else np.empty(0, bool)
        at, k, doc = at[inside], k[inside], doc[inside]
        x = h[at] * W._PLACE[0]
        for i in range(CHAIN):
            x = x + h[content[k + i]] * W._PLACE[i + 1]
        sig = (W.mix(x) >> np.uint64(32)).astype(np.uint32)
        cut = np.searchsorted(doc, np.arange(len(part) + 1))
        for i in range(len(part)):
            s = np.unique(sig[cut[i] : cut[i + 1]])
            if len(s) == 0 and n[i]:
                own = h[ends[i] - n[i] : ends[i]]
                s = np.array([int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=4).digest(), "big")], np.uint32)
            out.append(s)
    return out


def text_of(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; two empty sets are equal. 0 without a comparison where the
    sizes alone rule out ``least``."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    if min(len(a), len(b)) <= least * max(len(a), len(b)) and least:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_signatures long, near_edited double, near_next double"


def _with_next(batches):
    """Rows in order, the row after a bucket's last one marked as such: one output row
    for each of the others, from its text and the next one's."""
    held = None
    for b in batches:
        rows = ([held] if held else []) + list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("last").to_pylist()))
        if not rows:
            continue
        held = rows[-1]
        texts = [r[1] or "" for r in rows]
        sigs = signatures([t.encode() for t in texts])
        pick = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in pick]
        coded = [t.encode() for t in edited]
        other = signatures(coded)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in pick], pa.int64()), pa.array([len(texts[i]) for i in pick], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in coded], pa.string()), pa.array([text_of(sigs[i]) for i in pick], pa.string()),
             pa.array([text_of(s) for s in other], pa.string()), pa.array([len(sigs[i]) for i in pick], pa.int64()),
             pa.array([likeness(sigs[i], s) for i, s in zip(pick, other)], pa.float64()), pa.array([likeness(sigs[i], sigs[i + 1]) for i in pick], pa.float64())],
            names=[c.split()[0] for c in _OUT.split(", ")],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, n_signatures, near_edited,
    near_next``.

    The next document is the one with the next id, after the last the first; rows with
    equal ids stand in the order of their texts, null ids and texts first. A null text counts
    as empty. The edited text has its last floor(n / 2) characters replaced by the first
    as many of the next document's text. A single row is its own next one.

    Ranges of ids, one for each TASK_BYTES of text or more of them, are dealt to tasks, which
    stream their rows in order; the driver holds one id for each range.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(low).cast("long")))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    parts = max(default_partitions(spark), -(-size // TASK_BYTES))
    cuts = rows.select(F.col("k").cast("double")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = np.unique(np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in cuts], np.int64))

    @F.arrow_udf("int")
    def bucket(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, k.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("k"))
    # the first id of each bucket (at most ``parts``), and its text, for the bucket before
    heads = sorted((r.bucket, r.k) for r in rows.select("k", "bucket").groupBy("bucket").agg(F.min("k").alias("k")).collect())
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = spark.createDataFrame([(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)], "bucket int, k long")
    ends = rows.drop("bucket").join(F.broadcast(before), "k").groupBy("bucket", "k", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("bucket", "k", "doc_id", "text", F.lit(False).alias("last")).unionByName(ends.withColumn("last", F.lit(True)))
    dealt = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "last", "k", "text")
    return dealt.select("doc_id", "text", "last").mapInArrow(_with_next, _OUT)


def _sets(batches):
    for b in batches:
        sigs = signatures(b.column("text").cast(pa.binary()).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sigs]), pa.int32()), pa.array(np.concatenate([*sigs, np.empty(0, np.uint32)]).astype(np.int64)))
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sigs]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(digest, pa.binary()), lists], names=["uid", "doc_id", "digest", "sigs"])


def _alike(docs: DataFrame, least: float) -> tuple[Stage, DataFrame, DataFrame, DataFrame]:
    """The stage, (doc_id, digest) of each row, (cls, digest, class_id, n_copies, sigs) of each class
    of equal fingerprints, and (x, y, likeness) of the pairs of classes that are alike, each once."""
    python_tasks(docs.sparkSession)
    stage = Stage(docs.sparkSession, "spots")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stage.put(rows.mapInArrow(_sets, "uid long, doc_id long, digest binary, sigs array<long>"), "rows")
    sets = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("uid").alias("cls"), F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.first("sigs").alias("sigs"))
    sets = stage.put(sets, "sets")
    # by length: two sets that are alike are of one partition or of two next to each other
    part = F.floor(F.log("n") / F.log(F.lit(1 / least))).cast("int") if least < 1 else F.col("n")
    entry = sets.select(F.col("cls").alias("id"), F.size("sigs").alias("n"), F.posexplode("sigs").alias("pos", "sig")).withColumn("part", part)
    # rarest first: how often a signature occurs decides its place in every set
    often = stage.put(entry.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "often")
    entry = hot_join(entry, often, "sig", "m").where("m IS NOT NULL")
    placed = entry.groupBy("id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("m", "sig"))).alias("s"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1 - (F.col("n") - F.size("s"))
    index = placed.where(first > 0).select("id", "n", "part", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(1)).cast("int"))).alias("e"))
    index = stage.put(index.select("id", "n", "part", "e.sig"), "index")
    # a long list is dealt out in cells; each probe of it goes to all of them
    long = small(index.groupBy("sig", "part").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("cells > 1"))
    cells = F.coalesce("cells", F.lit(1))
    held = index.join(long, ["sig", "part"], "left").withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("int")).drop("cells")
    probe = index.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("id").alias("x"), F.col("n").alias("nx"))
    probe = probe.join(long, ["sig", "part"], "left").select("sig", "part", "x", "nx", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    once = (F.col("nx") < F.col("n")) | ((F.col("nx") == F.col("n")) & (F.col("x") < F.col("id")))
    pairs = probe.join(held, ["sig", "part", "cell"]).where(once & (F.col("nx") >= F.col("n") * least)).select("x", F.col("id").alias("y")).distinct()
    left, right = (sets.select(F.col("cls").alias(c), F.col("sigs").alias(f"s{c}")) for c in "xy")
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("sx", "sy"))
    both = both.select("x", "y", (common / (F.size("sx") + F.size("sy") - common)).alias("likeness"))
    return stage, rows, sets, stage.put(both.where(F.col("likeness") >= least), "pairs")


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: pairs of different fingerprints of ``docs`` (doc_id, text; other
    columns are ignored) with a likeness of at least ``least``; a and b are the smallest ids that have them,
    null (first) if only rows without an id do. Texts without words, null ones among them, have
    no pair; repeated rows count once; an empty table gives an empty result. ``links`` says which
    documents have which fingerprint."""
    _, _, sets, pairs = _alike(docs, least)
    names = [sets.select(F.col("cls").alias(c), F.col("class_id").alias(f"i{c}")) for c in "xy"]
    a, b = F.col("ix"), F.col("iy")
    swap = b.isNull() | (a > b)
    return pairs.join(names[0], "x").join(names[1], "y").select(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), "likeness")


def links(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_copies, n_links``: the smallest id with an
    equal fingerprint, the rows that have it, and the exact number of other rows whose likeness is at
    least ``least``. Texts without words are alone in their class, without links. Rows with a null id
    count like others; repeated rows come back repeated; an empty table gives an empty result."""
    stage, rows, sets, pairs = _alike(docs, least)
    copies = sets.select("cls", "n_copies")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("of"), F.col("y").alias("cls")), F.struct(F.col("y").alias("of"), F.col("x").alias("cls")))).alias("e")).select("e.*")
    counts = ends.join(copies, "cls").groupBy("of").agg(F.sum("n_copies").alias("links"))
    label = sets.join(counts, F.col("cls") == F.col("of"), "left")
    label = label.select("digest", "class_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = hot_join(rows.select("doc_id", "digest"), stage.put(label, "label"), "digest", "n_copies")
    own = F.col("digest").isNull()
    none = F.lit(0).cast("long")
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, none + 1).otherwise(F.col("n_copies")).alias("n_copies"), F.when(own, none).otherwise(F.col("n_links")).alias("n_links"))
