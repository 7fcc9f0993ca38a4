"""Token ids in binary shards with a minimal perfect hash index.

``write`` encodes every text, cuts the documents in ascending id order into shards of
about SHARD_IDS ids and writes one row of binary columns per shard (a Parquet table:
Spark's commit makes a rewritten shard replace a lost one):

* ``payload``: the ids of its documents one after the other, little-endian, as
  unsigned 16-bit integers if the vocabulary allows it, else 32-bit (``width`` bytes);
* ``keys``: the document ids in that order, signed 64-bit; ``nulls`` of them, the
  first ones, stand for null;
* ``first``, ``last``: smallest and largest document id (null if it has null ids only);
* ``levels``, ``bits``, ``ranks``: a minimal perfect hash of the keys. A level is a bit array;
  a key belongs to the first level where its bit is set, and the number of bits set before
  it, stored for each block of bits, is its slot. Bits are set where exactly one of the
  keys left falls;
* ``slots``: per slot a 32-bit fingerprint of the key, offset and length of its ids, and the
  row of its key.

A key is found with a few array accesses, whatever the number of documents, and one that is
not there is rejected by the fingerprint. ``read_by_key`` takes a DataFrame of ids: the
ranges of the shards say where each may be, and only those shards are read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, python_tasks, small
from .words import mix

SHARD_IDS = 1 << 20
GAMMA = 2.0  # bits of a level for each key left
BLOCK = 512  # bits of which the number set before is stored
GROUP = 1024  # shards of which the key map has one row on the driver
SLOT = np.dtype([("mark", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("row", "<u4")])
_STEP = 0x9E3779B97F4A7C15


# The index.

def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * _STEP & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


def build_index(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (as bool) of a minimal perfect hash of distinct 64-bit keys."""
    levels, left = [], keys
    while len(left):
        bits = max(64, int(GAMMA * len(left)))
        at = _at(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def pack(levels: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """The stored form of an index: bits of each level; all of them in blocks of BLOCK bits,
    each level filled up to whole blocks; the number of bits set before each block."""
    words = [np.packbits(np.pad(x, (0, -len(x) % BLOCK)), bitorder="little").view("<u8") for x in levels]
    words = np.concatenate([*words, np.empty(0, "<u8")])
    ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
    ranks = np.concatenate([[0], np.cumsum(ones)[:-1]])[: len(ones)]
    return np.array([len(x) for x in levels], "<u8").tobytes(), words.tobytes(), ranks.astype("<u8").tobytes()


def slots_of(keys: np.ndarray, packed: tuple[bytes, bytes, bytes]) -> np.ndarray:
    """Slot of each key; -1 where no level has its bit. A key reads a word of each level
    until its bit is set, then the count of its block and the words of that block."""
    sizes = np.frombuffer(packed[0], "<u8").astype(np.int64)
    words, ranks = np.frombuffer(packed[1], "<u8"), np.frombuffer(packed[2], "<u8")
    out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, bits in enumerate(sizes.tolist()):
        at = start + _at(keys[left], i, bits)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        hit = ((words[word] >> bit) & np.uint64(1)).astype(bool)
        word, bit, block = word[hit], bit[hit], at[hit] // BLOCK
        rank = ranks[block] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        for j in range(BLOCK // 64 - 1):  # whole words of the block before the key's own
            before = block * (BLOCK // 64) + j
            rank += np.where(before < word, np.bitwise_count(words[before]), 0).astype(np.uint64)
        out[left[hit]] = rank.astype(np.int64)
        left, start = left[~hit], start + bits + -bits % BLOCK
    return out


def _mark(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def _nth(ids: np.ndarray, again: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Distinct 64-bit keys of rows: their id and, for repeated ids, the number of the
    repetition (0 for the first)."""
    salt = again.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)
    x = ids.astype(np.int64).view(np.uint64)
    return np.where(salt == 0, x, mix(mix(salt) + x))


def _hash_keys(ids: np.ndarray, nulls: int) -> np.ndarray:
    """The keys of the rows of a shard, in which repeated ids stand together."""
    new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
    if nulls < len(ids):
        new[nulls] = True
    first = np.flatnonzero(new)
    again = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return _nth(ids, again, np.arange(len(ids)) < nulls)


def _probe(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, entry of the slot table) of each key."""
    slots = slots_of(keys, (shard["levels"], shard["bits"], shard["ranks"]))
    table = np.frombuffer(shard["slots"], SLOT)
    row = table[np.maximum(slots, 0)] if len(table) else np.zeros(len(keys), SLOT)
    return (slots >= 0) & (row["mark"] == _mark(keys)), row


def lookup(shard: dict, ids: np.ndarray, nulls: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, offset, length) in a shard's payload for document ids, repeated ids together."""
    found, row = _probe(shard, _hash_keys(ids, nulls))
    return found, row["offset"].astype(np.int64), row["length"].astype(np.int64)


# Encoding.

_ENCODERS: dict = {}


# A word of Latin letters and the signs after it. NFC leaves it as it is, and a
# tokenizer that lower-cases and splits letters from other signs reads it as one
# word and at most one run of signs.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
# Fixed value: the pattern of the vocabulary file for which that holds.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK = 16 << 20  # bytes of text encoded at once (a longer one alone)
_REMEMBER = 1_000_000  # words, and as many pieces, remembered by a worker before it starts anew


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Pieces:
    """Packed ids of the pieces of text between blanks. No token of the
    vocabulary crosses white space, so a text's ids are those of its pieces in turn. Pieces
    met before are remembered as an Arrow array, in which those of a batch are looked up at once."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        form = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex", x["type"]) for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT, "ByteLevel"] and form["model"]["dropout"] is None
        self.model, self.words, self.letters = self.tokenizer.model, {}, dict(enumerate(_byte_letters()))
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def pack(self, ids: list[int]) -> bytes:
        x = array(self.code, ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def word(self, w: str) -> bytes:
        """Ids of one lower-case word or run of signs, straight from the merges."""
        x = self.words.get(w)
        if x is None:
            if len(self.words) > _REMEMBER:
                self.words.clear()
            coded = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            x = self.words[w] = self.pack([t.id for t in self.model.tokenize(coded)])
        return x

    def piece(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece) if self.plain else None
        if m:
            return self.word(m[1].lower()) + (self.word(m[2]) if m[2] else b"")
        return self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def places(self, pieces: pa.Array) -> pa.Array:
        """Where in ``ids`` those of each of the distinct pieces stand."""
        if len(self.known) > _REMEMBER:
            self.known, self.ids = self.known[:0], self.ids[:0]
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        if len(new):
            start = len(self.known)
            self.known = pa.concat_arrays([self.known, new])
            self.ids = pa.concat_arrays([self.ids, pa.array(map(self.piece, new.to_pylist()), pa.binary())])
            at = pc.replace_with_mask(at, pc.is_null(at), pa.array(np.arange(start, start + len(new), dtype=np.int32)))
        return at


def _coded(texts: pa.Array, pieces: _Pieces, stop: bytes) -> pa.Array:
    """Packed ids of each text and the end id. The pieces are numbered by Arrow, only the
    distinct ones are looked up, and their ids put in a row by one ``take``."""
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    numbered = split.flatten().dictionary_encode()
    places, ends = pieces.places(numbered.dictionary).take(numbered.indices), split.offsets.to_numpy()[1:]
    at = np.insert(places.to_numpy(), ends, len(pieces.ids))
    row = pa.concat_arrays([pieces.ids, pa.array([stop], pa.binary())]).take(pa.array(at))
    _, offsets, data = row.buffers()
    cuts = np.frombuffer(offsets, np.int32)[np.append(0, ends + np.arange(1, len(texts) + 1))]
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.tobytes()), data])


def _encode(path: str, width: int, end: int):
    def run(batches):
        pieces = _ENCODERS.get((path, width))
        if pieces is None:
            pieces = _ENCODERS[path, width] = _Pieces(path, width)
        stop = np.array([end], f"<u{width}").tobytes()
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.searchsorted(size, np.arange(CHUNK, size[-1] if len(size) else 0, CHUNK)) + 1
            cuts = np.unique(np.concatenate([[0], cuts, [b.num_rows]])).tolist()
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                out = _coded(part.column("text"), pieces, stop)
                n = pc.divide(pc.cast(pc.binary_length(out), pa.int64()), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), n, out], names=["doc_id", "tie", "n", "ids"])

    return run


_SHARD = "shard int, n_docs long, n_ids long, width int, nulls long, first long, last long, keys binary, levels binary, bits binary, ranks binary, slots binary, payload binary"


def _shards(width: int):
    def run(batches):
        shard, ids, sizes, parts = None, [], [], []
        for b in batches:
            shard = b.column("shard")[0].as_py() if b.num_rows else shard
            ids += b.column("doc_id").to_pylist()
            sizes += b.column("n").to_pylist()
            parts += b.column("ids").to_pylist()
        if not ids:
            return
        nulls = sum(x is None for x in ids)
        keys = np.array([0 if x is None else x for x in ids], np.int64)
        hashed = _hash_keys(keys, nulls)
        packed = pack(build_index(hashed))
        table = np.zeros(len(keys), SLOT)
        table[slots_of(hashed, packed)] = np.rec.fromarrays([_mark(hashed), np.cumsum([0] + sizes[:-1]), sizes, np.arange(len(keys))], dtype=SLOT)
        ends = [int(keys[nulls]), int(keys[-1])] if nulls < len(keys) else [None, None]
        row = [shard, len(keys), sum(sizes), width, nulls, *ends, keys.tobytes(), *packed, table.tobytes(), b"".join(parts)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int, vocabulary: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into shards at ``path``.

    ``tokenizer``: path of the vocabulary file, the same on every executor. A null text is
    encoded as an empty one, of which only the end id is written. Null ids come first; rows
    with equal ids are all written, in the order of a hash of their text. An empty
    table makes no shard.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    stage = Stage(spark, "tokens")
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    coded = stage.put(rows.mapInArrow(_encode(tokenizer, width, end), "doc_id long, tie long, n long, ids binary"), "encoded")
    total = coded.agg(F.sum("n")).first()[0] or 0
    ordered = coded.repartitionByRange(max(1, -(-total // shard_ids)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_shards(width), _SHARD).write.mode("overwrite").parquet(path)
    stage.drop("encoded")


def _documents(batches):
    for b in batches:
        for shard in b.to_pylist():
            width, ids = shard["width"], np.frombuffer(shard["keys"], np.int64)
            found, offset, length = lookup(shard, ids, shard["nulls"])
            assert found.all(), "a key is missing from the index"
            payload = shard["payload"]
            crc = [zlib.crc32(np.frombuffer(payload, f"<u{width}", n, o * width).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=np.arange(len(ids)) < shard["nulls"]), pa.array(offset + shard["base"]), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, path: str) -> DataFrame:
    """From the shards: ``doc_id, start`` (ids before it), ``n_tokens, ids_crc32``, every
    document found through the index."""
    python_tasks(spark)
    shards = spark.read.schema(_SHARD).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    columns = "shard int, width int, nulls long, keys binary, levels binary, bits binary, ranks binary, slots binary, payload binary, base long"
    rows = shards.join(F.broadcast(base), "shard").select([c.split()[0] for c in columns.split(", ")])
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _shards_of(ids: DataFrame, spans: DataFrame) -> DataFrame:
    """(shard, key): the shards whose range may hold each of the distinct ids. Those at an end
    of a range are found by equality, as an id of many rows may be the end of many ranges;
    those inside of one by the last range that starts before: in its group of shards
    (GROUP of them, by a search in their first ids), and there by a running maximum."""
    spans = spans.where("first IS NOT NULL")
    ends = spans.select("shard", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    roots = spans.withColumn("g", F.floor(F.col("shard") / GROUP)).groupBy("g").agg(F.min("first").alias("first")).orderBy("g").collect()
    firsts, numbers = np.array([r["first"] for r in roots], np.int64), np.array([r["g"] for r in roots] or [0], np.int64)

    @F.arrow_udf("long")
    def group(k: pa.Array) -> pa.Array:
        return pa.array(numbers[np.maximum(np.searchsorted(firsts, k.to_numpy(zero_copy_only=False)) - 1, 0)])

    starts = spans.select(F.floor(F.col("shard") / GROUP).alias("g"), F.col("first").alias("key"), F.struct("shard", "last").alias("span"))
    asked = ids.select(group("key").alias("g"), "key", F.lit(None).cast("struct<shard:int,last:bigint>").alias("span"))
    # a group's first range may start after the end of the one before it, which then holds no key of it
    order = Window.partitionBy("g").orderBy("key", F.col("span").isNotNull(), "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = starts.unionByName(asked).withColumn("at", F.last("span", ignorenulls=True).over(order)).where("span IS NULL AND key < at.last")
    return inside.select("at.shard", "key").unionByName(ends.join(ids, "key").select("shard", "key")).distinct()


def _by_key(batches):
    """Rows of a shard: itself (key null), then the keys asked for. Holds one shard."""
    shard = None
    for b in batches:
        asked = b.column("key")
        null = asked.is_null().to_numpy(zero_copy_only=False)
        for i, j in zip(cuts := np.unique(np.concatenate([[0], np.flatnonzero(null), np.flatnonzero(null) + 1, [len(null)]])), cuts[1:]):
            if null[i]:
                shard = b.slice(i, 1).to_pylist()[0]
                continue
            ids = asked.slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
            own, again = np.frombuffer(shard["keys"], np.int64), 0
            while len(ids):  # the first row of each id, the second one of those that have it, ...
                found, row = _probe(shard, _nth(ids, np.full(len(ids), again), np.zeros(len(ids), bool)))
                found[found] = (own[row["row"][found]] == ids[found]) & (row["row"][found] >= shard["nulls"])
                ids, row, again = ids[found], row[found], again + 1
                for k in range(0, len(ids), 256):
                    some, w = row[k : k + 256], shard["width"]
                    parts = [np.frombuffer(shard["payload"], f"<u{w}", n, o * w).astype(np.int64) for o, n in zip(some["offset"].tolist(), some["length"].tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32()), pa.array(np.concatenate(parts)))
                    start = pa.array(some["offset"].astype(np.int64) + shard["base"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 256]), start, lists], names=["doc_id", "start", "ids"])


def read_by_key(spark, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (array of long) of every document whose id is in the column
    ``doc_id`` of ``keys`` (other columns are ignored). Ids asked for several times count once, null
    ones and those that are not there give no row; a document's rows with equal ids all
    come. Only shards whose range holds an id are read whole."""
    python_tasks(spark)
    shards = spark.read.schema(_SHARD).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    ids = keys.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").distinct()
    asked = Stage(spark, "keys").put(_shards_of(ids, shards.select("shard", "first", "last")), "asked")
    held = shards.join(small(base), "shard").join(small(asked.select("shard").distinct()), "shard", "left_semi")
    columns = ["shard", "key", "base", "width", "nulls", "keys", "levels", "bits", "ranks", "slots", "payload"]
    held = held.withColumn("key", F.lit(None).cast("long")).select(columns)
    asked = asked.select(*[c if c in ("shard", "key") else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in columns])
    dealt = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("key"))
    return dealt.mapInArrow(_by_key, "doc_id long, start long, ids array<long>")
