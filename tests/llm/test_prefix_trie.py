"""The prefix trie against a plain-Python version, in one band and in many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from denseblocks.llm import prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth string, c string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                kids[tuple(t[: d - 1])].add(tuple(t[:d]))
    out = []

    def walk(root):
        order, totals = [root], {}
        for n in order:
            order += kids[n]
        for n in reversed(order):
            words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
            leaves, saved = int(not kids[n]), (len(members[n]) - 1) * words
            for x in kids[n]:
                leaves, saved = leaves + totals[x][0], saved + totals[x][1]
            totals[n] = leaves, saved
            ends = ",".join(str(c) for c in sorted(c for c in members[n] if len(built[c]) == len(n)))
            parent = min(members[n[:-1]]) if n else None
            out.append((min(members[n]), len(n), parent, len(members[n]), len(kids[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))

    if built:
        walk(())
    return out


def agree(df, rows):
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    key = lambda r: (r[1], r[0], r[7])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def made_up(seed, n=150, long=0):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["hi", "a b", None, "x\ty z"])) for c in range(n) for t in range(rng.randrange(7))]
    rows += [(3, None, "system", "first"), (None, 0, "user", "nobody's")]
    rows += [(c, t, "user", f"long {t % 5}") for c in (40, 41, 1001) for t in range(10, 10 + long)]
    return rows + [(200 + i, 0, "user", "the same") for i in range(40)] + [(200, 0, "user", "the same")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def test_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    agree(df, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("band,chunk,bucket,hot", [(2, 3, 4, 2), (3, 4096, 7, 4096), (32, 1, 4096, 4096)])
def test_bands_pieces_and_buckets(spark, monkeypatch, band, chunk, bucket, hot):
    """Small bands give several levels of band roots; small pieces stream the lists of ids."""
    for name, value in (("BAND", band), ("CHUNK", chunk), ("BUCKET", bucket), ("HOT", hot)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made_up(band, long=60)
    agree(frame(spark, rows), rows)


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)  # its one turn is replaced by none
    rows = [(lone, 0, "user", "gone")]
    agree(frame(spark, rows), rows)
    assert prefix_trie.trie(frame(spark, rows)).count() == 1
    assert prefix_trie.trie(frame(spark, rows).limit(0)).count() == 0
    assert prefix_trie.trie(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_very_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000 + str(c // 21)) for c in range(20, 24)]
    agree(frame(spark, rows), rows)
