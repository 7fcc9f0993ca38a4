"""Keyed access over all shards against the whole table."""

import random

import numpy as np
from pyspark.sql import functions as F

from denseblocks.llm import queries, token_index


def test_index_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        packed = token_index.pack(token_index.build_index(keys))
        assert sorted(token_index.slots_of(keys, packed).tolist()) == list(range(len(keys)))


def test_read_by_key(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_index, "GROUP", 3)  # many groups of shards
    tok, rng = Tokenizer.from_file(queries.vocabulary()), random.Random(4)
    texts = {i: " ".join(rng.choice(["red", "Blue", "x1", "naïve"]) for _ in range(rng.randint(0, 30))) for i in range(-600, 2400, 3)}
    docs = list(texts.items()) + [(300, f"hot {i}") for i in range(400)] + [(None, "none")] * 3 + [(303, None), (-1, ""), (2**63 - 1, "last"), (-(2**63), "first")]
    path = queries.Stage(spark, "t").path("s")
    token_index.write(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), path, queries.vocabulary(), 2, 49408, shard_ids=600)
    shards = spark.read.parquet(path).where("first <= 300 AND last >= 300").count()
    assert shards > 2 and spark.read.parquet(path).count() > 10  # id 300 lies in several shards
    asked = [*rng.sample(sorted(texts), 300), 300, 300, 303, -1, 1, 2, 5000, 2**63 - 1, -(2**63), None, 0]
    ids = lambda t: tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])
    want = sorted((d, ids(t)) for d, t in docs if d is not None and d in set(asked))
    keys = spark.createDataFrame([(x, "clash") for x in asked], "doc_id long, shard string")
    got = token_index.read_by_key(spark, path, keys).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want
    starts = {(r.doc_id, r.start) for r in token_index.read_documents(spark, path).collect()}
    assert {(r.doc_id, r.start) for r in got} <= starts and len({r.start for r in got}) == len(got)
    assert token_index.read_by_key(spark, path, keys.limit(0)).count() == 0
    empty = queries.Stage(spark, "t").path("e")
    token_index.write(spark.createDataFrame([], "doc_id long, text string"), empty, queries.vocabulary(), 2, 49408)
    assert token_index.read_by_key(spark, empty, keys.where(F.col("doc_id") > 0)).count() == 0
