"""The pipeline, stage by stage and as a whole, against plain-Python versions."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from denseblocks.llm import mixing, ngram_join, quality, queries
from denseblocks.llm.common import hot_join

from .test_brute import components

SF = "/root/testdata/sf0.001"


def counts(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def has_item(text, items):
    w = text.lower().split()
    for v, b in items:
        for s in range(max(1, len(w) - len(v) + 1)):
            a = counts(w[s : s + len(v)])
            if 100 * sum((a & b).values()) >= 80 * sum((a | b).values()):
                return True
    return False


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage makes of the one before."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for i, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        step(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [s.columns for s in stages] == [docs.columns] * 4
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    first = texts(stages[0])
    assert {d for d, _ in first} == good and 0 < len(good) < docs.count()

    group = components(first)
    second = texts(stages[1])
    assert sorted(d for d, _ in second) == sorted(d for d, (n, c) in group.items() if d == c or n == 0)

    items = [(t.lower().split(), counts(t.lower().split())) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if t]
    third = texts(stages[2])
    assert sorted(d for d, _ in third) == sorted(d for d, t in second if not has_item(t or "", items))

    con = duckdb.connect()
    con.register("documents", stages[2].toPandas())
    taken = {d: (size, n) for d, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.sql()}) x").fetchall()}
    got = Counter(d for d, _ in texts(stages[3]))
    assert all(got[d] * size == n for d, (size, n) in taken.items()) and max(got.values()) <= 3


def test_whole_run(spark, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    rows = sorted(texts(stages[3]))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()))
    assert [r[1] for r in got] == [d for d, _ in rows]
    at = 0
    for (start, _, n, crc), (_, text) in zip(got, rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sources_at_their_cap_repeat_no_empty_document(spark):
    rows = [(i, "a b c d" if i < 10 else "", "small") for i in range(20)] + [(100 + i, "w " * 50, "large") for i in range(20)]
    out = Counter(r.doc_id for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert max(out.values()) <= 3


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr("denseblocks.llm.common.HOT", 3)
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 100), ("c", 101), (None, 102), (None, 103), ("z", 104)], "k string, v long")
    table = spark.createDataFrame([("a", 50, "A"), ("b", 1, "B"), ("c", 1, None)], "k string, w long, x string")
    got = sorted((r.v, r.k, r.x) for r in hot_join(rows, table, "k", "w").collect())
    assert got == [(i, "a", "A") for i in range(50)] + [(100, "b", "B"), (101, "c", None), (102, None, None), (103, None, None), (104, "z", None)]


def test_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, 1), (2, long + " more", 2), (None, long, 3), (2, long + " more", 4), (7, "", 5), (8, None, 6), (9, "own words here", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group long")
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.one_of_each_group(df).collect())
    assert kept == [(2, long + " more"), (7, ""), (8, ""), (9, "own words here")]
    assert ngram_join.one_of_each_group(df).columns == df.columns
