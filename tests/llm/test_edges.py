"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from denseblocks.llm import decontaminate, html_main, line_spread, mixing, ngram_join, pii, quality, queries, sharding, spotsigs, token_index
from denseblocks.llm.common import Stage

CLASH = "uid h n key group bucket th shard last k pos digest token comp cls times edge ties copy _id _h _d _t _s _0 at sub linked".split()
LONG = "\n".join(" ".join(f"word{i * j % 997}" for i in range(50)) for j in range(1, 800))
ROWS = [
    (None, None, None, None, None), (None, "a b c d e f", None, "src1", 3), (1, "", "en", "src1", 0), (2, " \t\n ", "en", None, None), (3, LONG, "en", "src2", len(LONG)),
    (4, LONG, "en", "src0", len(LONG)), (4, LONG, "en", "src0", len(LONG)), (5, "one", "de", "src0", 3), (6, None, None, "src0", None),
    (7, "The same line\nthe the The same line", "en", "src3", 1), (8, "ünï çødé 日本語 \U0001f600 mail a.b@c.de +1 (212) 555-1234", "fr", "src4", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, ""), (3, "one"), (4, "a B c d e F"), (4, "a B c d e F")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 1, 1), (5, 0, 0), (7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


def tokens(df):
    path = Stage(df.sparkSession, "test").path("shards")
    token_index.write(df, path, queries.vocabulary(), queries.END_ID, queries.VOCABULARY, shard_ids=1000)
    return token_index.read_documents(df.sparkSession, path)


OPS = {
    "ngram": ngram_join.ngram_components,
    "mix": mixing.mix,
    "shard": sharding.shard,
    "spots": spotsigs.fingerprints,
    "tokens": tokens,
    "lines": line_spread.remove_spread_lines,
    "pii": pii.find,
    "decontaminate": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(3, "one"), (4, "a B c d e F")], "item_id long, text string")),
    "quality": lambda d: quality.classify(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPS)
def test_rows_come_back(docs, name):
    rows = OPS[name](docs).collect()
    ids = lambda xs: sorted((x is None, x) for x in xs)
    assert ids(r["doc_id"] for r in rows) == ids(r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert OPS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_defined_results(docs, bench, spark):
    n = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(docs).collect()}
    assert n[4, max(s for _, s in n)] == 3 and n[1, 0] == 1 and n[2, 0] == 2 and n[6, 0] == 6 and n[5, 1] == 5
    d = {(r.doc_id, r.n_items): list(r.item_ids) for r in decontaminate.contamination(docs, bench).collect()}
    assert d[5, 1] == [3] and d[None, 1] == [4] and d[3, 0] == []
    t = {r.doc_id: r for r in tokens(docs).collect() if r.doc_id is not None}
    assert t[1].n_tokens == 1 and t[6].n_tokens == 1 and t[3].ids_crc32 == t[4].ids_crc32
    s = {r.doc_id: r for r in sharding.shard(docs).collect() if r.doc_id is not None}
    assert s[6].size == 16 and s[6].text_crc32 == 0 and s[4].linked == 3
    p = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (p[8].n_email, p[8].n_phone) == (1, 1) and p[1].spans == ""
    x = {r.doc_id: r for r in line_spread.remove_spread_lines(docs, sites=2).collect()}
    assert x[3].n_removed == 0 and x[6].text is None and x[7].n_removed == 0  # 3 and 4 are one text
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, empty).collect())


def test_pages(spark):
    schema = "page_id long, url string, html string, th long, host string"
    rows = [(None, None, None, 1, "x"), (1, "no url", "", 1, "x"), (2, "http://H.example/a", "<p>a<br>b &lt; c</p><nav>m</nav>", 1, "x"), (3, "http://h.example/b", "<div>" * 3000 + "deep", 1, "x")]
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4 and got[None].text == "" and got[2].text == "a b < c" and got[3].text == "deep" and got[2].n_chars == 7
    assert html_main.extract(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    sf = str(tmp_path)
    for name, df in {"labels": labels(spark), "benchmark": spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")}.items():
        df.write.parquet(f"{sf}/{name}.parquet")
    for _, step in corpus_pipeline.STAGES[1:-1]:
        assert step(spark, docs, sf).columns == docs.columns
        assert step(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.good_quality(spark, docs, sf).columns == docs.columns
    once = corpus_pipeline.one_of_each_group(spark, docs, sf)
    assert once.where("doc_id IN (3, 4)").count() == 1 and once.count() == len(ROWS) - 2
    clean = corpus_pipeline.without_benchmarks(spark, docs, sf)
    assert clean.count() == len(ROWS) - 1
