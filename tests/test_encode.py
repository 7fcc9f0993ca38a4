"""Dictionary encoding: dense ids in key order, nulls counted, whole numbers only."""

import pytest

from denseblocks import find_blocks, from_columns
from denseblocks.plans.search import prepare
from denseblocks.sources import encode


def test_dense_ids_in_key_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_type")
    few = {r["key"]: r["id"] for r in encode.dictionary(df, "p_type", partitions=1).collect()}
    many = {r["key"]: r["id"] for r in encode.dictionary(df, "p_type", partitions=300).collect()}
    keys = sorted(few)
    assert few == many == {k: i for i, k in enumerate(keys)}
    enc, d = encode.encode_column(df, "p_type", "type_id")
    assert enc.filter("type_id IS NULL").count() == 0
    back = encode.decode(enc, "type_id", d, "key").groupBy("key").count().count()
    assert back == len(keys)


def test_null_keys_and_fractions_are_counted(spark):
    df = spark.createDataFrame([("x", 1.0, 8.0), (None, 1.0, 7.0), ("y", 1.5, 1.0), ("y", 2.0, 2.9)], "k string, d double, w double")
    enc, _ = encode.encode_column(df, "k")
    rel = from_columns(enc, ["k", "d"], "w")
    with pytest.raises(ValueError, match="3 tuples"):
        prepare(rel)
    ctx = prepare(rel, validate="drop")
    assert (ctx.tuples, ctx.mass) == (1, 8)


def test_empty_relation_has_no_blocks(spark):
    rel = from_columns(spark.createDataFrame([], "a long, b long, w long"), ["a", "b"], "w")
    res = find_blocks(rel, 2, "geo", "density", 2.0)
    assert res.blocks == [] and res.report().count() == 0 and res.members().count() == 0 and res.tuples().count() == 0


def test_huge_masses(spark):
    from denseblocks import Options

    rows = [(i % 5, i % 3, 1 << 50) for i in range(20)]
    rel = from_columns(spark.createDataFrame(rows, "a long, b long, w long"), ["a", "b"], "w")
    forced = find_blocks(rel, 1, "geo", "density", 2.0, opts=Options(broadcast_rows=0, bitmap_bytes=0, salts=4))
    plain = find_blocks(rel, 1, "geo", "density", 2.0)
    assert forced.report().drop("seconds").collect() == plain.report().drop("seconds").collect()
