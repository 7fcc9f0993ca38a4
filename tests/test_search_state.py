"""Merged coordinates, never-seen ids as intervals, kept histogram, journal, published outputs, counters."""

import random

import pytest
from pyspark.sql import functions as F

from denseblocks import Options, find_blocks, from_columns, prepare
from denseblocks.config import stored
from denseblocks.operators.profile import unpivot_dims
from denseblocks.operators.ranges import expand, unseen_ranges
from denseblocks.plans import job, search
from denseblocks.plans.journal import Journal
from denseblocks.sources import encode, sinks, text
from denseblocks.sources.tables import sparse_relation

from . import bruteforce
from .conftest import F1, blocks_summary, relation_of

SF = "/root/testdata/sf0.001"


# -- merged coordinates ------------------------------------------------------


def test_merged_coordinates(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(3), 1 + rng.randrange(3)) for _ in range(300)]
    rel = relation_of(spark, rows, 2)
    ctx = prepare(rel)
    assert ctx.merged and ctx.n_rows == len({r[:2] for r in rows}) and ctx.tuples == 300
    assert not prepare(rel, Options(merge="never")).merged
    merged, plain = (find_blocks(rel, 2, "geo", "density", 1.0, opts=Options(merge=m)) for m in ("always", "never"))
    assert blocks_summary(merged) == blocks_summary(plain)
    bag = lambda res: sorted(map(tuple, res.tuples().collect()))
    assert bag(merged) == bag(plain)
    expected = bruteforce.find_blocks(rows, 2, 2, "geo", "density", 1.0)
    assert [r["tuples"] for r in merged.report().orderBy("block").collect()] == [e["tuples"] for e in expected]


# -- never-seen ids ------------------------------------------------------------


@pytest.mark.parametrize("ids,card", [([], 5), ([0], 1), ([4], 5), ([0, 1, 5, 9], 10**12 + 1), (list(range(0, 400, 3)), 401)])
def test_unseen_ranges(spark, ids, card):
    got = sorted(map(tuple, unseen_ranges(spark.createDataFrame([(i,) for i in ids], "value long"), card, 7).collect()))
    marks, expected = [-1, *ids, card], []
    for a, b in zip(marks, marks[1:]):
        if b - a > 1:
            expected.append((a + 1, b - 1))
    assert got == expected
    if card < 1000:
        rows = expand(spark.createDataFrame([(0, a, b) for a, b in got], "mode int, `from` long, to long"), ["mode"])
        assert sorted(r["value"] for r in rows.collect()) == [i for i in range(card) if i not in ids]


def test_blocks_with_unseen_ids(spark):
    """The relation is used up by the first blocks, so the last holds all ids up to 10^12."""
    res = find_blocks(sparse_relation(spark, SF), 6, "geo", "density", 2.0)
    report = {r["block"]: r for r in res.report().collect()}
    lengths = res.member_ranges().groupBy("block", "mode").agg(F.sum(F.col("to") - F.col("from") + 1).alias("n")).collect()
    assert {(r["block"], r["mode"]): r["n"] for r in lengths} == {(b, m): report[b][f"card_{m}"] for b in report for m in range(3) if report[b][f"card_{m}"]}
    assert report[6]["card_0"] == 10**12 + 1 and res.ctx.distinct[0] == 3


# -- passes and histogram --------------------------------------------------------


def test_kept_histogram_reads_less(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.randrange(300), rng.randrange(300), 1 + rng.randrange(9)) for _ in range(2000)] + [(i % 5, i % 7, i % 3, 200) for i in range(50)]
    rel = relation_of(spark, rows, 3)
    usual = find_blocks(rel, 1, "geo", "density", 1.2)
    moved = find_blocks(rel, 1, "geo", "density", 1.2, opts=Options(update="delta", histogram="delta"))
    assert blocks_summary(usual) == blocks_summary(moved)
    a, b = ([r["stat_rows"] for r in res.passes().orderBy("pass").collect()] for res in (usual, moved))
    assert len(a) == len(b) > 3 and sum(b[1:]) < sum(a[1:])
    log = usual.passes().orderBy("pass").collect()
    assert all(r["seconds"] > 0 and r["tuple_rows"] >= 0 for r in log) and any(r["bytes"] > 0 for r in log)


# -- journal -------------------------------------------------------------------------


class Stop(Exception):
    pass


@pytest.mark.parametrize("opts", [Options(), Options(histogram="delta", update="delta"), Options(broadcast_rows=2, bitmap_bytes=0, hot_parts=8, layout="bucketed")], ids=["plain", "moved", "bucketed"])
def test_stopped_search_goes_on(spark, tmp_path, opts):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(40), 1 + rng.randrange(3)) for _ in range(300)] + [(i % 3, i % 4, 40) for i in range(24)]
    run = lambda **more: find_blocks(relation_of(spark, rows, 2), 2, "geo", "density", 1.1, opts=opts, **more)
    whole = run()
    folder, seen = str(tmp_path / "journal"), []

    def stop_at(*at):
        def after(block, done):
            seen.append((block, done))
            if (block, done) in at:
                raise Stop

        return after

    for at in ((1, 2), (1, 3), (2, 1)):
        with pytest.raises(Stop):
            run(journal=folder, after_pass=stop_at(at))
    res = run(journal=folder, after_pass=stop_at())
    assert blocks_summary(res) == blocks_summary(whole)
    assert seen == sorted(set(seen)), "a finished pass was run again"
    again = run(journal=folder, after_pass=stop_at((1, 1), (2, 1)))  # all done: nothing is run
    assert blocks_summary(again) == blocks_summary(whole)
    assert again.passes().drop("seconds", "bytes").collect() == whole.passes().drop("seconds", "bytes").collect()
    with pytest.raises(ValueError, match="another search"):
        find_blocks(relation_of(spark, rows, 2), 2, "ari", "density", 1.1, opts=opts, journal=folder)


def test_half_written_manifest_does_not_count(spark, tmp_path):
    book = Journal(spark, str(tmp_path / "j"))
    assert book.load() is None
    for i in range(4):
        book.save({"i": i})
    (tmp_path / "j" / "_draft-000000009").write_text('{"i": ')
    assert Journal(spark, str(tmp_path / "j")).load() == {"i": 3}
    assert len(list((tmp_path / "j").glob("manifest-*.json"))) == 2


# -- published outputs -----------------------------------------------------------------


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, out)
    rel = relation_of(spark, F1, 3)
    sinks.publish_blocks(find_blocks(rel, 1, "geo", "density", 1.0), out)
    first = sinks.published(spark, out)
    count = lambda: spark.read.csv(f"{sinks.published(spark, out)}/tuples", schema="a0 long, a1 long, a2 long, v long, block int").count()
    before = count()

    def broken(result):
        raise Stop

    second = find_blocks(rel, 2, "geo", "density", 1.0)
    with monkeypatch.context() as m:
        m.setattr(sinks, "decoded_tuples", broken)  # between the attributes and the tuples
        with pytest.raises(Stop):
            sinks.publish_blocks(second, out)
    assert sinks.published(spark, out) == first and count() == before
    sinks.publish_blocks(second, out)
    assert sinks.published(spark, out) != first and count() > before
    report = spark.read.option("header", True).csv(f"{sinks.published(spark, out)}/report").count()
    ranges = spark.read.parquet(f"{sinks.published(spark, out)}/ranges").where("block = 1")
    assert report == 2 and ranges.count() == 6
    sinks.publish_blocks(second, out)
    assert not (tmp_path / "out" / first.rsplit("/", 1)[1]).exists()  # the one before stays, older ones go


# -- counters -----------------------------------------------------------------------------


def lines(tmp_path, rows):
    path = tmp_path / "in.txt"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_counters_come_with_the_lines(spark, tmp_path, monkeypatch):
    src = lines(tmp_path, ["1,2,3", "1,2,5,9", "4,5", "6,x,7", "1,-1,2", "1,2,0", "7,0,2"])
    rel, rejected = text.read_relation_text(spark, src, 2)
    assert rel.counts == {"lines": 7, "short": 1, "bad_token": 1, "invalid": 2} and rejected.count() == 4
    p = rel.profile
    assert (p.tuples, p.mass, p.cards, p.invalid, p.coordinates) == (3, 10, (8, 3), 0, 2)
    with pytest.raises(ValueError, match="malformed line"):
        text.read_relation_text(spark, src, 2, mode="failfast")
    assert "Scan text" not in rel.df._jdf.queryExecution().executedPlan().toString()  # later jobs read the stored table

    def never(*a, **k):
        raise AssertionError("profiled again")

    monkeypatch.setattr(search, "profile", never)
    assert prepare(rel).mass == 10


def test_empty_text(spark, tmp_path):
    rel, _ = text.read_relation_text(spark, lines(tmp_path, [""]), 2)
    assert rel.counts["short"] == 1 and rel.profile.tuples == 0
    assert find_blocks(rel, 1).blocks == []


def test_job_options(spark, tmp_path, capsys):
    src, out = lines(tmp_path, [",".join(map(str, t)) for t in F1] + ["short"]), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    options = ["--malformed", "drop", "--shuffle-partitions", "3", "--journal", str(tmp_path / "j"), "--publish", "--histogram", "delta", "--merge", "always"]
    assert job.main([src, out, "3", "geo", "density", "2.0", "2", *options]) == 0
    assert "short 1" in capsys.readouterr().out and spark.conf.get("spark.sql.shuffle.partitions") == before
    report = spark.read.option("header", True).csv(f"{sinks.published(spark, out)}/report").orderBy("block").collect()
    assert [int(r["mass"]) for r in report] == [32, 5]


# -- dictionaries and decimals ---------------------------------------------------------------


def test_large_dictionary_with_hot_keys_and_nulls(spark, monkeypatch):
    keys = ["hot"] * 300 + [None] * 100 + [f"k{i % 90}" for i in range(200)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    usual = sorted(map(tuple, encode.encode_column(df, "k", "id")[0].select("i", "id").collect()), key=str)
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(encode, "HOT", 4)
    enc, d = encode.encode_column(df, "k", "id")
    assert sorted(map(tuple, enc.select("i", "id").collect()), key=str) == usual
    assert sorted(map(tuple, encode.decode(enc, "id", d, "k").select("k", "i").collect()), key=str) == sorted(zip(keys, range(600)), key=str)


def test_decimals_beyond_doubles(spark):
    df = spark.sql("SELECT * FROM VALUES (CAST('9007199254740993.5' AS DECIMAL(20,1)), 1), (CAST('9007199254740993.0' AS DECIMAL(20,1)), 2) AS t(d, w)")
    ctx = prepare(from_columns(df, ["d"], "w"), validate="drop", cardinality="distinct")
    assert (ctx.tuples, ctx.mass, ctx.ids) == (1, 2, (9007199254740994,))


def test_result_gives_back_its_tables(spark):
    res = find_blocks(relation_of(spark, F1 * 3, 3), 2, "geo", "density", 1.0)
    paths = [*res.tables, *(h[2] for h in res.hits), *res.ctx.tables]
    assert len(paths) > 2
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert all(map(exists, paths))
    res.close()
    assert not any(map(exists, paths))


# -- what the delta and the next start read -------------------------------------


def light_block():
    """A dense block with less than half of the mass, and tuples spread over other values."""
    return [(i, j, 20) for i in range(2) for j in range(2)] + [(2 + i % 100, 2 + i * 7 % 90, 1) for i in range(200)]


def test_start_after_a_light_block_adds_up_its_tuples_only(spark, monkeypatch):
    rows = light_block()
    ctx = prepare(relation_of(spark, rows, 2), Options(merge="never"))
    whole, read = [], []
    start, delta = search._start_values, search._update_values_delta
    monkeypatch.setattr(search, "_start_values", lambda *a: whole.append(1) or start(*a))
    monkeypatch.setattr(search, "_update_values_delta", lambda alive, gone, *a: read.append(gone.count()) or delta(alive, gone, *a))
    res = find_blocks(ctx, 2, "geo", "density", 2.0)
    assert not whole and read == [4]
    expected = bruteforce.find_blocks(rows, 2, 2, "geo", "density", 2.0)
    assert [r["tuples"] for r in res.report().orderBy("block").collect()] == [e["tuples"] for e in expected]
    block = res.blocks[0]
    left = search.deflate(ctx, ctx.rows, block.members, block.sizes, ctx.all_values, ctx.n_rows)
    bag = lambda df: sorted(map(tuple, df.select("mode", "value", "mass", "tuples").collect()))
    assert bag(search._values_without(ctx, ctx.rows, ctx.all_values, block)) == bag(start(ctx, left))


def test_delta_leaves_out_the_peeled_dimension(spark):
    ctx = prepare(relation_of(spark, light_block(), 2), Options(merge="never"))
    light = (F.col("mode") == 0) & (F.col("mass") <= 2)
    kept, gone = ctx.all_values.where(~light), ctx.rows.join(ctx.all_values.where(light).select(F.col("value").alias("a0")), "a0", "left_semi")
    assert unpivot_dims(gone, 2, ["v"], without=0).count() == gone.count()
    bag = lambda df: sorted(map(tuple, df.collect()))
    assert bag(search._update_values_delta(kept, gone, 2, 0)) == bag(search._update_values_delta(kept, gone, 2))


def test_first_buckets_are_dealt_without_a_copy(spark, monkeypatch):
    rows = light_block()
    opts = Options(broadcast_rows=2, bitmap_bytes=0, hot_parts=8, layout="bucketed", merge="never")
    ctx = prepare(relation_of(spark, rows, 2), opts)
    names = []
    monkeypatch.setattr(search, "stored", lambda df, name, *a: names.append(name) or stored(df, name, *a))
    peel = search._Peel(ctx, ctx.rows, ctx.all_values, ctx.mass, "geo", "density", 2.0, None, None)
    assert names == ["hot_values", "hot"]
    cold, hot, _ = search.open_base(ctx, search.Base(**peel.s.base), ctx.rows)
    assert sorted(tuple(r)[:3] for r in cold.unionByName(hot).select("a0", "a1", "v").collect()) == sorted(rows)
