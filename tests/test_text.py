"""F4 parser lines, text round trip and sinks."""

import os
import tempfile

import pytest

from denseblocks import find_blocks
from denseblocks.sources.sinks import write_blocks
from denseblocks.sources.text import classify_lines, parse_lines, read_relation_text

from .conftest import F1


def _lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_f4_lines(spark):
    lines = ["1,2,3", "1,2,3,9", "4,5", "", "6,x,7", "8,9,99999999999", "1,-1,2", "1,2,0", "+3,4,5", " 5,1,1", "1,2,"]
    got = {r["line"]: r for r in classify_lines(_lines(spark, lines), 2).collect()}
    assert got["1,2,3"]["reason"] is None and (got["1,2,3"]["a0"], got["1,2,3"]["v"]) == (1, 3)
    assert got["1,2,3,9"]["reason"] is None and got["1,2,3,9"]["v"] == 3
    assert got["4,5"]["reason"] == "short"
    assert got[""]["reason"] == "short"
    assert got["6,x,7"]["reason"] == "bad_token"
    assert got["8,9,99999999999"]["reason"] is None and got["8,9,99999999999"]["v"] == 99_999_999_999
    assert got["1,-1,2"]["reason"] == "invalid"
    assert got["1,2,0"]["reason"] == "invalid"
    assert got["+3,4,5"]["reason"] is None
    assert got[" 5,1,1"]["reason"] == "bad_token"  # no whitespace in integer tokens
    assert got["1,2,"]["reason"] == "short"  # trailing empty tokens do not count


def _splits(df):
    """How often the optimised plan of ``df`` cuts a line into tokens."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return sum(plan.apply(i).verboseString(10**6).count("split(") for i in range(plan.treeString().count("\n")))


def test_accepted_lines_are_parsed_once(spark):
    cls = classify_lines(_lines(spark, ["1,2,3", "4,5", "6,x,7", "1,-1,2"]), 2)
    accepted = cls.filter("reason IS NULL").select("a0", "a1", "v")
    assert [tuple(r) for r in accepted.collect()] == [(1, 2, 3)]
    assert _splits(accepted) == 1


def test_rejected_lines_are_parsed_once(spark):
    cls = classify_lines(_lines(spark, ["1,2,3", "4,5", "6,x,7", "1,-1,2"]), 2)
    rejected = cls.filter("reason IS NOT NULL").select("line", "reason")
    assert {tuple(r) for r in rejected.collect()} == {("4,5", "short"), ("6,x,7", "bad_token"), ("1,-1,2", "invalid")}
    assert _splits(rejected) == 1


@pytest.mark.parametrize("delimiter", [",", "||"])
def test_end_of_line_and_further_tokens(spark, delimiter):
    """Only delimiters at the very end do not count, and tokens after the measure are not cut."""
    lines = ["1,2,\n", "1,2,,,", "1,2,3,,,", "1,2,3" + "," * 3000 + "x", "1,2,,x", "1,,3"]
    cls = classify_lines(_lines(spark, [x.replace(",", delimiter) for x in lines]), 2, delimiter)
    assert [r["reason"] for r in cls.collect()] == ["bad_token", "short", None, None, "bad_token", "bad_token"]
    plan = cls._jdf.queryExecution().optimizedPlan().toString()
    assert ("regexp_replace(" in plan) == (len(delimiter) > 1)


def test_failfast(spark):
    with pytest.raises(ValueError):
        parse_lines(_lines(spark, ["1,2,3", "6,x,7"]), 2, mode="failfast")
    rel, rejected = parse_lines(_lines(spark, ["1,2,3", "6,x,7"]), 2, mode="drop")
    assert rel.df.count() == 1 and rejected.count() == 1


def test_text_round_trip_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="denseblocks-test-")
    src = os.path.join(d, "in.txt")
    with open(src, "w") as f:
        f.write("\n".join(",".join(str(x) for x in t) for t in F1) + "\n")
    rel, rejected = read_relation_text(spark, src, 3)
    assert rejected.count() == 0
    res = find_blocks(rel, k=2, measure="geo", policy="density", theta=1.0)
    out = os.path.join(d, "out")
    write_blocks(res, out)
    attrs = spark.read.csv(os.path.join(out, "attributes"), schema="mode int, value long, block int").collect()
    b1 = sorted((r["mode"], r["value"]) for r in attrs if r["block"] == 1)
    assert b1 == [(m, v) for m in range(3) for v in (0, 1)]
    tuples = spark.read.csv(os.path.join(out, "tuples"), schema="a0 long, a1 long, a2 long, v long, block int")
    assert tuples.filter("block = 1").count() == 6
    rep = spark.read.option("header", True).csv(os.path.join(out, "report")).collect()
    assert len(rep) == 2
    assert "Volume: 2 X 2 X 2" in res.text()


def test_cli_job(spark):
    from denseblocks.plans import job

    d = tempfile.mkdtemp(prefix="denseblocks-cli-")
    src = os.path.join(d, "in.txt")
    with open(src, "w") as f:
        f.write("\n".join(",".join(str(x) for x in t) for t in F1) + "\nshort\n")
    out = os.path.join(d, "out")
    assert job.main([src, out, "3", "GEO", "density", "2.0", "2", "--malformed", "drop"]) == 0
    rep = spark.read.option("header", True).csv(os.path.join(out, "report")).orderBy("block").collect()
    assert [int(r["mass"]) for r in rep] == [32, 5]
    assert spark.read.csv(os.path.join(out, "rejected")).count() == 1
    with pytest.raises(SystemExit):
        job.parse_args([src, out, "3", "geo", "density", "0.5", "1"])
