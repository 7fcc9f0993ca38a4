"""Line dedup against a plain-Python version; copies and removed lines that must survive."""

import random

import pytest
from pyspark.sql import functions as F

from denseblocks.llm import line_spread

SCHEMA = "doc_id long, text string, source string, gone string, keep long"


def brute(rows, sites):
    texts = {}
    for d, t, s in rows:
        if t is not None:
            texts[t] = min(texts.get(t, (True, 0, "~")), (d is None, d or 0, s or ""))
    on, keep = {}, {}
    for t, (none, d, s) in texts.items():
        for line in t.split("\n"):
            if line.strip(" "):
                on.setdefault(line, set()).add(s)
                keep[line] = min(keep.get(line, (True, 0)), (none, d))
    bad = {x for x, s in on.items() if len(s) >= (min(sites, 2) if len(x.split()) >= 50 else sites)}
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if x not in bad or keep[x] == (d is None, d or 0)]
        out.append((d, len(lines), len(lines) - len(left), None if t is None else "\n".join(left)))
    return out


def same(spark, rows, sites):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in line_spread.remove_spread_lines(df, sites).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[3]))
    assert sorted(got, key=key) == sorted(brute(rows, sites), key=key)


def long(i):
    return " ".join(f"w{i}_{j}" for j in range(60))


@pytest.mark.parametrize("sites,small", [(2, True), (3, False), (5, True)])
def test_random_documents(spark, monkeypatch, sites, small):
    if not small:
        monkeypatch.setattr(line_spread, "BROADCAST_BYTES", 0)
    rng = random.Random(sites)
    pool = [f"line {i}" for i in range(25)] + [long(i) for i in range(6)] + ["", "  ", "once"]
    rows = [(rng.choice([None, i]) if i % 17 == 0 else i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))), rng.choice([None, "a", "b", "c", "d", "e", "f", "g"])) for i in range(150)]
    rows += rows[:10] + [(500, None, "a"), (501, "", "b"), (None, "line 1", "c")] + [(600 + i, rows[3][1], "abcdefg"[i % 7]) for i in range(20)]
    same(spark, rows, sites)


def test_whole_copies_stay_and_no_line_vanishes(spark):
    text = "a text of its own\nwith two lines"
    rows = [(i, text, f"s{i}") for i in range(6)]  # copied to six sources
    rows += [(10 + i, f"own {i}\nAll rights reserved\n{long(1)}", f"s{i}") for i in range(6)]
    out = {r.doc_id: r.text for r in line_spread.remove_spread_lines(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert all(out[i] == text for i in range(6))
    assert out[10] == rows[6][1] and all(out[10 + i] == f"own {i}" for i in range(1, 6))
    assert {x for r in rows for x in r[1].split("\n")} == {x for t in out.values() for x in t.split("\n")}


def test_very_long_document(spark):
    rows = [(i, "\n".join(f"l{j}" for j in range(20_000)) + f"\nend {i}", f"s{i}") for i in range(6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = line_spread.remove_spread_lines(df).agg(F.sum("n_lines"), F.sum("n_removed")).first()
    assert tuple(out) == (6 * 20_001, 5 * 20_000)
