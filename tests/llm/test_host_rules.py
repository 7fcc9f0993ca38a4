"""Host rules against a plain-Python version, and the verdicts of made-up hosts."""

import random
import re

import pytest

from denseblocks.llm import host_rules
from denseblocks.llm.common import Stage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, host string, blocked boolean, n_docs long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word by word."""
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(windows) < 3000 else None
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, None if covered is None else len(covered)


def check(rows, docs):
    left = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows))
    right = sorted(measured(t) for t in docs if len(WORD.findall(t or "")) < 3000)
    kept = [x for x in left if x[0] < 3000]
    assert kept == right
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_measures_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(host_rules.judge(docs).collect(), [r.text for r in docs.select("text").collect()])


def test_measures_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b c", "a b c a b c", "a a a a", "x y  z", "l\nl\n \n\nl \nl", "## $%& |<>*", "\U0001f600 ünï 日本 " * 30]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(40)] * 2
    df = spark.createDataFrame([(i // 2 or None, t, None, "x", True, 1) for i, t in enumerate(texts)], SCHEMA)
    check(host_rules.judge(df).collect(), texts)
    assert host_rules.judge(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + "\nw0 w1 w2"
    row = host_rules.judge(spark.createDataFrame([(1, text, "s", "x", True, 1)], SCHEMA)).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (300_003, 6, False)


def clean(i):
    return " ".join(f"word{(i * 131 + j * 7) % 9973}" for j in range(80))


def hosts():
    """Good hosts with a few failures, one that writes with symbols, one of junk, a small one."""
    rows = []
    for h in range(12):
        rows += [(clean(h * 100 + i) + (" # # # # # # # # # # #" if i < 2 else ""), f"good{h}") for i in range(40)]
    rows += [(clean(5000 + i) + " # # # # # # # # # # #" * (i % 4 > 0), "markup") for i in range(60)]
    rows += [(clean(7000 + i) if i < 3 else "too short", "junk") for i in range(200)]
    rows += [("short", "tiny"), (clean(9000), "tiny"), (clean(9001), None)]
    return [(i, t, s, "x", True, 1) for i, (t, s) in enumerate(rows)]


@pytest.mark.parametrize("hot", [host_rules.HOT, 3])
def test_verdicts(spark, monkeypatch, hot):
    monkeypatch.setattr(host_rules, "HOT", hot)  # 3: hosts below a third of the rows go the other way
    rows = hosts()
    out = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = lambda s: [out[r[0]] for r in rows if r[2] == s]
    assert [r.kept for r in by("good0")] == [False] * 2 + [True] * 38  # the rule holds where it seldom fails
    assert all(r.kept for r in by("markup"))  # the way this host writes
    assert all(r.host_blocked and not r.kept for r in by("junk")) and not all(r.base_failed for r in by("junk"))
    assert [r.kept for r in by("tiny")] == [False, True] and by(None)[0].kept


def test_shrinking(spark):
    stage = Stage(spark, "test")
    df = spark.createDataFrame(hosts(), SCHEMA)
    got = {r.source: r for r in host_rules.host_verdicts(stage.put(host_rules.measures(df), "m"), stage).collect()}
    assert got["junk"].rate_any > 0.9 and 0.05 < got["tiny"].rate_any < 0.5 and got["markup"].rate_symbols > 0.5
    assert host_rules.beta_prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)
    a, b = host_rules.beta_prior(2, 100, 50, 25.0, 5000.0)  # equal rates: nothing between the hosts
    assert a == b == 50.0
