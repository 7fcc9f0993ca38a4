"""Quality rules judged by host.

Every document is measured by a few rules. How often the rules fail is counted by host
(here: ``source``) and each host's rates are shrunk towards those of all hosts by a beta
prior whose two parameters are estimated from the hosts themselves (method of moments).
The shrunk rates give a verdict on the host, which is joined back to its documents:

* a rule of style (STYLE: symbols, repeated lines, word length) takes documents of a
  host only if it *holds* there, that is if at most HOLDS of the host's documents fail it;
  where more do, it is the way that host writes and decides nothing;
* a host of which more than BLOCKED of the documents fail some rule goes as a whole.

Small hosts have no verdict of their own: the prior draws them to the common rate.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, python_tasks

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20  # bytes of a text that are split into words at a time
LEAST_WORDS = 50
HOLDS, BLOCKED = 0.3, 0.8
# Rules of style, as SQL over the measures of a document.
STYLE = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
BASE = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words"
# Hosts with at least 1 / HOT of the documents, so at most HOT of them, are joined by broadcast.
HOT = 4096
# Verdicts of other hosts are broadcast up to so many rows of at most 64 bytes.
BROADCAST_HOSTS = 500_000

MEASURES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]])


def word_ids(text: bytes) -> tuple[np.ndarray, int]:
    """The words of a text as numbers, equal words alike, and how many there are. The text is split
    in pieces, so that only distinct words are held; bytes are split at \\x20 and \\x09-\\x0D only."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    out, at = array("q"), 0
    while at < len(text):
        end = SPACE.search(text, min(at + PIECE, len(text)))  # a piece ends where a word does
        end = end.start() if end else len(text)
        out.extend(map(known.__getitem__, text[at:end].split()))
        at = end
    return np.frombuffer(out, dtype=np.int64), len(known)


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Number of words that stand in a window of three words which the text has twice or more."""
    if len(ids) < 4:
        return 0
    pairs = pd.factorize(ids[:-2] * kinds + ids[1:-1])[0]  # so that the product stays below n * n
    windows = pd.factorize(pairs * kinds + ids[2:])[0]
    again = np.bincount(windows)[windows] > 1
    marked = np.zeros(len(ids), dtype=bool)
    for i in range(3):
        marked[i : i + len(again)] |= again
    return int(marked.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a whole text."""
    text = text or ""
    ids, kinds = word_ids(text.encode("utf-8"))
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            seen.add(line)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    return len(ids), len(text) - spaces, len(SYMBOLS.findall(text)), lines, lines - len(seen), repeated_words(ids, kinds)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    python_tasks(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [measure(t.as_py()) for t in b.column(2)]
            columns = zip(*found) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in columns]], schema=MEASURES)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def beta_prior(hosts: int, docs: int, failed: int, squares: float, sizes: float) -> tuple[float, float]:
    """(alpha, beta) by the method of moments from sums over hosts: their number, documents
    n, failures x, x * x / n and n * n. The rates' variance between hosts is what is
    left of their spread after the binomial part; if nothing is left the prior weighs as much as
    all documents together."""
    if docs == 0:
        return 1.0, 1.0
    mean = failed / docs
    within = mean * (1 - mean)
    free = docs - sizes / docs
    between = (squares - failed * failed / docs - (hosts - 1) * within) / free if free > 0 else 0.0
    strength = within / between - 1 if between > 0 else float(docs)
    strength = min(max(strength, 1e-6), float(docs))
    return mean * strength, (1 - mean) * strength


def _key() -> Column:
    return F.coalesce(F.md5(F.col("source").cast("binary")), F.lit("null")).alias("host")


def host_verdicts(rows: DataFrame, stage: Stage) -> DataFrame:
    """One row per host of ``rows`` (measures): ``host`` (a key), source, n_docs, the shrunk
    failure rate of every rule of style and of any rule (``rate_<rule>``, ``rate_any``),
    ``holds_<rule>`` and ``blocked``."""
    rules = STYLE | {"any": " OR ".join(f"({r})" for r in [BASE, *STYLE.values()])}
    rows = rows.select(_key(), "source", *[F.expr(f"CAST({r} AS BIGINT)").alias(f"x_{n}") for n, r in rules.items()])
    hosts = rows.groupBy("host").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n_docs"), *[F.sum(f"x_{n}").alias(f"x_{n}") for n in rules])
    hosts = stage.put(hosts, "hosts")
    n = F.col("n_docs").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(n * n).alias("sizes")]
    sums += [F.sum(f"x_{r}").alias(f"x_{r}") for r in rules] + [F.sum(F.col(f"x_{r}").cast("double") * F.col(f"x_{r}") / n).alias(f"q_{r}") for r in rules]
    total = hosts.agg(*sums).first()
    rates = []
    for r in rules:
        a, b = beta_prior(total["hosts"], int(total["docs"] or 0), int(total[f"x_{r}"] or 0), float(total[f"q_{r}"] or 0), float(total["sizes"] or 0))
        rates.append(((F.col(f"x_{r}") + F.lit(a)) / (n + F.lit(a + b))).alias(f"rate_{r}"))
    hosts = hosts.select("host", "source", "n_docs", *rates)
    return hosts.select("*", *[(F.col(f"rate_{r}") <= HOLDS).alias(f"holds_{r}") for r in STYLE], (F.col("rate_any") > BLOCKED).alias("blocked"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored): the
    measures ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    ``base_failed``, ``host_blocked`` and ``kept``.

    A null or empty text has no words (and fails the base rules); a null source is a host of its
    own. Very long texts are measured whole. Repeated rows are measured, counted and
    returned each; rows with a null doc_id likewise. An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "hosts")
    rows = stage.put(measures(docs), "measures")
    hosts = host_verdicts(rows, stage).select("host", "n_docs", *[f"holds_{r}" for r in STYLE], "blocked")
    hosts = stage.put(hosts, "verdicts")
    total = hosts.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.broadcast(hosts.where(F.col("n_docs") * HOT >= total))  # at most HOT rows
    usual = "NOT blocked AND " + " AND ".join(f"holds_{r}" for r in STYLE)
    other = stage.put(hosts.where(F.col("n_docs") * HOT < total).where(f"NOT ({usual})"), "other")
    other = F.broadcast(other) if other.count() <= BROADCAST_HOSTS else other
    rows = rows.withColumn("host", _key())
    small_hosts = rows.join(hot.select("host"), "host", "left_anti").join(other, "host", "left")
    out = rows.join(hot, "host").unionByName(small_hosts)
    style = F.lit(False)
    for name, rule in STYLE.items():
        style = style | (F.expr(rule) & F.coalesce(F.col(f"holds_{name}"), F.lit(True)))
    out = out.withColumn("base_failed", F.expr(BASE)).withColumn("host_blocked", F.coalesce("blocked", F.lit(False)))
    kept = ~F.col("base_failed") & ~F.col("host_blocked") & ~style
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_blocked", kept.alias("kept"))


def sql() -> str:
    """The same in DuckDB's SQL."""
    any_rule = " OR ".join(f"({r})" for r in [BASE, *STYLE.values()])
    rules = STYLE | {"any": any_rule}
    count = ", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END)::DOUBLE AS x_{n}" for n, r in rules.items())
    prior = ", ".join(f"sum(x_{n}) / sum(n) AS m_{n}, (sum(x_{n} * x_{n} / n) - sum(x_{n}) * sum(x_{n}) / sum(n) - (count(*) - 1) * (sum(x_{n}) / sum(n)) * (1 - sum(x_{n}) / sum(n))) AS s_{n}" for n in rules)
    strength = ", ".join(f"m_{n}, least(greatest(CASE WHEN free > 0 AND s_{n} > 0 THEN m_{n} * (1 - m_{n}) * free / s_{n} - 1 ELSE docs END, 1e-6), docs) AS t_{n}" for n in rules)
    rates = ", ".join(f"(x_{n} + m_{n} * t_{n}) / (n + t_{n}) AS rate_{n}" for n in rules)
    style = " OR ".join(f"(({r}) AND rate_{n} <= {HOLDS})" for n, r in STYLE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
triples AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c FROM w WHERE len(w) >= 3),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM triples),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_lines,
    coalesce(lines.again, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w ON d.r = w.r LEFT JOIN lines ON d.r = lines.r LEFT JOIN covered ON d.r = covered.r),
h AS (SELECT source, count(*)::DOUBLE AS n, {count} FROM m GROUP BY source),
p AS (SELECT sum(n) AS docs, sum(n) - sum(n * n) / sum(n) AS free, {prior} FROM h),
q AS (SELECT docs, {strength} FROM p),
v AS (SELECT h.source, {rates} FROM h, q)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, rate_any > {BLOCKED} AS host_blocked,
    NOT ({BASE}) AND NOT rate_any > {BLOCKED} AND NOT ({style}) AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""
