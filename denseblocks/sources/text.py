"""Delimited text source for relations.

A line is ``a0<d>a1<d>..<d>aN-1<d>v[<d>anything]``: the first N tokens are
dimension ids, token N is the measure, extra tokens are ignored. One rule
for every line:

* ``short``     -- fewer than N+1 tokens (trailing empty tokens do not count);
* ``bad_token`` -- one of the first N+1 tokens is not an optionally signed
  run of decimal digits that fits a BIGINT;
* ``invalid``   -- a negative id or a measure below 1 (0 with ``allow_zero``).

``mode="failfast"`` raises on any rejected line, ``"drop"`` keeps them out
of the relation and returns them with their reason.

The job that reads the lines also counts them: lines, rejects by reason, and the
profile of the accepted tuples (number, mass, largest ids, estimated distinct
coordinates) are observed while it stores the relation, so neither the search nor
``failfast`` reads the text again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import counted
from ..operators.profile import coordinates, profile_of
from ..relation import Relation

INTEGER_TOKEN = r"^[+-]?[0-9]+$"


def _tokens(line: Column, delimiter: str, most: int) -> Column:
    """The first ``most`` - 1 tokens of a line and what follows them, uncut, as the last one."""
    d = re.escape(delimiter)
    # One character is trimmed without a pattern, which would try every run of delimiters to its end.
    full = F.rtrim(line, F.lit(delimiter)) if len(delimiter) == 1 else F.regexp_replace(line, f"(?:{d})+\\z", "")
    return F.split(full, d, most)


def classify_lines(lines: DataFrame, n_dims: int, delimiter: str = ",", allow_zero: bool = False, column: str = "value") -> DataFrame:
    """Parse every line: columns line, a0..aN-1, v, reason (null when accepted)."""
    toks = _tokens(F.col(column), delimiter, n_dims + 2)
    df = lines.select(F.col(column).alias("line"), toks.alias("_t"))
    parsed = []
    ok = F.lit(True)
    for i in range(n_dims + 1):
        t = F.try_element_at(F.col("_t"), F.lit(i + 1))
        val = F.when(t.rlike(INTEGER_TOKEN), t.try_cast("long"))
        parsed.append(val.alias(f"a{i}" if i < n_dims else "v"))
    df = df.select("line", F.size("_t").alias("_n"), *parsed)
    for i in range(n_dims):
        ok = ok & F.col(f"a{i}").isNotNull()
    ok = ok & F.col("v").isNotNull()
    valid = F.col("v") >= (0 if allow_zero else 1)
    for i in range(n_dims):
        valid = valid & (F.col(f"a{i}") >= 0)
    reason = (
        F.when(F.col("_n") < n_dims + 1, F.lit("short"))
        .when(~ok, F.lit("bad_token"))
        .when(~valid, F.lit("invalid"))
    )
    names = ["line", *[f"a{i}" for i in range(n_dims)], "v", "reason"]
    # A filter of ``reason`` would be pushed below these steps with the whole parse written out
    # at each of its mentions; it stops at a generator, so that each line is parsed once.
    return df.withColumn("reason", reason).select(F.inline(F.array(F.struct(*names))))


def parse_lines(
    lines: DataFrame,
    n_dims: int,
    delimiter: str = ",",
    mode: str = "drop",
    allow_zero: bool = False,
    column: str = "value",
) -> tuple[Relation, DataFrame]:
    """(relation of accepted lines, rejected lines with reason)."""
    return _accepted(classify_lines(lines, n_dims, delimiter, allow_zero, column), n_dims, mode)


def _accepted(cls: DataFrame, n_dims: int, mode: str) -> tuple[Relation, DataFrame]:
    rel_df = cls.filter(F.col("reason").isNull()).select(*[f"a{i}" for i in range(n_dims)], "v")
    rejected = cls.filter(F.col("reason").isNotNull()).select("line", "reason")
    if mode == "failfast":
        bad = rejected.limit(1).collect()  # existence check only
        if bad:
            raise ValueError(f"malformed line {bad[0]['line']!r}: {bad[0]['reason']}")
    elif mode != "drop":
        raise ValueError("mode must be 'failfast' or 'drop'")
    return Relation(rel_df, n_dims, scan_based=True), rejected


def read_relation_text(
    spark: SparkSession,
    path: str,
    n_dims: int,
    delimiter: str = ",",
    mode: str = "drop",
    allow_zero: bool = False,
) -> tuple[Relation, DataFrame]:
    """Read a relation from text files (splits follow the files). Lines are read and parsed once:
    the accepted ones and the rejected ones go to one Parquet table, and the counters of
    that job to ``Relation.profile`` and ``Relation.counts``."""
    cls = classify_lines(spark.read.text(path), n_dims, delimiter, allow_zero)
    cls = cls.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line")))
    table, _, seen = counted(cls, "text", counters(n_dims))
    counts = {n: int(seen[n] or 0) for n in ("lines", *REASONS)}
    rel, rejected = _accepted(table, n_dims, mode if any(counts[r] for r in REASONS) else "drop")
    rel.profile, rel.counts = profile_of({**seen, "invalid": 0}, n_dims), counts
    return rel, rejected


REASONS = ("short", "bad_token", "invalid")


def counters(n_dims: int) -> dict[str, Column]:
    """Counters over classified lines: lines, rejects by reason, and the profile of the
    accepted ones."""
    good = F.col("reason").isNull()
    out = {"lines": F.count(F.lit(1)), "tuples": F.sum(good.cast("long"))}
    out |= {r: F.sum((F.col("reason") == r).cast("long")) for r in REASONS}
    out["mass"] = F.sum(F.when(good, F.col("v")))
    out |= {f"card_{i}": F.max(F.when(good, F.col(f"a{i}"))) + 1 for i in range(n_dims)}
    return out | {"coordinates": coordinates(n_dims, good)}


def split_malformed(lines: DataFrame, n_dims: int, delimiter: str = ",") -> DataFrame:
    """Only the rejected lines, with reason (S3)."""
    return classify_lines(lines, n_dims, delimiter).filter(F.col("reason").isNotNull()).select("line", "reason")
