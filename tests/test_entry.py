"""Driver contract: entry runs, queries and oracles line up."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["card_0"] == 10 and rows[0]["card_1"] == 10 and rows[0]["card_2"] == 1


def test_every_query_has_an_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {name for name in q if name != "pipeline" and not name.startswith("op")} <= set(o)
    for name, sql in o.items():
        assert sql.lstrip().upper().startswith("WITH"), name
