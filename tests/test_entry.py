"""The driver's contract on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    from sessionloom import registry

    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols, name
        at = [rel.columns.index(c) for c in cols]
        assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall()), name
    assert entry.entry(spark).count() > 0
