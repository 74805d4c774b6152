"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import pytest

from geotrail.plans import registry

REG = registry.load()


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else "nan" if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(REG.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    df = REG.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(REG.ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    mine = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    theirs = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    assert mine == theirs


def test_queries_without_sql_run(spark, sf):
    for name in set(REG.QUERIES) - set(REG.ORACLE_SQL):
        assert REG.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
