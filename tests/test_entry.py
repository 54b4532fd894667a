import duckdb
import pytest

import __spark_entry__
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if v is None or isinstance(v, bool | int | str) else str(v)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    order = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert len(got) > 0 or name in ("unmatched_sources",)


def test_rows_only_queries(spark, sf_dir):
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, sf_dir).count() > 0
