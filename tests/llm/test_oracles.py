import duckdb
import pytest

from tidemark.llm import queries


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if v is None or isinstance(v, bool | int | str) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
