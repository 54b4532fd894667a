import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.sources import buckets, folders, sinks, statements


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


# --- SQL text --------------------------------------------------------------------------------------------


def test_literals(spark):
    df = spark.createDataFrame([(1, "it's", True, 1.5, ["a", "", None, "b'"], None), (2, None, None, float("nan"), [], "x\ny")], "k int, s string, b boolean, d double, a array<string>, t string")
    assert [r[0] for r in df.orderBy("k").select(statements.value_lines(df)).collect()] == ["  (1, 'it''s', true, 1.5, array['a','b''']::text[], null)", "  (2, null, null, 'NaN', '{}'::text[], 'x\ny')"]


def test_statements_run_in_a_database_give_the_upserted_table(spark, tmp_path):
    old = spark.range(0, 900).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("it's "), F.col("id").cast("string")).alias("v"), F.lit(None).cast("boolean").alias("free"))
    new = spark.range(600, 1900).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("new\n;' "), F.col("id").cast("string"))).alias("v"), (F.col("id") % 2 == 0).alias("free"), F.lit(1).alias("no"))
    new = new.unionByName(new.where("k % 100 = 0").withColumn("v", F.lit("last")).withColumn("no", F.lit(2)))
    values = new.groupBy("k").agg(F.max_by(F.struct("k", "v", "free"), "no").alias("r")).select("r.*")
    statements.write_statements(values, str(tmp_path / "sql"), "t", "k", rows=100)
    want = rows_of(sinks.upserted(old, new, "k", ["no"]).select("k", "v", "free"))
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR, free BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r) for r in old.collect()])
    files = [f for f in os.listdir(tmp_path / "sql") if f.endswith(".txt")]
    texts = [(tmp_path / "sql" / f).read_text() for f in sorted(files, reverse=True)]
    for _ in range(2):  # run again, nothing changes
        for text in texts:
            con.execute(text)
        assert sorted((tuple(r) for r in con.sql("SELECT * FROM t").fetchall()), key=str) == want
    s = statements.statements(new, "t", "k", rows=100, order=["no"]).collect()
    assert max(r.n for r in s) == 100 and sum(r.n for r in s) == 1300 and len({(r.part, r.no) for r in s}) == len(s)
    assert statements.statements(new.limit(0), "t", "k").collect() == []
    assert "set v = excluded.v, updated_at = now();" in statements.statements(new, "t", "k", update=("v",), touch="updated_at").first().statement


# --- tables in buckets ------------------------------------------------------------------------------------


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(0, 500).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    path = "file://" + str(tmp_path / "table")
    buckets.create(df, path, "k", n=16)
    return path


def files(path):
    root = path.removeprefix("file://") + "/data"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_upsert_writes_touched_buckets_only(spark, table):
    before, first = files(table), buckets.manifest(spark, table)
    new = spark.createDataFrame([(7, "seven", 1), (7, "VII", 2), (9_000, "new", 1)], "k long, v string, no int")
    with pytest.raises(ValueError, match="no column no"):
        buckets.upsert(new, table)
    m = buckets.upsert(new.drop("no").where("v <> 'seven'"), table)
    assert m.version == 2 and sum(first.runs.get(b) != r for b, r in m.runs.items()) == 2
    after = files(table)
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) == 2
    want = sorted([(k, f"v{k}") for k in range(500) if k != 7] + [(7, "VII"), (9_000, "new")], key=str)
    assert rows_of(buckets.read(spark, table)) == want
    assert (7, "v7") in rows_of(buckets.read(spark, table, version=1)) and buckets.read(spark, table, 1).count() == 500
    assert rows_of(buckets.lookup(spark, table, [7, 8, 77_777])) == [(7, "VII"), (8, "v8")]


def test_last_of_a_key_deletes_and_nulls(spark, table):
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "gone", 1), (None, "null", 1)], "k long, v string, ord int")
    rows = new.withColumn("v", F.col("v"))
    buckets.upsert(rows.select("k", "v").where("v IN ('b', 'gone', 'null')"), table, drop=F.col("v") == "gone")
    got = dict(rows_of(buckets.read(spark, table)))
    assert got[1] == "b" and 2 not in got and got[None] == "null" and len(got) == 500
    buckets.upsert(spark.createDataFrame([(None,)], "k long"), table)
    assert dict(rows_of(buckets.read(spark, table)))[None] is None
    assert buckets.upsert(new.select("k", "v").limit(0), table).version == 3


def test_a_failed_run_leaves_the_old_version(spark, table):
    boom = F.udf(lambda k: 1 / 0, "string")
    with pytest.raises(Exception, match="division"):
        buckets.upsert(spark.range(5).select(F.col("id").alias("k"), boom("id").alias("v")), table)
    assert buckets.manifest(spark, table).version == 1 and buckets.read(spark, table).count() == 500


def test_second_writer_of_a_version_gets_an_error(spark, table):
    m = buckets.manifest(spark, table)
    buckets.upsert(spark.createDataFrame([(1, "x")], "k long, v string"), table)
    late = buckets.Manifest(m.version + 1, m.key, m.n, m.schema, m.runs)
    with pytest.raises(Exception, match="(?i)exists"):
        buckets._commit(spark, table, late)
    assert dict(rows_of(buckets.read(spark, table)))[1] == "x"
    assert [n for n in folders.names(spark, f"{table}/manifests") if n.endswith(".tmp")] == []


def test_vacuum_keeps_what_is_listed(spark, table):
    for i in range(3):
        buckets.upsert(spark.createDataFrame([(1, f"x{i}")], "k long, v string"), table)
    want, n = rows_of(buckets.read(spark, table)), len(files(table))
    assert buckets.vacuum(spark, table, keep=2) == 2 and len(files(table)) == n - 2
    assert rows_of(buckets.read(spark, table)) == want and buckets.read(spark, table, 3).count() == 500
    with pytest.raises(FileNotFoundError):
        buckets.manifest(spark, "file:///nowhere")
