"""Queries of tables and indexes that are kept between runs: they are made in the shared folder, changed, read and deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import times as tm
from tidemark.operators import block_max, grouped_rows, search, segments
from tidemark.plans.corpus import _BASE, _BATCH, QUERY, _scored, docs_of, index_of, one_query
from tidemark.plans.registry import query
from tidemark.sources import buckets, load, statements
from tidemark.sources.folders import delete, shared_folder

_KEPT = """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 50 <> 2
    UNION ALL SELECT o_orderkey + 100000000, o_totalprice FROM orders WHERE o_orderkey % 40 = 0"""


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("upsert_buckets", _KEPT)
def upsert_buckets(spark, sf_dir):
    """K2 on a table in buckets: some rows changed, some deleted, some added, in two upserts."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path, k = _new_folder(spark, "orders"), F.col("o_orderkey")
    buckets.create(o, path, "o_orderkey", n=16)
    buckets.upsert(o.where(k % 50 == 1).withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(o.where(k % 50 == 2)), path, drop=k % 50 == 2)
    buckets.upsert(o.where(k % 40 == 0).withColumn("o_orderkey", k + 100_000_000), path)
    buckets.vacuum(spark, path, keep=1)
    return buckets.read(spark, path)


def _quoted(c):
    return f"coalesce('''' || replace({c}, '''', '''''') || '''', 'null')"


@query(
    "seed_rows",
    f"""SELECT '  (' || c_custkey || ', ' || {_quoted("c_name || '''s ' || c_mktsegment")} || ', ' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE (c_custkey % 2 = 0)::VARCHAR END || ', ' || CASE WHEN c_custkey % 4 = 0 THEN '''{{}}''::text[]' ELSE 'array[' || {_quoted("c_mktsegment")} || ']::text[]' END || ')' AS line FROM customer""",
)
def seed_rows(spark, sf_dir):
    """K3: rows of an upsert as SQL text, taken from its statements."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(
        k, F.concat("c_name", F.lit("'s "), "c_mktsegment").alias("name"), F.when(k % 3 > 0, k % 2 == 0).alias("free"), F.when(k % 4 > 0, F.array(F.lit(None), F.lit(""), "c_mktsegment")).alias("tags")
    )
    s = statements.statements(rows, "customer", "c_custkey")
    body = F.regexp_extract("statement", r"(?s)^insert into customer \(c_custkey, name, free, tags\) values\n(.*)\non conflict \(c_custkey\) do update set name = excluded\.name, free = excluded\.free, tags = excluded\.tags;$", 1)
    return s.select(F.explode(F.split(body, ",\n")).alias("line"))


def _segmented(spark, sf_dir):
    """An index in segments of the documents, dealt to files by language: made of some, then of all, one of them changed."""
    d = docs_of(spark, sf_dir)
    path, folder = _new_folder(spark, "index"), _new_folder(spark, "files")
    tokens = search.document_tokens(F.col("title"), F.col("source"), F.col("text"))
    read = lambda files: spark.read.schema(d.schema).parquet(*files)
    found = lambda: {f: s for x in ("de", "en", "fr", "rest") for f, s in segments.files_of(spark, f"{folder}/{x}").items()}
    for x in ("de", "en", "fr"):
        d.where(F.col("lang") == x).withColumn("text", F.when(F.col("lang") == "fr", F.lit("old words")).otherwise(F.col("text"))).write.parquet(f"{folder}/{x}")
    d.where(~F.coalesce(F.col("lang").isin("de", "en", "fr"), F.lit(False))).limit(0).write.parquet(f"{folder}/rest")
    segments.refresh(spark, path, found(), read, tokens, "doc_id")
    d.where(F.col("lang") == "fr").write.mode("overwrite").parquet(f"{folder}/fr")
    d.where(~F.coalesce(F.col("lang").isin("de", "en", "fr"), F.lit(False))).write.mode("overwrite").parquet(f"{folder}/rest")
    segments.refresh(spark, path, found(), read, tokens, "doc_id")
    delete(spark, folder)
    return segments.index(spark, path)


@query("segmented_frequency", f"WITH {_BASE.strip()} SELECT term, df FROM terms")
def segmented_frequency(spark, sf_dir):
    """Terms of an index that has followed its files, one of them new and one changed since it was made."""
    return _segmented(spark, sf_dir).terms


@query("segmented_search", _scored("SELECT 'q' AS query_id, 'the whea onthe' AS query") + " SELECT doc_id, score, matched FROM hits")
def segmented_search(spark, sf_dir):
    """A search over all segments."""
    queries = spark.range(1).select(F.lit("q").alias("query_id"), F.lit("the whea onthe").alias("query"))
    hits = search.matches(_segmented(spark, sf_dir), docs_of(spark, sf_dir), queries, local=F.col("lang") == "en", id_col="doc_id")
    return hits.select("doc_id", "score", "matched")


@query("block_max_top", _scored(_BATCH) + " SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS pos FROM hits QUALIFY pos <= 3")
def block_max_top(spark, sf_dir):
    """The best hits of every item, blocks that can hold none left unread."""
    docs = docs_of(spark, sf_dir)
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = block_max.top(block_max.blocked(index_of(docs)), docs, queries, 3, local=F.col("lang") == "en", id_col="doc_id")
    return hits.select("query_id", "doc_id", "score", "pos")


@query("block_max_filtered", _scored(f"SELECT 'q' AS query_id, '{QUERY}' AS query") + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS pos FROM hits WHERE lang = 'fr' QUALIFY pos <= 5")
def block_max_filtered(spark, sf_dir):
    """The filter counts before the hits that bound the others are chosen."""
    docs = docs_of(spark, sf_dir)
    hits = block_max.top(block_max.blocked(index_of(docs)), docs, one_query(spark), 5, keep=F.col("lang") == "fr", local=F.col("lang") == "en", id_col="doc_id")
    return hits.select("doc_id", "score", "pos")


_LOCAL_DAY = "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d')"


@query("listing_day_rows", f"SELECT {_LOCAL_DAY} AS day, event_id, row_number() OVER (PARTITION BY {_LOCAL_DAY} ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY {_LOCAL_DAY}) AS size FROM events")
def listing_day_rows(spark, sf_dir):
    """A1: the events of each day in order, as rows with their place."""
    ev = load(spark, sf_dir, "events").select(tm.local_day(F.col("ts")).alias("day"), "ts", "event_id")
    return grouped_rows.positioned(ev, ["day"], ["ts", "event_id"]).select("day", "event_id", "pos", "size")


@query(
    "digest_lines",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS size FROM documents)
SELECT '# ' || coalesce(source, '') || ' (' || size || ')' AS value FROM d WHERE pos = 1 UNION ALL SELECT '## ' || pos || ': ' || doc_id || ', ' || n_chars FROM d""",
)
def digest_lines(spark, sf_dir):
    """K8: digests of the sources, each headed by its name and size, as lines."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rows = grouped_rows.positioned(d, ["source"], ["doc_id"])
    text = lambda c: F.col(c).cast("string")
    header = F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit(" ("), text("size"), F.lit(")"))
    return grouped_rows.lines(rows, header, F.concat(F.lit("## "), text("pos"), F.lit(": "), text("doc_id"), F.lit(", "), text("n_chars"))).select("value")
