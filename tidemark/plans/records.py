"""Queries that change, judge and move records: upserts, patches, rejects, submissions, turns, rate limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import dedupe, listing, lookups, moderation
from tidemark.plans.registry import query
from tidemark.sources import load, sinks
from tidemark.streaming import rates


@query("upsert_union", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'U', round(o_totalprice * 2, 2) FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT -o_orderkey, 'N', 1.0 FROM orders WHERE o_custkey % 11 = 0")
def upsert_union(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    changed = o.where("o_custkey % 7 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))
    added = o.where("o_custkey % 11 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return sinks.upserted(o.drop("o_custkey"), changed.unionByName(added), "o_orderkey")


@query("moderated_update", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'hidden' ELSE 'approved' END AS status, CASE WHEN l.quality = 0 THEN 'low' ELSE source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def moderated_update(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lit("approved").alias("status"), "source")
    patch = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "hidden").alias("status"), F.when(F.col("quality") == 0, "low").alias("source"))
    return moderation.patched(docs, patch, "doc_id", ("status", "source"))


@query("visible_documents", "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0 AND d.doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def visible_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    docs = docs.join(first, docs["digest"].eqNullSafe(first["digest"])).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.withColumns({"status": F.when(F.coalesce("toxic", F.lit(0)) == 0, "approved").otherwise("hidden"), "duplicate_of": F.when(F.col("doc_id") != F.col("first"), F.col("first"))})
    return listing.visible(rows).select("doc_id", "lang")


@query("soft_delete", "SELECT o_orderkey, CASE WHEN t IS NULL THEN o_orderstatus ELSE 'hidden' END AS status, t AS duplicate_of FROM orders LEFT JOIN (SELECT max(o_orderkey) AS k, min(o_orderkey) AS t FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1) ON o_orderkey = k")
def soft_delete(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("status"), F.lit(None).cast("long").alias("duplicate_of"))
    merges = o.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("id"), F.min("o_orderkey").alias("target")).where("id <> target").select("id", "target")
    return moderation.merged_away(o, merges, "o_orderkey").select("o_orderkey", "status", "duplicate_of")


@query("delete_by_key", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 5)")
def delete_by_key(spark, sf_dir):
    return sinks.deleted(load(spark, sf_dir, "nation"), "n_nationkey", [3, 5]).select("n_nationkey", "n_name")


_REASONS = "CASE WHEN o_orderpriority = '5-LOW' THEN 'excluded-source' WHEN o_totalprice < 20000 THEN 'no-title' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'out-of-window' WHEN c_nationkey IS NULL OR c_nationkey % 5 = 0 THEN 'out-of-area' END"


@query("ordered_rejects", f"WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, {_REASONS} AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, o_custkey ORDER BY o_orderkey) AS pos FROM r) SELECT coalesce(reason, CASE WHEN pos > 1 THEN 'dupe' ELSE 'kept' END) AS reason, count(*) AS n FROM k GROUP BY 1")
def ordered_rejects(spark, sf_dir):
    rows = lookups.with_name(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), "o_custkey", "c_custkey", c_nationkey="c_nationkey")
    reasons = [
        ("excluded-source", F.col("o_orderpriority") == "5-LOW"),
        ("no-title", F.col("o_totalprice") < 20000),
        ("out-of-window", F.col("o_orderdate") < F.lit(dt.datetime(1993, 1, 1))),
        ("out-of-area", F.col("c_nationkey").isNull() | (F.col("c_nationkey") % 5 == 0)),
    ]
    return dedupe.reject_counts(dedupe.ordered_rejects(rows, reasons, ["o_custkey"], ["o_orderkey"]))


@query("submissions_checked", "SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'Title, date, and contact email are required.' WHEN c_custkey % 5 = 0 THEN 'Please provide a valid contact email.' END AS error, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM customer")
def submissions_checked(spark, sf_dir):
    mail = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, " at x.org").otherwise("@x.org"))
    forms = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 == 0, "  ").otherwise(F.col("c_name")).alias("title"), F.lit("2026-05-01").alias("event_date"), mail.alias("contact_email"))
    return moderation.submissions(forms).select("c_custkey", "error", "status")


@query("pending_queue", "SELECT o_orderkey, o_orderdate::VARCHAR AS at FROM orders WHERE o_orderstatus = 'P'")
def pending_queue(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumns({"status": F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done"), "start_at": F.col("o_orderdate")})
    return moderation.pending(o).select("o_orderkey", F.col("start_at").cast("string").alias("at"))


@query(
    "sanitized_turns",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), b AS (SELECT *, max((coalesce(role, '') NOT IN ('user', 'assistant') OR text IS NULL)::INTEGER) OVER (PARTITION BY conv_id) AS bad FROM r WHERE back <= 16), t AS (SELECT conv_id, turn, role, substr(trim(text, ' '), 1, 2000) AS text FROM b WHERE bad = 0), s AS (SELECT *, max((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS begun FROM t WHERE text <> ''), e AS (SELECT *, arg_max(role, turn) OVER (PARTITION BY conv_id) AS last FROM s WHERE begun = 1) SELECT conv_id, turn, role, text FROM e WHERE last = 'user'",
)
def sanitized_turns(spark, sf_dir):
    return moderation.sanitised_turns(load(spark, sf_dir, "conversations"))


@query("rate_limited")
def rate_limited(spark, sf_dir):
    """At most 3 accepted hits of a user in 10 minutes; tests check it against a plain loop."""
    return rates.rate_limited(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, window=600)


@query("ndjson_export", "SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def ndjson_export(spark, sf_dir):
    return sinks.ndjson_lines(load(spark, sf_dir, "events").select("event_id", "event_type"))


@query(
    "calendar_export",
    "SELECT event_id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//tidemark//EN', 'CALSCALE:GREGORIAN', 'BEGIN:VEVENT', 'UID:' || event_id || '@tidemark', 'DTSTAMP:20240101T000000Z', 'DTSTART:' || strftime(ts, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(ts + INTERVAL 2 HOUR, '%Y%m%dT%H%M%SZ'), 'SUMMARY:' || event_type, 'DESCRIPTION:' || replace(replace(replace(props, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ','), 'END:VEVENT', 'END:VCALENDAR') AS ics FROM events WHERE event_type = 'purchase'",
)
def calendar_export(spark, sf_dir):
    none, at = F.lit(None).cast("string"), F.col("ts").cast("timestamp")
    ev = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    return ev.select("event_id", sinks.calendar_entry(F.col("event_id"), at, F.lit(None).cast("timestamp"), F.col("event_type"), F.col("props"), none, none, dt.datetime(2024, 1, 1)).alias("ics"))


@query("last_by_id", "SELECT user_id, min(event_id) AS first_seen, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_by_id(spark, sf_dir):
    return lookups.last_by_id(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query("touched_sources", "SELECT s_suppkey, coalesce(d, 'never') AS last_run_at, CASE WHEN d IS NULL THEN 'new' ELSE 'ok' END AS last_status FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate)::DATE::VARCHAR AS d FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON s_suppkey = l_suppkey")
def touched_sources(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.lit("never").alias("last_run_at"), F.lit("new").alias("last_status"))
    runs = load(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").cast("date").cast("string").alias("finished_at")).withColumn("status", F.lit("ok"))
    return sinks.touched(s, runs, "s_suppkey")
