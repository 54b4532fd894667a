"""Listing queries over events, orders and dimensions.

Events stand for dated listings (ts: start, event_type: category, props.k: venue number). As-of instants are
fixed, so results are too.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.operators import dedupe, listing, lookups, rollups
from tidemark.plans.registry import query
from tidemark.sources import load

AS_OF = dt.datetime(2024, 1, 13, 20, 0)  # a Saturday at noon in the zone
COLUMNS = listing.Listing(id="event_id", start="ts", category="event_type", texts=("event_type", "props"), places=("props",), tags=None)
#: Local day and month of an event in DuckDB.
_DAY = "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d')"


def events(spark, sf_dir):
    return load(spark, sf_dir, "events")


@query("listing_filtered", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND contains(lower(props), '\"k\": 1') AND ts BETWEEN TIMESTAMP '2024-01-05 08:00:00' AND TIMESTAMP '2024-01-20'")
def listing_filtered(spark, sf_dir):
    f = listing.EventFilters(category="click", location='"k": 1', start=dt.datetime(2024, 1, 5, 8), end=dt.datetime(2024, 1, 20), columns=COLUMNS)
    return listing.filtered(events(spark, sf_dir), f).select("event_id", "event_type", "value")


@query("listing_search", "SELECT event_id, event_type FROM events WHERE (contains(lower(event_type), 'ew') OR contains(lower(props), 'ew')) AND ts >= TIMESTAMP '2024-01-13 17:00:00'")
def listing_search(spark, sf_dir):
    found = listing.filtered(events(spark, sf_dir), listing.EventFilters(search="EW", columns=COLUMNS))
    return listing.upcoming(found, AS_OF, COLUMNS).select("event_id", "event_type")


@query("listing_by_day", f"SELECT {_DAY} AS day, count(*) AS n, round(sum(value), 4) AS total, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_id FROM events GROUP BY 1")
def listing_by_day(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(tm.local_day(F.col("ts")).alias("day"))
    return days.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@query("listing_day_items", f"SELECT {_DAY} AS day, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events WHERE event_type = 'signup' OR event_type = 'purchase' GROUP BY 1")
def listing_day_items(spark, sf_dir):
    rows = listing.by_day(events(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase")), "event_id", c=COLUMNS, n=F.count("*"))
    return rows.select("day", "n", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("facet_by_day", f"SELECT coalesce(CASE WHEN user_id % 10 <> 0 THEN {_DAY} END, 'undated') AS day, count(*) AS n, count_if(event_type = 'view') AS in_town FROM events GROUP BY 1")
def facet_by_day(spark, sf_dir):
    day = F.when(F.col("user_id") % 10 != 0, tm.local_day(F.col("ts")))
    return listing.day_facet(events(spark, sf_dir), day, in_town=F.count_if(F.col("event_type") == "view"))


@query("month_rollup", f"SELECT substr(d, 1, 7) AS month, d AS day, count(*) AS n FROM (SELECT {_DAY} AS d FROM events) GROUP BY GROUPING SETS ((month, day), (month), ())")
def month_rollup(spark, sf_dir):
    return listing.month_rollup(events(spark, sf_dir), tm.local_day(F.col("ts")))


@query("weekend_events", f"SELECT event_id, {_DAY} AS day FROM events WHERE {_DAY} IN ('2024-01-13', '2024-01-14', '2024-01-19')")
def weekend_events(spark, sf_dir):
    return listing.weekend(events(spark, sf_dir), AS_OF, COLUMNS).select("event_id", tm.local_day(F.col("ts")).alias("day"))


@query("weekend_range_events", f"SELECT event_id, {_DAY} AS day FROM events WHERE {_DAY} BETWEEN '2024-01-13' AND '2024-01-14'")
def weekend_range_events(spark, sf_dir):
    return listing.coming_weekend(events(spark, sf_dir), AS_OF, COLUMNS).select("event_id", tm.local_day(F.col("ts")).alias("day"))


@query("today_events", f"SELECT event_id, value FROM events WHERE {_DAY} = '2024-01-13'")
def today_events(spark, sf_dir):
    return listing.today(events(spark, sf_dir), AS_OF, COLUMNS).select("event_id", "value")


@query("upcoming_week", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-13 17:00:00' AND ts <= TIMESTAMP '2024-01-20 20:00:00'")
def upcoming_week(spark, sf_dir):
    return listing.within(listing.upcoming(events(spark, sf_dir), AS_OF, COLUMNS), AS_OF, c=COLUMNS).select("event_id", "event_type")


@query("topk_per_day", f"SELECT day, event_id, pos, greatest(c - 3, 0) AS more FROM (SELECT {_DAY} AS day, event_id, row_number() OVER (PARTITION BY {_DAY} ORDER BY ts, event_id)::INTEGER AS pos, count(*) OVER (PARTITION BY {_DAY}) AS c FROM events) WHERE pos <= 3")
def topk_per_day(spark, sf_dir):
    rows = events(spark, sf_dir).select(tm.local_day(F.col("ts")).alias("day"), "event_id", "ts")
    return listing.top_per_group(rows, ["day"], [F.col("ts"), F.col("event_id")], 3).select("day", "event_id", "pos", "more")


@query("first_rail", "SELECT event_id, ts::VARCHAR AS at FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 6")
def first_rail(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'purchase'").orderBy("ts", "event_id").limit(6).select("event_id", F.col("ts").cast("string").alias("at"))


@query("related_events", "SELECT a.event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id)::INTEGER AS rank, b.event_id AS related_id FROM events a JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) b ON a.event_type = b.event_type AND a.event_id <> b.event_id WHERE b.r <= 4 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) <= 3")
def related_events(spark, sf_dir):
    return listing.related(events(spark, sf_dir), "event_id", "event_type", ["ts", "event_id"])


@query("month_nav", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT month, n, lag(month) OVER (ORDER BY month) AS prev, lead(month) OVER (ORDER BY month) AS next FROM m) SELECT * FROM w ORDER BY CASE WHEN month = '1996-05' THEN 0 WHEN month = '1997-01' THEN 1 ELSE 2 END, month LIMIT 1")
def month_nav(spark, sf_dir):
    return listing.month_nav(load(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM"), "1996-05", "1997-01")


@query("month_grid", "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS first FROM orders), g AS (SELECT first, range(0, (ceil((dayofweek(first) + dayofmonth(last_day(first))) / 7.0) * 7)::INTEGER) AS cells, dayofweek(first) AS lead FROM m), c AS (SELECT first, lead, unnest(cells)::INTEGER AS cell FROM g) SELECT strftime(first, '%Y-%m') AS month, cell, CASE WHEN cell >= lead AND month(first + (cell - lead)::INTEGER) = month(first) THEN strftime(first + (cell - lead)::INTEGER, '%Y-%m-%d') END AS day FROM c")
def month_grid(spark, sf_dir):
    months = load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "MM").alias("first")).distinct()
    cells = months.select("first", F.posexplode(tm.month_days(F.col("first"))).alias("cell", "d"))
    return cells.select(F.date_format("first", "yyyy-MM").alias("month"), "cell", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("interval_overlap", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE greatest(l_shipdate, o_orderdate)::DATE >= DATE '1996-03-01' AND o_orderdate::DATE <= DATE '1996-03-31' GROUP BY 1")
def interval_overlap(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"))
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).withColumn("end", F.greatest("ship", "start"))
    hit = listing.overlapping(F.col("start"), F.col("end"), "1996-03-01", "1996-03-31")
    return rows.where(hit).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("lookup_join", "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    rows = lookups.with_name(load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", nation="n_name", regionkey="n_regionkey")
    return lookups.with_name(rows, load(spark, sf_dir, "region"), "regionkey", "r_regionkey", region="r_name").select("c_custkey", "nation", "region")


@query("lookup_default", "SELECT s_suppkey, coalesce(n.n_name, d.n_name) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON s_nationkey = n.n_nationkey, (SELECT n_name FROM nation WHERE n_nationkey = 0) d")
def lookup_default(spark, sf_dir):
    dim = load(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return lookups.with_default(load(spark, sf_dir, "supplier"), dim, "s_nationkey", "n_nationkey", 0, nation="n_name").select("s_suppkey", "nation")


@query("productive_sources", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def productive_sources(spark, sf_dir):
    good = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return rollups.productive(load(spark, sf_dir, "customer"), good, "c_custkey").select("c_custkey", "c_mktsegment")


@query("unmatched_sources", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unmatched_sources(spark, sf_dir):
    return lookups.unmatched(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey")


@query("count_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count_if(o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def count_by_month(spark, sf_dir):
    return rollups.counts(load(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM"), "month", finished=F.col("o_orderstatus") == "F")


@query("count_by_category", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def count_by_category(spark, sf_dir):
    return rollups.counts(events(spark, sf_dir), F.col("event_type"), "category").orderBy(F.desc("n"), "category")


@query("count_by_source", "SELECT coalesce(source, 'none') AS source, count(*) AS n, count_if(lang = 'en') AS english FROM documents GROUP BY 1")
def count_by_source(spark, sf_dir):
    return rollups.counts(load(spark, sf_dir, "documents"), F.coalesce("source", F.lit("none")), "source", english=F.col("lang") == "en")


@query("source_rollup", "SELECT s_suppkey AS supplier, urls, ok, coalesce(events, 0) AS events FROM (SELECT l_suppkey AS s_suppkey, count(*) AS urls, count_if(l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1) LEFT JOIN (SELECT s_suppkey, count(*) AS events FROM supplier WHERE s_acctbal > 0 GROUP BY 1) USING (s_suppkey)")
def source_rollup(spark, sf_dir):
    pages = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_returnflag")
    ev = load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier"))
    return rollups.source_rollup(pages, ev, "supplier", F.col("l_returnflag") == "N")


@query("best_page", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, arg_min(url, struct_pack(a := length(url), b := page_id)) AS url FROM pages WHERE length(html) > 1000 GROUP BY 1")
def best_page(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    return rollups.best_page(pages, "host", "url", "page_id", F.length("html") > 1000)


@query("canonical_page", "SELECT host, CASE WHEN host LIKE 'm.%' THEN 'https://' || host || '/' ELSE url END AS url FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, arg_min(url, struct_pack(a := length(url), b := page_id)) AS url FROM pages GROUP BY 1)")
def canonical_page(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    canonical = pages.where("host LIKE 'm.%'").select("host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("url")).distinct()
    return rollups.overridden(rollups.best_page(pages, "host", "url", "page_id", F.lit(True)), canonical, "host", "url")


@query("run_summary", "SELECT count(*) AS sources, sum(found)::BIGINT AS found, sum(created)::BIGINT AS created, sum(dup)::BIGINT AS duplicates, count_if(found > 0 AND created = 0) AS n_errors FROM (SELECT event_type, count(*) AS found, count(DISTINCT user_id) AS created, count(*) - count(DISTINCT user_id) AS dup FROM events GROUP BY 1)")
def run_summary(spark, sf_dir):
    ev = events(spark, sf_dir)
    logs = ev.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("found"), F.count_distinct("user_id").alias("created"))
    logs = logs.withColumns({"duplicates": F.col("found") - F.col("created"), "error": F.when((F.col("found") > 0) & (F.col("created") == 0), "nothing new")})
    return rollups.run_summary(logs).select("sources", "found", "created", "duplicates", F.size("errors").cast("long").alias("n_errors"))


@query("audit_log", "SELECT event_type AS source, count(*) AS found, count_if(value > 10) AS created, count_if(value <= 10) AS duplicates, array_to_string(list_slice(list(event_id::VARCHAR ORDER BY event_id), 1, 3), ',') AS raw_sample FROM events GROUP BY 1")
def audit_log(spark, sf_dir):
    log = rollups.audit_log(events(spark, sf_dir), "event_type", F.col("value") > 10, F.col("value") <= 10, F.col("event_id").cast("string"), "event_id")
    return log.withColumnRenamed("event_type", "source").withColumn("raw_sample", F.array_join("raw_sample", ","))


@query("date_labels", f"SELECT event_id, CASE {_DAY} WHEN '2024-01-13' THEN 'Today' WHEN '2024-01-14' THEN 'Tomorrow' ELSE strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%a, %b %-d') END AS relative, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%A, %B %-d, %Y, %-I:%M %p') AS whole, dayofweek((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::INTEGER AS weekday FROM events")
def date_labels(spark, sf_dir):
    at = F.col("ts")
    return events(spark, sf_dir).select("event_id", tm.relative_label(at, AS_OF).alias("relative"), tm.when_label(at, F.lit(None).cast("timestamp"), F.lit(False)).alias("whole"), tm.local_weekday(at).alias("weekday"))


@query("exact_dedupe", f"SELECT event_id, sha1(event_type || '|' || {_DAY} || '|' || trim(regexp_replace(lower(props), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts, event_id) = 1")
def exact_dedupe(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.select("event_id", "ts", dedupe.identity_hash(F.col("event_type"), tm.local_day(F.col("ts")), F.col("props")).alias("hash"))
    return dedupe.first_wins(rows, ["hash"], ["ts", "event_id"]).select("event_id", "hash")


@query("new_since_history", f"WITH h AS (SELECT event_id, ts, sha1(event_type || '|' || {_DAY} || '|' || trim(regexp_replace(lower(props), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM events) SELECT event_id, hash FROM h WHERE ts >= TIMESTAMP '2024-01-20' AND hash NOT IN (SELECT hash FROM h WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-19') QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts, event_id) = 1")
def new_since_history(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.select("event_id", "ts", dedupe.identity_hash(F.col("event_type"), tm.local_day(F.col("ts")), F.col("props")).alias("hash"))
    cut, back = F.lit(dt.datetime(2024, 1, 20)), F.lit(dt.datetime(2024, 1, 19))
    return dedupe.new_rows(rows.where(F.col("ts") >= cut), rows.where((F.col("ts") < cut) & (F.col("ts") >= back)), "hash", ["ts", "event_id"]).select("event_id", "hash")


@query("hash_pick", "SELECT page_id, (('0x' || substr(sha1(url), 33, 8))::BIGINT % 7 + ((('0x' || substr(sha1(url), 25, 8))::BIGINT % 7) * (4294967296 % 7)) % 7 + ((('0x' || substr(sha1(url), 17, 8))::BIGINT % 7) * ((4294967296 % 7) ** 2)::BIGINT) % 7 + ((('0x' || substr(sha1(url), 9, 8))::BIGINT % 7) * ((4294967296 % 7) ** 3)::BIGINT) % 7 + ((('0x' || substr(sha1(url), 1, 8))::BIGINT % 7) * ((4294967296 % 7) ** 4)::BIGINT) % 7) % 7 AS pick FROM pages")
def hash_pick(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tx.hash_mod(F.col("url"), 7).alias("pick"))
