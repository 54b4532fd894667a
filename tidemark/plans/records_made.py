"""Queries of the extraction, normalisation and document operators, over records made from the dimension and fact tables.

The tables hold no crawled listings, so texts are composed of their columns; the oracles say what the operators must get back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.operators import documents, extract, listing, lookups, moderation, normalize, search
from tidemark.plans.registry import query
from tidemark.sources import load, readers, sinks

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_MONTH_NAME = "strftime(o_orderdate, '%B')"


def orders(spark, sf_dir):
    return load(spark, sf_dir, "orders")


_CLERK = "('K' || o_custkey)"
_PHONE = "('Nr ' || s_nationkey)"


def clerk():
    return F.concat(F.lit("K"), F.col("o_custkey").cast("string"))


def phone():
    return F.concat(F.lit("Nr "), F.col("s_nationkey").cast("string"))


def day_text(c, form):
    return F.date_format(c, form)


@query("front_matter_fields", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'Body of ' || c_name END AS body FROM customer")
def front_matter_fields(spark, sf_dir):
    """Fields and body of documents, some without front matter; of a repeated key the last counts."""
    c = load(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("---\r\nsegment: old\nsegment: "), "c_mktsegment", F.lit("\nurl: https://x.org:80/a\n---\nBody of "), "c_name"))
    fm = c.select("c_custkey", documents.front_matter(text).alias("fm"))
    return fm.select("c_custkey", F.col("fm.fields")["segment"].alias("segment"), F.col("fm.body").alias("body"))


@query("digest_sections", f"SELECT s_suppkey, unnest([1, 2]) AS part, s_name || unnest([' one', ' two']) AS title, s_suppkey || unnest(['-a', '-c']) AS id, unnest([{_PHONE}, NULL]) AS venue, unnest(['', 'Some words of ' || s_name]) AS words FROM supplier")
def digest_sections(spark, sf_dir):
    """Sections of digests; a section without an id is left out, of a repeated key the last counts."""
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("Intro\n## "), "s_name", F.lit(" one\n\n- id: "), key, F.lit("-a\n- venue: first\n- venue: "), phone(), F.lit("\n\n(no description)\n\n## No id\n\n- venue: x\n\ntext\n\n## "), "s_name", F.lit(" two\n\n- id: "), key, F.lit("-c\n- venue: \n\nSome words of "), "s_name", F.lit("\n"))
    rows = documents.sections(load(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body")))
    part = F.when(F.col("fields")["id"].endswith("-a"), 1).otherwise(2)
    return rows.select("s_suppkey", part.alias("part"), "title", F.col("fields")["id"].alias("id"), F.col("fields")["venue"].alias("venue"), F.col("text").alias("words"))


@query("section_round_trip", "SELECT c_custkey::VARCHAR AS id, c_name AS title, 'N' || c_nationkey AS venue, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS words FROM customer")
def section_round_trip(spark, sf_dir):
    """Rows as digest sections, read back."""
    c = load(spark, sf_dir, "customer")
    text = documents.section_text(F.col("c_name"), {"id": F.col("c_custkey"), "venue": F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))}, F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    rows = documents.sections(c.select(text.alias("body")))
    return rows.select(F.col("fields")["id"].alias("id"), "title", F.col("fields")["venue"].alias("venue"), F.col("text").alias("words"))


@query("event_chunks", "SELECT event_id::VARCHAR AS id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS date, CASE WHEN user_id % 3 = 0 THEN 'Dale' WHEN user_id % 3 = 1 THEN 'Port Ash' WHEN user_id % 5 = 0 THEN 'Dale' END AS city, user_id % 5 = 0 AS all_day, '/events/' || event_id AS link, trim(regexp_replace(event_type || ' ' || props, '\\s+', ' ', 'g')) AS words FROM events")
def event_chunks(spark, sf_dir):
    """Events as chunks, their cities by address, venue or tag."""
    u = F.col("user_id")
    ev = load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.lit("s").alias("source_name"), F.lit(None).cast("string").alias("source_url"), F.col("event_type").alias("title"), F.col("ts").alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"), F.when(u % 5 == 0, F.array(F.lit("all-day"), F.lit("home"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(u % 3 == 1, "Hall of PORT ASH").alias("venue"), F.when(u % 3 == 0, "1 Main St, dale").alias("address"), F.lit("other").alias("category"), F.lit(None).cast("string").alias("price"),
        F.lit(None).cast("boolean").alias("is_free"), F.lit(None).cast("boolean").alias("is_family_friendly"), F.lit(None).cast("string").alias("slug"), F.concat_ws("\n", "event_type", "props").alias("description"),
    )
    return documents.event_chunks(ev, F.lit("live"), ("Dale", "Port Ash"), "home").select("id", "date", "city", "all_day", "link", F.col("text").alias("words"))


@query("live_chunks", "SELECT 'e' || doc_id AS id, 'event' AS kind FROM documents WHERE lang = 'en' UNION ALL SELECT 'b' || doc_id, 'page' FROM documents WHERE n_chars < 500")
def live_chunks(spark, sf_dir):
    """Chunks of live events with the bundled pages."""
    d = load(spark, sf_dir, "documents")
    id_ = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("id")
    events = d.where("lang = 'en'").select(id_("e"), F.lit("event").alias("kind"), F.lit("x").alias("link"))
    bundled = d.select(id_("b"), F.when(F.col("n_chars") < 500, "page").otherwise("event").alias("kind"))
    return documents.live_chunks(events, bundled).select("id", "kind")


@query("page_meta", "SELECT doc_id, substr(text, 1, 160) AS description FROM documents")
def page_meta(spark, sf_dir):
    """F-PAGE: descriptions of pages' metadata."""
    return load(spark, sf_dir, "documents").select("doc_id", tx.page_description(F.col("text")).alias("description"))


@query(
    "parsed_pages",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'generic' ELSE 'spans' END AS method, 'Order ' || o_orderkey AS title, {_MONTH_NAME} || ' ' || day(o_orderdate) || CASE WHEN o_orderkey % 3 = 1 OR year(o_orderdate) >= 2000 THEN ', ' || year(o_orderdate) ELSE '' END AS start, CASE WHEN o_orderkey % 3 = 1 THEN {_MONTH_NAME} || ' 28, ' || year(o_orderdate) END AS end_, 'Clerk ' || {_CLERK} AS description, o_orderpriority AS source FROM orders WHERE o_orderkey % 3 < 2 AND o_orderstatus <> 'P' AND (o_orderkey % 3 = 0 OR day(o_orderdate) < 28)",
)
def parsed_pages(spark, sf_dir):
    """Pages go to the parser that they name, spans inherit month and year; the rest gives nothing."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    head = F.concat(F.lit("# x\n## Order "), F.col("o_orderkey").cast("string"), F.lit("\n"))
    body = F.when(k == 0, F.concat(head, F.lit("\n"), day_text(d, "MMMM d, yyyy"), F.lit("\nClerk "), clerk())).when(
        F.dayofmonth(d) < 28, F.concat(head, F.lit("## "), day_text(d, "MMMM d"), F.lit(" – 28, "), day_text(d, "yyyy"), F.lit("\nClerk "), clerk())
    )
    pages = orders(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), F.element_at(F.array(F.lit("generic"), F.lit("spans"), F.lit("none")), (k + 1).cast("int")).alias("parser"), (F.col("o_orderstatus") != "P").alias("ok"), body.alias("md"), F.col("o_orderpriority").alias("source"))
    rows = extract.dispatched(pages)
    # the generic parser takes years from 2000 on only, and the line that holds the date is its prose
    said = F.when(F.col("method") == "generic", F.concat(F.lit("Clerk "), clerk())).otherwise(F.col("description"))
    clerks = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    return rows.join(clerks, F.col("page_id") == F.col("o_orderkey")).select("o_orderkey", "method", "title", "start", F.col("end").alias("end_"), said.alias("description"), "source")


@query("page_counts", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id % 3 END::BIGINT AS n FROM pages")
def page_counts(spark, sf_dir):
    """Records of every page, none included."""
    p = load(spark, sf_dir, "pages").select("page_id")
    records = p.withColumn("title", F.explode(F.filter(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda i: i > 0)))
    return extract.events_per_page(p, records)



@query("page_images", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.org/og' || page_id WHEN 1 THEN 'https://x.org/turned' || page_id ELSE 'https://x.org/' || page_id || '.webp?x=1' END AS image FROM pages")
def page_images(spark, sf_dir):
    """P25: a page's own picture unless it is noise, else its first image file."""
    key = F.col("page_id").cast("string")
    images = F.concat(F.lit('<img src="/a.jpg"><img src="https://x.org/logo.png"><img src="https://x.org/'), key, F.lit('.webp?x=1">'))
    own = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<meta property='og:image' content='https://x.org/og"), key, F.lit("'>"))).when(
        F.col("page_id") % 4 == 1, F.concat(F.lit('<meta content="https://x.org/turned'), key, F.lit('" property="og:image">'))
    )
    noisy = F.when(F.col("page_id") % 4 == 2, F.lit('<meta property="og:image" content="https://x.org/logo.png">')).otherwise(F.lit(""))
    return load(spark, sf_dir, "pages").select("page_id", extract.page_image(F.concat(F.coalesce(own, noisy), images)).alias("image"))


@query("related_by_source", "WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 > 0 THEN source END AS g FROM documents), own AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY n_chars, doc_id) AS r FROM d WHERE g IS NOT NULL), every AS (SELECT NULL AS g, doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM d), h AS (SELECT * FROM own WHERE r <= 4 UNION ALL SELECT * FROM every WHERE r <= 4) SELECT d.doc_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY h.r)::INTEGER AS rank, h.doc_id AS related_id FROM d JOIN h ON d.g IS NOT DISTINCT FROM h.g AND d.doc_id <> h.doc_id QUALIFY rank <= 3")
def related_by_source(spark, sf_dir):
    """J16 with rows that have no category: those get the first of all."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("g"))
    return listing.related(d, "doc_id", "g", ["n_chars", "doc_id"])


@query("start_times", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN {_DAY} || CASE o_orderkey % 4 WHEN 0 THEN 'T19:30:00' WHEN 1 THEN 'T00:05:00' ELSE 'T12:00:00' END || CASE WHEN month(o_orderdate) BETWEEN 3 AND 11 THEN '-07:00' ELSE '-08:00' END END AS iso, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 < 2 END AS had_time FROM orders")
def start_times(spark, sf_dir):
    """F-ISO, F-TIME, F-DATE, F-COMB: instants of dates and times as listings say them."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("Sat., "), day_text(d, "MMM d, yyyy"))).when(k == 1, day_text(d, "M/d/yyyy")).when(k == 2, day_text(d, "yyyy-MM-dd")).otherwise("soon")
    time = F.when(k == 0, "from 7:30 p.m.").when(k == 1, "12:05 AM")
    at = orders(spark, sf_dir).select("o_orderkey", tm.iso_start(said, time, 2024, "month").alias("at"))
    return at.select("o_orderkey", F.col("at.iso").alias("iso"), F.col("at.had_time").alias("had_time"))


@query("places", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Dale' WHEN 1 THEN 'Port Ash' WHEN 2 THEN 'Dale' WHEN 3 THEN 'Farmouth' END AS city, CASE c_custkey % 5 WHEN 0 THEN 'Dale' WHEN 1 THEN 'nearby' WHEN 2 THEN 'Dale' WHEN 3 THEN 'out-of-area' WHEN 4 THEN 'here' END AS region FROM customer")
def places(spark, sf_dir):
    """F-GEO: city and region by the strongest sign."""
    region = normalize.Region("Dale", ("Old Mill",), ("Port Ash",), ("Farmouth",), (), (("own", "here"),), "nearby")
    k, none = F.col("c_custkey") % 5, F.lit(None).cast("string")
    address = F.when(k == 0, "5 Elm, DALE").when(k == 1, "2 Quay, port ash")
    city = region.city(address, F.when(k == 2, "the old mill"), none, F.when(k == 3, "Fair of Farmouth").otherwise("Fair"), F.lit("words"), F.lit("own"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", city.alias("city"))
    return rows.withColumn("region", region.region(F.col("city"), F.lit("own")))


@query("clean_fields", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || ' and more' END AS description FROM part")
def clean_fields(spark, sf_dir):
    """F-TITLE, F-JUNK: titles without markdown, descriptions that say something."""
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 4 == 0, "## ab").otherwise(F.concat(F.lit("## ["), name, F.lit("](https://x.org/a)")))
    words = F.when(k % 3 == 0, "Event Details").otherwise(F.concat(F.lit("<p>"), name, F.lit("&nbsp;and  more</p>")))
    return load(spark, sf_dir, "part").select("p_partkey", normalize.clean_title(title).alias("title"), normalize.clean_description(words).alias("description"))


@query("filled_images", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'own' || p_partkey WHEN 1 THEN 'page' || p_partkey WHEN 2 THEN 'list' || p_partkey ELSE 'stock' END AS image, CASE p_partkey % 4 WHEN 0 THEN 'listing' WHEN 1 THEN 'event-page' WHEN 2 THEN 'listing' ELSE 'category-stock' END AS source FROM part")
def filled_images(spark, sf_dir):
    """Images by the event itself, its page, its listing, or from stock."""
    p = load(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    ev = p.select("p_partkey", key.alias("id"), F.lit("s").alias("source_name"), F.concat(F.lit("Part "), key).alias("title"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("own"), key)).otherwise("").alias("image_url"))
    by_id = p.where("p_partkey % 4 = 1").select(key.alias("id"), F.concat(F.lit("page"), key).alias("image"))
    by_title = p.where("p_partkey % 4 = 2").select(F.lit("s").alias("source"), F.concat(F.lit("part"), key).alias("key"), F.concat(F.lit("list"), key).alias("image"))
    return normalize.filled_images(ev, by_id, by_title, ["stock"]).select("p_partkey", F.col("image_url").alias("image"), F.col("image_source").alias("source"))


@query("addresses", f"SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Dale, CA' WHEN 1 THEN '1 Elm, dale' WHEN 2 THEN {_PHONE} || ', Dale, CA' ELSE {_PHONE} END AS address FROM supplier")
def addresses(spark, sf_dir):
    """Addresses with their city."""
    k = F.col("s_suppkey") % 4
    address = F.when(k == 0, "").when(k == 1, "1 Elm, dale").otherwise(phone())
    return load(spark, sf_dir, "supplier").select("s_suppkey", documents.completed_address(address, F.when(k < 3, "Dale")).alias("address"))


@query("tags_marked", "SELECT event_id, CASE WHEN value > 10 THEN event_type || ',all-day' ELSE event_type END AS tags, event_type AS shown, value > 10 AS all_day FROM events")
def tags_marked(spark, sf_dir):
    """P20, D8, F-TAGS: the marker goes to the end once, and is not shown."""
    rows = load(spark, sf_dir, "events").select("event_id", listing.with_tag(F.array(F.lit("all-day"), "event_type"), "all-day", F.col("value") > 10).alias("tags"))
    return rows.select("event_id", F.array_join("tags", ",").alias("tags"), F.array_join(listing.visible_tags(F.col("tags")), ",").alias("shown"), listing.has_tag(F.col("tags")).alias("all_day"))


@query("query_strings", "SELECT doc_id, concat_ws('&', 'lang=' || nullif(lang, ''), 'source=' || nullif(source, '')) AS q, 'https://x.org/' || doc_id || ',https://x.org/b' AS links FROM documents")
def query_strings(spark, sf_dir):
    """F-QS, F-LINKS: addresses from and to texts."""
    url = F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string"))
    md = F.concat(F.lit("see [a]("), url, F.lit(") and ![i](/x.png) [b](https://x.org/b)"))
    return load(spark, sf_dir, "documents").select("doc_id", tx.query_string(lang=F.col("lang"), source=F.col("source")).alias("q"), F.array_join(tx.markdown_links(md, "https://"), ",").alias("links"))


@query("search_params", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1996-03-01' AND o_orderdate::DATE <= DATE '1996-04-15' AND o_orderpriority = '5-LOW' AND o_totalprice > 100000")
def search_params(spark, sf_dir):
    """A request as it comes, checked, as a predicate."""
    p = search.SearchParams.checked({"from": "1996-03-01", "to": " 1996-04-15 ", "city": "nowhere", "category": "5-LOW", "free": True, "family": "yes", "limit": 1e9})
    rows = orders(spark, sf_dir).select("o_orderkey", day_text(F.col("o_orderdate"), "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("end_date"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_totalprice") > 100000, True).alias("is_free"))
    return rows.where(p.predicate()).select("o_orderkey")


@query("result_lines", f"SELECT s_suppkey, '[' || s_suppkey || '] ' || s_name || chr(10) || '    when: 2024-05-01' || chr(10) || '    where: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Hall, ' || {_PHONE} ELSE 'Dale' END || chr(10) || '    arts · ' || CASE WHEN s_suppkey % 3 = 0 THEN 'free' ELSE 'price not listed' END || chr(10) || '    link: /events/x' || chr(10) || '    source: s (https://x.org)' || chr(10) || '    some words' AS line FROM supplier")
def result_lines(spark, sf_dir):
    """Hits as an answer shows them."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rows = load(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("title"), F.lit("event").alias("kind"), F.when(k % 2 == 0, "Hall").alias("venue"), F.when(k % 2 == 0, phone()).alias("address"), F.lit("Dale").alias("city"),
        (k % 3 == 0).alias("is_free"), none.alias("price"), F.lit(None).cast("boolean").alias("is_family_friendly"), F.lit("arts").alias("category"), F.lit("2024-05-01").alias("date"), none.alias("end_date"),
        F.lit("/events/x").alias("link"), F.lit("s").alias("source"), F.lit("https://x.org").alias("url"), F.lit("some  words").alias("text"),
    )
    return rows.select("s_suppkey", search.result_text(k).alias("line"))


@query("answer_sources", "WITH a AS (SELECT DISTINCT o_custkey AS answer_id FROM orders), l AS (SELECT l.* FROM (SELECT o_custkey AS answer_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) l) SELECT answer_id, '/o/' || o_orderkey AS link, r::INTEGER AS pos FROM l WHERE r <= CASE WHEN answer_id % 2 = 0 THEN 8 ELSE 6 END")
def answer_sources(spark, sf_dir):
    """What an answer links to, in order of mention; else its first events."""
    o = orders(spark, sf_dir)
    link = F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string"))
    chunks = o.select(F.col("o_custkey").alias("answer_id"), link.alias("link"), F.lit("event").alias("kind"), F.col("o_orderkey").alias("ord"))
    said = o.groupBy(F.col("o_custkey").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", link.alias("link")))).alias("l"))
    said = said.withColumn("links", F.when(F.col("answer_id") % 2 == 0, F.concat(F.transform("l", lambda x: x["link"]), F.array(F.lit("/o/none"), F.get("l", F.lit(0))["link"]))).otherwise(F.array().cast("array<string>")))
    return lookups.answer_sources(said.select("answer_id", "links"), chunks, F.col("links"))


@query("published_rows", f"SELECT o_orderkey AS id, {_DAY} || CASE WHEN o_orderkey % 2 = 0 THEN 'T09:15:00' ELSE 'T18:00:00' END || CASE WHEN month(o_orderdate) BETWEEN 3 AND 11 THEN '-07:00' ELSE '-08:00' END AS start_at, 'order-' || o_orderkey AS slug, o_orderkey % 3 = 0 AS is_free FROM orders WHERE o_orderstatus = 'P'")
def published_rows(spark, sf_dir):
    """Accepted submissions as events."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    rows = orders(spark, sf_dir).select(
        k.alias("id"), F.concat(F.lit("Order "), k.cast("string")).alias("title"), none.alias("description"), day_text(F.col("o_orderdate"), "yyyy-MM-dd").alias("event_date"), F.when(k % 2 == 0, "09:15").alias("start_time"),
        none.alias("end_time"), none.alias("venue"), none.alias("address"), none.alias("category"), F.when(k % 3 == 0, "Free entry").alias("price"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"),
    )
    return moderation.published(rows).select("id", "start_at", "slug", "is_free")


@query("namespaced_rows", "SELECT n_nationkey, 'crawl-' || lower(n_name) AS slug FROM nation")
def namespaced_rows(spark, sf_dir):
    """Slugs in a namespace of their own."""
    return moderation.namespaced(load(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("slug")), "crawl-")


@query("image_worklist", f"SELECT {_CLERK} AS source_url, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 > 0 GROUP BY 1")
def image_worklist(spark, sf_dir):
    """Pages to visit for pictures."""
    k = F.col("o_orderkey")
    rows = orders(spark, sf_dir).select(k.alias("id"), F.col("o_orderpriority").alias("source_name"), F.when(k % 3 == 0, "x.png").when(k % 3 == 1, "").alias("image_url"), clerk().alias("source_url"))
    return moderation.image_work(rows, ("1-URGENT", "2-HIGH")).select("source_url", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("worklist_urls", "SELECT n_name AS source, 'https://' || n_nationkey || '.org/' || m || '?p=' || p AS url FROM nation, (SELECT unnest(['2026-11', '2026-12', '2027-01']) AS m), (SELECT unnest([1, 2]) AS p)")
def worklist_urls(spark, sf_dir):
    """Addresses to crawl, by source, month ahead and page."""
    sources = load(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("https://"), F.col("n_nationkey").cast("string"), F.lit(".org/{month}?p={page}")).alias("pattern"), F.lit(2).alias("pages"))
    return readers.worklist(spark, "2026-11-15", 3, sources).select("source", "url")


@query("exported_pages", "SELECT page_id AS key, '---' || chr(10) || 'kind: page' || chr(10) || 'source: ' || page_id % 3 || chr(10) || 'url: ' || url || chr(10) || 'crawled: ' || chr(10) || '---' || chr(10) || chr(10) || html AS words FROM pages WHERE page_id % 5 > 0 AND page_id % 3 > 0 AND length(html) >= 200")
def exported_pages(spark, sf_dir):
    """Crawled pages for the document folder."""
    k = F.col("page_id")
    p = load(spark, sf_dir, "pages").select(k.alias("key"), F.when(k % 5 > 0, 200).otherwise(404).alias("status"), (k % 3).cast("string").alias("source"), "url", F.lit(None).cast("string").alias("crawled"), F.col("html").alias("md"))
    return sinks.exported_pages(p, ("0",)).select("key", F.col("text").alias("words"))


@query("model_rows", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS category FROM events WHERE event_id % 4 > 0")
def model_rows(spark, sf_dir):
    """Rows that a model has made, checked."""
    rows = load(spark, sf_dir, "events").select("event_id", F.lit(" t ").alias("title"), F.when(F.col("event_id") % 4 > 0, "2024-01-05T10:00:00").otherwise("next week").alias("start_at"), F.lit(None).cast("string").alias("end_at"), F.col("event_type").alias("category"), F.lit(None).cast("array<string>").alias("tags"))
    return normalize.checked_model_rows(rows, ("view", "click")).select("event_id", "category")


@query("inferred_records", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_free, o_orderkey % 5 = 0 AS family, CASE WHEN o_orderkey % 3 = 0 THEN 'Free' END AS price FROM orders WHERE o_orderkey % 7 > 0")
def inferred_records(spark, sf_dir):
    """Records of the ingest, price and family by their words; no title or date, no record."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    raw = orders(spark, sf_dir).select(
        k.cast("string").alias("source_url"), F.lit("A title").alias("title"), F.concat(F.lit("words "), F.when(k % 3 == 0, "gluten-free ").otherwise(""), F.when(k % 5 == 0, "for kids").otherwise("")).alias("description"),
        none.alias("start_time"), F.when(k % 7 > 0, day_text(F.col("o_orderdate"), "yyyy-MM-dd")).otherwise("soon").alias("date"), none.alias("end_time"), none.alias("venue"), none.alias("address"),
        none.alias("category"), none.alias("price"), F.lit(None).cast("boolean").alias("is_family_friendly"), none.alias("image_url"),
    )
    return normalize.heuristic(raw).select(F.col("source_url").cast("long").alias("o_orderkey"), "is_free", F.col("is_family_friendly").alias("family"), "price")


@query("slug_splits", "SELECT c_custkey, c_name AS title, c_mktsegment AS venue FROM customer")
def slug_splits(spark, sf_dir):
    """X11: title and venue of a text that runs both together, by the address's slug."""
    parts = extract.split_by_slug(F.concat("c_name", F.lit(" "), "c_mktsegment"), tx.slug(F.col("c_name"), None))
    return load(spark, sf_dir, "customer").select("c_custkey", parts.alias("p")).select("c_custkey", "p.*")


@query("day_pages", f"SELECT o_orderkey, strftime(o_orderdate, '%A, %B %-d') AS header, lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') AS time, {_CLERK} AS title FROM orders")
def day_pages(spark, sf_dir):
    """Items below headers that carry the day forward."""
    d = F.col("o_orderdate")
    md = F.concat(F.lit("intro\n### "), day_text(d, "EEEE, MMMM d"), F.lit("\n\n* "), F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0"), F.lit(" pm "), clerk(), F.lit("\ntext"))
    rows = extract.dated_headers(orders(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), md.alias("md")), r"^### ", r"^\* (\d+) pm (.+)$", {"time": 1, "title": 2})
    return rows.select(F.col("page_id").alias("o_orderkey"), F.substring("header", 5, 100).alias("header"), "time", "title")


@query("walked_links", "SELECT s_suppkey, 'https://x.org/e/' || s_suppkey AS url, s_name AS title FROM supplier")
def walked_links(spark, sf_dir):
    """The nearest title above each address."""
    key = F.col("s_suppkey").cast("string")
    md = F.concat(F.lit("## Other\n## "), "s_name", F.lit("\nwords\n[more](https://x.org/e/"), key, F.lit(")\n## Later\n[more](https://x.org/e/"), key, F.lit(")"))
    rows = extract.walked_back(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), md.alias("md")), r"https://x\.org/e/\d+", {"title": r"^## (.+)$"})
    return rows.select(F.col("page_id").alias("s_suppkey"), "url", "title")


@query("today_label", "SELECT event_id, CASE WHEN d = DATE '2024-01-13' THEN 'Today' WHEN d = DATE '2024-01-14' THEN 'Tomorrow' ELSE strftime(d, '%a, %b %-d') END AS label FROM (SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS d FROM events)")
def today_label(spark, sf_dir):
    """F-REL: days as a listing says them."""
    return load(spark, sf_dir, "events").select("event_id", tm.relative_label(F.col("ts"), dt.datetime(2024, 1, 13, 20)).alias("label"))
