import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract
from tidemark.sources import readers, sinks
from tidemark.streaming import ingest, rates

LD = '<script type="application/ld+json">%s</script>'


def records(html, **kw):
    return extract.page_records(html, "http://site/list/", **kw)


def test_json_ld_walk():
    graph = {"@graph": [{"@type": ["Thing", "MusicEvent"], "name": " Jazz ", "startDate": "2026-09-05T19:00", "location": {"name": "Hall", "address": {"streetAddress": "1 St", "addressLocality": "Town"}, "@type": "EventVenue"}, "offers": [{"price": "0"}], "url": "/j"}]}
    listed = {"itemListElement": [{"item": {"@type": "Event", "name": "Fair", "location": ["Park"], "offers": {"lowPrice": 5, "priceCurrency": "USD"}}}]}
    name, got, error = records(LD % json.dumps(graph) + LD % "{broken" + LD % json.dumps(listed))
    assert name == "json-ld" and error is None and [r["title"] for r in got] == ["Jazz", "Fair"]
    assert (got[0]["venue"], got[0]["address"], got[0]["price"], got[0]["source_url"]) == ("Hall", "1 St, Town", "Free", "http://site/j")
    assert (got[1]["venue"], got[1]["price"], got[1]["source_url"]) == ("Park", "$5", "http://site/list/")
    two = LD % ('{"@type":"Event","name":"A"} {"@type":"X","subEvent":{"@type":"Event","name":"B"}}')
    assert records(two)[0] is None and [r["title"] for r in records(two, strict=False)[1]] == ["A", "B"]


def test_microdata_and_heuristic():
    micro = '<div itemscope itemtype="https://schema.org/Event"><h2 itemprop="name">Fair</h2><time itemprop="startDate" datetime="2026-09-05"></time><a href="x">go</a></div>'
    name, got, _ = records(micro)
    assert name == "microdata" and (got[0]["title"], got[0]["date"], got[0]["source_url"]) == ("Fair", "2026-09-05", "http://site/list/x")
    entry = '<li class="event"><h3>Walk</h3> on Sept 5 <img src="i.png"></li><article class="my-event-card"><a href="/w">WALK</a></article><div class="x">Jan 5</div>'
    name, got, _ = records(entry)
    assert name == "heuristic" and [(r["title"], r["date"], r["image_url"]) for r in got] == [("Walk", "Sept 5", "http://site/list/i.png")]
    assert records("<p>none</p>") == (None, [], None) and records(None) == (None, [], None)


def test_extracted_keeps_hints_and_goes_on(spark):
    pages = spark.createDataFrame([(1, "http://a/", LD % '{"@type":"Event","name":"E"}', "s"), (2, "http://b/", None, "s"), (3, "http://c/", "<li class=event><a>T</a></li>" + "<div>" * 5000, "t")], "page_id int, url string, html string, source string")
    adapters = spark.createDataFrame([("s", "arts", None, True, None), ("t", "arts", "market", None, None)], "source string, default_category string, forced_category string, family boolean, tag string")
    got = [(r.page_id, r.title, r.category, r.is_family_friendly) for r in extract.extracted(pages, adapters).orderBy("page_id").collect()]
    assert got == [(1, "E", "arts", True), (3, "T", "market", None)]
    n = {r.page_id: r.n for r in extract.events_per_page(pages, extract.extracted(pages)).collect()}
    assert n == {1: 1, 2: 0, 3: 1}


def test_page_parts(spark):
    df = spark.createDataFrame([('<title>A &amp; B</title><script>x</script><img src="/logo.png"><img src="https://x.org/p.jpg"><a href="/1">one</a><a href="/1">o</a>',), ('<meta property="og:image" content="/og.jpg"><p>t',)], "h string")
    h = F.col("h")
    rows = df.select(extract.page_title(h).alias("t"), extract.page_text(h).alias("x"), extract.page_links(h).alias("l"), extract.page_image(h).alias("i")).collect()
    assert [tuple(r) for r in rows] == [("A & B", "A & B one o", ["/1"], "https://x.org/p.jpg"), (None, "t", [], "/og.jpg")]


def test_markdown_parsers(spark):
    pages = lambda md: spark.createDataFrame([(1, md)], "page_id int, md string")
    detail = r"^\*\*([A-Z][a-z]+ \d{1,2}, \d{4})\s*(?:\(([^)]*)\))?\*\*"
    got = extract.heading_details(pages("## Fair\n**May 2, 2026 (7 pm)** x\nProse\n## No\n\n"), detail, {"start": 1, "time": 2}).collect()
    assert [(r.title, r.start, r.time, r.description) for r in got] == [("Fair", "May 2, 2026", "7 pm", "Prose")]
    got = extract.heading_dates(pages("# Menu\nMay 1, 2026\n### Walk [x](http://a)\n\non May 3 we go\n## May 9\n")).collect()
    assert [(r.title, r.start, r.description) for r in got] == [("Walk x", "May 3", "on May 3 we go")]
    got = extract.dated_headers(pages("SatMay2\n* [Show](http://s)\n* 7 pm\nSunMay3\n* [Other](http://o)"), r"^(?:Sat|Sun)([A-Z][a-z]{2})(\d+)$", r"^\*\s*\[([^\]]+)\]\(([^)]+)\)$", {"title": 1, "url": 2}).orderBy("no").collect()
    assert [(r.header, r.title, r.next_line) for r in got] == [("SatMay2", "Show", "* 7 pm"), ("SunMay3", "Other", None)]
    got = extract.walked_back(pages("## Old\n## Title\n## [Hall](http://v)\nhttp://e/event/x-2026-05-02/\nhttp://e/event/x-2026-05-02/"), r"http://e/event/[a-z\-]+(\d{4}-\d{2}-\d{2})/", {"title": r"^##\s+([^\[].*)$", "venue": r"^##\s*\[(.+?)\]"}).collect()
    assert [(r.title, r.venue, r.url) for r in got] == [("Title", "Hall", "http://e/event/x-2026-05-02/")]
    link = r"\[([^\]]+)\]\((http://p/([a-z-]+)/(\d{4}-\d{2}-\d{2}))\)"
    got = extract.link_items(pages("[Wine WalkOld Hall](http://p/wine-walk/2026-05-02) [AbcdAbcd](http://p/zz/2026-05-03)"), link, {"head": 1, "slug": 3, "day": 4})
    got = got.orderBy("pos").select("day", extract.split_by_slug(F.col("head"), F.col("slug")).alias("s")).collect()
    assert [(r.day, r.s.title, r.s.venue) for r in got] == [("2026-05-02", "Wine Walk", "Old Hall"), ("2026-05-03", "Abcd", None)]
    got = extract.first_date(pages("Past Jan 1, 2020. Come on May 2, 2026 or May 9, 2026"), F.lit("T"), "2026-01-01", "2026-12-31", 2026).collect()
    assert [(r.title, r.day) for r in got] == [("T", "2026-05-02")]
    payload = '{"events":[{"title":"A &amp; B","start_date":"2026-05-02 10:00","venue":{"venue":"Hall","city":"Town"},"categories":[{"name":"Art"}]}]}'
    got = extract.api_records(spark.createDataFrame([(1, f"```{payload}```"), (2, "none")], "page_id int, md string"), F.col("md")).collect()
    assert [(r.title, r.venue, r.address, r.tags) for r in got] == [("A & B", "Hall", "Town", ["Art"])]


# --- sources and sinks -----------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    os.makedirs(tmp_path / "k/events")
    (tmp_path / "k/README.md").write_text("no")
    (tmp_path / "k/events/a.md").write_text("---\nkind: page\ntitle: A: b\n---\nBody")
    got = readers.documents_of(spark, str(tmp_path / "k")).collect()
    assert [(r.doc, r.fields, r.body) for r in got] == [("events/a.md", {"kind": "page", "title": "A: b"}, "Body")]
    (tmp_path / "a.json").write_text(json.dumps({"generated_at": "now", "events": [{"id": "1", "tags": ["x"]}]}))
    assert [tuple(r) for r in readers.archive(spark, str(tmp_path / "a.json"), "id:string,tags:array<string>").collect()] == [("now", "1", ["x"])]
    (tmp_path / "n.json").write_text('{"a":1}\nnot json\n{"a":2}\n{"a":')
    assert sorted(r.a for r in readers.ndjson(spark, str(tmp_path / "n.json"), "a int").collect()) == [1, 2]
    os.makedirs(tmp_path / "p")
    (tmp_path / "p/x.md").write_text("M")
    m = spark.createDataFrame([("x",), ("y",)], "key string")
    (tmp_path / "p/y.html").write_text("<p>")
    assert sorted((r.key, r.md, r.html) for r in readers.page_folder(spark, str(tmp_path / "p"), m).collect()) == [("x", "M", None), ("y", None, "<p>")]
    assert readers.or_else(m.limit(0), m).count() == 2 and readers.or_else(m, m.limit(0)).count() == 2


def test_worklist_and_rekeying(spark):
    src = spark.createDataFrame([("a", "http://a/{month}", None), ("b", "http://b/?p={page}", 2)], "source string, pattern string, pages int")
    urls = sorted(r.url for r in readers.worklist(spark, "2026-11-15", 3, src).collect())
    assert urls == ["http://a/2026-11", "http://a/2026-12", "http://a/2027-01", "http://b/?p=1", "http://b/?p=2"]
    got = spark.createDataFrame([(1, "HTTP://A/2026-11/", 200), (2, "http://a/2026-11", 500)], "ord int, url string, status int")
    want = spark.createDataFrame([("http://a/2026-11",), ("http://z",)], "url string")
    assert sorted(tuple(r) for r in readers.rekeyed(got, want).collect()) == [("http://a/2026-11", 200), ("http://z", None)]


def test_upsert_versions_and_months(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, no int")
    out = sinks.upserted(old.withColumn("no", F.lit(0)), new, "k", ["no"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    path = sinks.write_version(old, str(tmp_path / "t"), 1)
    again = sinks.write_version(sinks.upserted(spark.read.parquet(path), new.drop("no").limit(1), "k"), str(tmp_path / "t"), 2)
    assert spark.read.parquet(again).count() == 2
    ev = spark.createDataFrame([(i, dt.datetime(2026, 1 + i % 3, 5)) for i in range(9)], "id int, at timestamp")
    readers.indexed_by_month(ev, "at", str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_dir()) == ["month=2026-01", "month=2026-02", "month=2026-03"]
    assert spark.read.parquet(str(tmp_path / "m")).count() == 9


def test_calendar_and_pages(spark):
    df = spark.createDataFrame([("1", dt.datetime(2026, 1, 2, 3), None, "A, b; c\\", "l1\nl2")], "id string, s timestamp, e timestamp, t string, d string")
    none = F.lit(None).cast("string")
    text = df.select(sinks.calendar_entry(F.col("id"), F.col("s"), F.col("e"), F.col("t"), F.col("d"), F.lit("H"), none, dt.datetime(2026, 1, 1))).first()[0]
    assert "SUMMARY:A\\, b\\; c\\\\\r\nDESCRIPTION:l1\\nl2\r\nLOCATION:H\r\nEND:VEVENT" in text and "DTEND:20260102T050000Z" in text and "URL" not in text
    rows = spark.range(250)
    assert [(n, d.count()) for n, d in (sinks.page(rows, ["id"], k) for k in (None, 500, 7, -240))] == [(250, 100), (250, 200), (250, 7), (250, 10)]
    pages = spark.createDataFrame([("a", 200, "S", "u", "c", "x" * 200), ("b", 404, "S", "u", "c", "x" * 300), ("c", 200, "Bad", "u", "c", "x" * 300), ("d", 200, "S", "u", "c", "x")], "key string, status int, source string, url string, crawled string, md string")
    out = sinks.exported_pages(pages, ("Bad",)).collect()
    assert [r.key for r in out] == ["a"] and out[0].text.startswith("---\nkind: page\nsource: S\n")
    assert sinks.report([("By month", "| Month | n |", spark.createDataFrame([("2026-01", 2)], "m string, n int"))]).splitlines()[2:] == ["| Month | n |", "|---|---|", "| 2026-01 | 2 |"]
    assert [r.value for r in sinks.ndjson_lines(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']


# --- streams ----------------------------------------------------------------------------------------------


def plain_limits(hits, limit, window):
    seen, out = {}, {}
    for k, t, i in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        recent = [x for x in seen.get(k, []) if (t - x).total_seconds() < window]
        out[i] = len(recent) < limit
        seen[k] = recent + [t] * out[i]
    return out


@pytest.fixture(scope="module")
def hits():
    import random

    rnd = random.Random(6)
    base = dt.datetime(2026, 1, 1)
    return [(rnd.choice("abc"), base + dt.timedelta(seconds=rnd.randint(0, 600)), i) for i in range(400)]


def test_rate_limits(spark, hits):
    df = spark.createDataFrame(hits, "k string, t timestamp, i int")
    got = {r.id: r.accepted for r in rates.rate_limited(df, "k", "t", "i", 5, 60).collect()}
    assert got == plain_limits(hits, 5, 60) and set(got.values()) == {True, False}
    assert rates.rate_limited(df.limit(0), "k", "t", "i").collect() == []


def test_rate_limits_of_the_table(spark, sf_dir):
    from tidemark.plans import registry
    from tidemark.sources import load

    rows = [(r.user_id, r.ts, r.event_id) for r in load(spark, sf_dir, "events").collect()]
    assert {r.id: r.accepted for r in registry.QUERIES["rate_limited"](spark, sf_dir).collect()} == plain_limits(rows, 3, 600)


def test_rate_limit_stream(spark, hits, tmp_path):
    src, cut = str(tmp_path / "in"), 200
    ordered = sorted(hits, key=lambda h: h[1])
    for part in (ordered[:cut], ordered[cut:]):
        spark.createDataFrame(part, "k string, t timestamp, i int").coalesce(1).write.mode("append").parquet(src)
    files = sorted(os.listdir(src))
    assert files
    stream = spark.readStream.schema("k string, t timestamp, i int").parquet(src)
    q = rates.rate_limited_stream(stream, "k", "t", "i", 5, 60).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.accepted for r in spark.sql("SELECT * FROM limits").collect()} == plain_limits(hits, 5, 60)


def test_incremental_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ord int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(src)
    ingest.append_new(spark.readStream.schema(schema).parquet(src), out, "k", ["ord"], str(tmp_path / "ck")).awaitTermination(120)
    spark.createDataFrame([("b", 4), ("c", 5)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.append_new(spark.readStream.schema(schema).parquet(src), out, "k", ["ord"], str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.k, r.ord) for r in spark.read.schema(schema).parquet(out).collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_windowed_counts(spark, hits, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(hits, "k string, t timestamp, i int").write.parquet(src)
    stream = spark.readStream.schema("k string, t timestamp, i int").parquet(src)
    q = ingest.windowed_counts(stream, "t", "k", "5 minutes", "0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.sql("SELECT * FROM counts").collect()) == len(hits)
