import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedupe, documents, listing, lookups, moderation, normalize, rollups, search


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# --- listing ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def listings(spark):
    at = dt.datetime(2026, 9, 5, 17)
    rows = [
        (1, at, "music", "approved", None, True, None, "Hall", "1 Main St, Town", "Jazz night", "trio", ["late", "all-day"], "a-1"),
        (2, at + dt.timedelta(days=1), "arts", "approved", None, False, True, None, None, "Paint", None, None, "b-2"),
        (3, at, "arts", "approved", 1, None, None, "Hall", None, "Jazz copy", None, [], "c-3"),
        (4, at - dt.timedelta(hours=4), "arts", "pending", None, None, None, None, "Elsewhere", "Old", None, ["jazz"], "d-4"),
    ]
    return spark.createDataFrame(rows, "id int, start_at timestamp, category string, status string, duplicate_of int, is_free boolean, is_family_friendly boolean, venue string, address string, title string, description string, tags array<string>, slug string")


def test_filters(listings):
    ids = lambda df: sorted(r.id for r in df.collect())
    ask = lambda **kw: ids(listing.filtered(listings, listing.EventFilters(**kw)))
    assert ids(listing.visible(listings)) == [1, 2] and ids(listing.public(listings)) == [1, 2, 3]
    assert ask(category="arts") == [2, 3, 4] and ask(free=True) == [1] and ask(family=True) == [2]
    assert ask(location="MAIN st") == [1] and ask(location="hall") == [1, 3]
    assert ask(search="jazz") == [1, 3, 4]
    assert ask(search="all-day") == []  # markers are not searched
    assert ask() == [1, 2, 3, 4]
    # a date-only upper bound is midnight, so most of that day is out
    assert ask(end=dt.datetime(2026, 9, 5)) == [] and ask(start=dt.datetime(2026, 9, 5, 17), end=dt.datetime(2026, 9, 5, 17)) == [1, 3]
    now = dt.datetime(2026, 9, 5, 18)
    assert ids(listing.upcoming(listings, now)) == [1, 2, 3]
    assert ids(listing.today(listings, now)) == [1, 3, 4] and ids(listing.weekend(listings, now)) == [1, 2, 3, 4]
    assert ids(listing.on_days(listings, [])) == []
    assert ids(listing.by_id_or_slug(listings, "b-2")) == [2]


def test_days_months_and_related(spark, listings):
    days = listing.by_day(listings, "id").orderBy("day").collect()
    assert [(r.day, [x.id for x in r["items"]]) for r in days] == [("2026-09-05", [4, 1, 3]), ("2026-09-06", [2])]
    nav = lambda asked, current: tuple(listing.month_nav(months, F.col("m"), asked, current).first())
    months = spark.createDataFrame([("2026-01",), ("2026-03",), ("2026-03",), ("2026-07",)], "m string")
    assert nav("2026-03", "2026-07") == ("2026-03", 2, "2026-01", "2026-07") and nav("2026-02", "2026-07") == ("2026-07", 1, "2026-03", None)
    assert nav(None, "2025-01") == ("2026-01", 1, None, "2026-03")
    rel = listing.related(listings, "id", "category", ["start_at", "id"], 1)
    assert rows_of(rel) == [(2, 1, 4), (3, 1, 4), (4, 1, 3)]
    tags = listings.select("id", listing.with_tag(F.col("tags"), "all-day", F.col("id") == 2).alias("t"), listing.has_tag(F.col("tags")).alias("h")).orderBy("id").collect()
    assert [r.t for r in tags] == [["late"], ["all-day"], [], ["jazz"]] and [r.h for r in tags] == [True, False, False, False]


def test_overlap(spark):
    df = spark.createDataFrame([(1, "2026-01-01", None), (2, "2026-01-01", "2026-01-05"), (3, None, "2026-01-05"), (4, "2026-02-01", None)], "id int, a string, b string")
    ask = lambda *x: [r.id for r in df.where(listing.overlapping(F.col("a"), F.col("b"), *x)).orderBy("id").collect()]
    assert ask("2026-01-03", "2026-01-04") == [2] and ask(None, "2026-01-01") == [1, 2] and ask("2026-01-05", None) == [2, 4] and ask(None, None) == [1, 2, 4]


# --- lookups and rollups ----------------------------------------------------------------------------


def test_lookups(spark):
    f = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, k string")
    d = spark.createDataFrame([("a", "Alpha"), ("other", "Other")], "k string, name string")
    assert rows_of(lookups.with_name(f, d, "k", "k", name="name"), "id", "name") == [(1, "Alpha"), (2, None), (3, None)]
    assert rows_of(lookups.with_default(f, d, "k", "k", "other", name="name"), "id", "name") == [(1, "Alpha"), (2, "Other"), (3, "Other")]
    assert rows_of(lookups.unmatched(f, d, "k", "k"), "id") == [(2,), (3,)]


def test_answer_sources(spark):
    answers = spark.createDataFrame([(1, "see [a](/events/2) and [b](/events/1), [a](/events/2)"), (2, "no links")], "answer_id int, text string")
    chunks = spark.createDataFrame([(a, f"/events/{i}", "event" if i != 3 else "page", i) for a in (1, 2) for i in (1, 2, 3)], "answer_id int, link string, kind string, ord int")
    from tidemark.functions.text import markdown_links

    got = lookups.answer_sources(answers, chunks, markdown_links(F.col("text"), "/events/"))
    assert rows_of(got) == [(1, "/events/1", 2), (1, "/events/2", 1), (2, "/events/1", 1), (2, "/events/2", 2)]


def test_best_page_ties_and_audit(spark):
    pages = spark.createDataFrame([("s", "http://bb", 2, 1), ("s", "http://aa", 1, 1), ("s", "http://a", 0, 0), ("t", "u", 5, 0)], "s string, url string, no int, n int")
    assert rows_of(rollups.best_page(pages, "s", "url", "no", F.col("n") > 0)) == [("s", "http://aa")]
    log = rollups.audit_log(pages, "s", F.col("n") > 0, F.col("n") == 0, F.col("url"), "no", 2).where("s = 's'").first()
    assert (log.found, log.created, log.duplicates, log.raw_sample) == (3, 2, 1, ["http://a", "http://aa"])


# --- duplicates and rejects -----------------------------------------------------------------------------


def test_identity_needs_all_parts(spark):
    df = spark.createDataFrame([("Fair", "2026-01-01", None), ("Fair", "2026-01-01", ""), ("Fair", None, "2026-01-01"), ("The fair!", "2026-01-01", None)], "t string, d string, v string")
    h = [r.h for r in df.select(dedupe.identity_hash(F.col("t"), F.col("d"), F.col("v")).alias("h")).collect()]
    assert h[0] == h[1] == h[3] != h[2]


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", None), (4, None, "y"), (5, None, "z")], "ord int, k string, v string")
    once = dedupe.first_wins(df, ["k"], ["ord"])
    assert rows_of(once) == [(1, "a", None), (3, "b", None), (4, None, "y")] == rows_of(dedupe.first_wins(once, ["k"], ["ord"]))


def test_fuzzy(spark):
    rows = [
        (1, 1, "2026-01-01", "Summer Jazz Night", "Main Hall"),
        (2, 2, "2026-01-01", "Summer jazz night live", "Elsewhere"),  # title 3/4
        (3, 3, "2026-01-02", "Summer Jazz Night", "Main Hall"),  # other day
        (4, 4, "2026-01-01", "Jazz of winter", "main hall!"),  # title 1/4
        (5, 5, "2026-01-01", "Jazz night party", "Main Hall"),  # title 2/4 and venue
        (6, 6, "2026-01-01", "The", "Main Hall"),  # no word
    ]
    df = spark.createDataFrame(rows, "id int, ord int, day string, title string, venue string")
    pairs = {(r.id, r.other_id): (round(r.score, 3), r.reason) for r in dedupe.fuzzy_pairs(df, df, ["day"], "id", "ord").collect()}
    assert pairs == {(2, 1): (0.75, "same day, title~0.75 venue~0.00"), (5, 1): (0.75, "same day, title~0.50 venue~1.00")}
    assert rows_of(dedupe.duplicate_of(df, df, ["day"], "id", "ord")) == [(2, 1), (5, 1)]


# --- search -------------------------------------------------------------------------------------------------


def test_search_by_hand(spark):
    rows = [
        ("d1", "Wine stroll", "an evening of wine and music", "2026-09-05", "Town", True),
        ("d2", "Music night", "wines, winery tours", "2026-09-04", "Town", True),
        ("d3", "Quiet reading", "books", None, "Far", False),
    ]
    docs = spark.createDataFrame(rows, "id string, title string, text string, date string, venue string, in_town boolean")
    docs = search.corpus_order(docs)
    index = search.build_index(docs, search.document_tokens(F.col("title"), F.col("venue"), F.col("text")))
    assert index.n == 3
    tf = {(r.id, r.term): r.tf for r in index.postings.collect()}
    assert tf["d1", "wine"] == 4 and tf["d1", "stroll"] == 3 and tf["d2", "win"] == 1 and tf["d2", "winery"] == 1
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id int, query string")
    hits = search.matches(index, docs, ask("wine stroll"), local=F.col("in_town"))
    by = {r.id: r for r in hits.collect()}
    assert set(by) == {"d1", "d2"} and by["d1"].matched == 2 and by["d2"].matched == 1  # "wine" also begins "winery"
    assert by["d1"].score > by["d2"].score
    variants = rows_of(search.expanded(search.query_terms(ask("winer music")), index.terms), "term", "variant", "weight")
    assert variants == [("music", "music", 1.0), ("winer", "winery", 0.6)]
    top = search.ranked(search.matches(index, docs, ask("music")), 1).collect()
    assert [r.id for r in top] == ["d2"] and top[0].more == 1  # the limit leaves the total as it is
    facets = {(r.day, r.n, r.in_town) for r in search.facets(search.matches(index, docs, ask("music books")), F.col("in_town")).collect()}
    assert facets == {("2026-09-05", 1, 1), ("2026-09-04", 1, 1), ("undated", 1, 0)}
    assert search.matches(index, docs, ask("the of")).collect() == []


def test_phrase_and_place_double_and_raise(spark):
    docs = spark.createDataFrame([("a", "wine stroll", "x1", None, "v", False), ("b", "stroll wine", "x2", None, "v", True)], "id string, title string, text string, date string, venue string, in_town boolean")
    docs = search.corpus_order(docs)
    index = search.build_index(docs, search.document_tokens(F.col("title"), F.col("text")))
    q = spark.createDataFrame([(1, "Wine stroll ")], "query_id int, query string")
    plain = {r.id: r.score for r in search.scores(index, q).collect()}
    got = {r.id: r.score for r in search.matches(index, docs, q, local=F.col("in_town")).collect()}
    assert got["a"] == pytest.approx(2 * plain["a"], abs=1e-6) and got["b"] == pytest.approx(1.15 * plain["b"], abs=1e-6)


def test_stats_are_those_of_the_whole_corpus(spark):
    docs = search.corpus_order(spark.createDataFrame([(str(i), f"t{i} common", "", None, None, False) for i in range(9)], "id string, title string, text string, date string, venue string, in_town boolean"))
    index = search.build_index(docs, search.document_tokens(F.col("title"), F.col("text")))
    q = spark.createDataFrame([(1, "common")], "query_id int, query string")
    every = {r.id: r.score for r in search.matches(index, docs, q).collect()}
    some = {r.id: r.score for r in search.matches(index, docs, q, keep=F.col("id") < "3").collect()}
    assert some == {k: v for k, v in every.items() if k < "3"}


def test_a_saved_index_gives_the_same_hits(spark, tmp_path):
    docs = search.corpus_order(spark.createDataFrame([(str(i), f"wine {i % 3}", "stroll " * (i % 4), None, None, False) for i in range(30)], "id string, title string, text string, date string, venue string, in_town boolean"))
    index = search.build_index(docs, search.document_tokens(F.col("title"), F.col("text")))
    search.save_index(index, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "wine strol")], "query_id int, query string")
    a, b = (rows_of(search.matches(i, docs, q), "id", "score") for i in (index, search.read_index(spark, str(tmp_path / "i"))))
    assert a == b and len(a) == 30


def test_params():
    p = search.SearchParams.checked({"query": " a ", "from": "2026-1-1", "to": "2026-01-02", "city": "TOWN", "limit": 900, "free": "yes"}, ("Town",))
    assert (p.query, p.first, p.last, p.city, p.limit, p.free) == ("a", None, "2026-01-02", "Town", 80, False)
    assert search.SearchParams.checked({"city": "Nowhere", "limit": 0}, ("Town",)) == search.SearchParams(limit=1)
    assert search.SearchParams(query="x", first="a", last="b").described() == "Searching listings “x” a to b…"


def test_result_text(spark):
    df = spark.createDataFrame([("event", "Jazz", "2026-01-01", None, "Hall", None, None, "music", None, True, False, "/events/j", "Src", "http://x", "two\nlines"), ("page", "P", "2026-01-01", "2026-02-01", None, None, None, None, None, None, None, None, "Src", None, "")], "kind string, title string, date string, end_date string, venue string, address string, city string, category string, price string, is_free boolean, is_family_friendly boolean, link string, source string, url string, text string")
    a, b = [r.v for r in df.select(search.result_text(F.lit(1)).alias("v")).collect()]
    assert a.split("\n    ") == ["[1] Jazz", "when: 2026-01-01", "where: Hall", "music · free", "link: /events/j", "source: Src (http://x)", "two lines"]
    assert b == "[1] P (crawled page from Src)\n    mentions dates: 2026-01-01 to 2026-02-01"


# --- documents ----------------------------------------------------------------------------------------------------


def plain_slices(text):
    out, cur = [], ""
    import re

    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if cur and len(cur) + len(p) + 2 > 1400:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
        while len(cur) > 2100:
            out.append(cur[:1400])
            cur = cur[1400:]
    return out + [cur] if cur else out


def test_slices(spark):
    import random

    rnd = random.Random(1)
    texts = ["\n\n".join("w" * rnd.choice([1, 50, 700, 1399, 1400, 2100, 2101, 5000]) for _ in range(rnd.randint(0, 9))) for _ in range(200)] + ["", "\n \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", documents.slices(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [plain_slices(t) for t in texts]


def test_page_chunks_number_after_the_filter(spark):
    long = "word " * 300
    df = spark.createDataFrame([("p", f"tiny\n\n{long}\n\n{long} on 2026-03-01 and Jan 5"), ("q", "x")], "doc string, md string")
    got = documents.page_chunks(df, "doc", "md", F.concat(F.lit("T"), "doc"), F.lit("2026-02-01").cast("date"), ("Town",)).orderBy("id").collect()
    assert [(r.id, r.title, r.date, r.end_date) for r in got] == [("p#1", "Tp (part 1)", None, None), ("p#2", "Tp (part 2)", "2026-03-01", "2027-01-05")]


def test_dates(spark):
    df = spark.createDataFrame([("on 2026-13-45, 9/5/2026, Sept. 7th, Mar 32, jan 3 2028, 2026-09-05",)], "t string")
    base = F.lit("2026-09-06").cast("date")
    assert df.select(documents.dates_in(F.col("t"), base)).first()[0] == ["2026-09-05", "2026-09-07", "2026-13-45", "2028-01-03"]
    assert df.select(documents.dates_in(F.col("t"), base, checked=True)).first()[0] == ["2026-09-05", "2026-09-07", "2028-01-03"]
    assert df.select(documents.dates_in(F.col("t"))).first()[0] == ["2026-09-05", "2026-13-45", "2028-01-03"]


def test_sections_read_what_is_written(spark):
    rows = [("a1", "Jazz:  night", "2026-09-05", "Hall", "First line.\nSecond"), ("b2", "Plain", None, None, None)]
    df = spark.createDataFrame(rows, "id string, title string, date string, venue string, description string")
    text = documents.section_text(F.col("title"), {c: F.col(c) for c in ("id", "date", "venue")}, F.col("description"))
    whole = df.withColumns({"section": text, "source": F.lit("S")})
    digest = documents.digests(whole, "source", "id", "section", F.lit("---\nkind: events\nsource: S: x\n---\n\n"))
    assert digest.first().events == 2
    back = digest.select(documents.front_matter(F.concat(F.lit("﻿"), F.replace("markdown", F.lit("\n"), F.lit("\r\n")))).alias("fm")).select("fm.*")
    assert back.first().fields == {"kind": "events", "source": "S: x"}
    got = documents.sections(back).orderBy("section").collect()
    assert [(r.title, r.fields["id"], r.fields["date"], r.fields["venue"], r.text) for r in got] == [("Jazz: night", "a1", "2026-09-05", "Hall", "First line.\nSecond"), ("Plain", "b2", None, None, "")]


def test_sections_without_id_go(spark):
    df = spark.createDataFrame([("# Head\n\n## One\n\n- id: 1\n- free: yes\n\nBody\n## Two\n\nno id",)], "body string")
    assert [(r.title, r.fields, r.text) for r in documents.sections(df).collect()] == [("One", {"id": "1", "free": "yes"}, "Body")]


def test_markdown_cities_addresses(spark):
    df = spark.createDataFrame([("![i](x) [Name](http://y) <b>t</b>\n\n---\n\n\n\nend",)], "t string")
    assert df.select(documents.clean_markdown(F.col("t"))).first()[0] == "Name t\n\nend"
    df = spark.createDataFrame([("1 St, Near", None, ["x"]), (None, None, ["home"]), (None, "Hall", None)], "a string, v string, t array<string>")
    city = documents.city_of(F.col("a"), F.col("v"), F.col("t"), ("Home", "Near"), "home")
    assert [r.c for r in df.select(city.alias("c")).collect()] == ["Near", "Home", None]
    full = documents.completed_address(F.col("a"), F.lit("Home"))
    assert [r.c for r in df.select(full.alias("c")).collect()] == ["1 St, Near, Home, CA", "Home, CA", "Home, CA"]


# --- moderation -----------------------------------------------------------------------------------------------------


def test_submissions(spark):
    df = spark.createDataFrame([(" T ", "2026-12-01", "a@b.c", " "), ("", "2026-01-01", "a@b.c", None), ("T", "2026-01-01", "a@b", "x")], "title string, event_date string, contact_email string, venue string")
    got = [(r.title, r.venue, r.status, r.error is None) for r in moderation.submissions(df).collect()]
    assert got == [("T", None, "pending", True), (None, None, "rejected", False), ("T", "x", "rejected", False)]
    more = moderation.submissions(df).withColumns({c: F.lit(None).cast("string") for c in ("id", "description", "start_time", "end_time", "address", "category")} | {"price": F.lit("FREE entry")})
    p = moderation.published(more).first()
    assert (p.start_at, p.end_at, p.category, p.is_free) == ("2026-12-01T18:00:00-08:00", None, "other", True)


def test_patches(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, secret string")
    patch = spark.createDataFrame([(1, "new", "z")], "id int, title string, secret string")
    assert rows_of(moderation.patched(df, patch, "id")) == [(1, "new", "x"), (2, "b", "y")]
    assert rows_of(moderation.set_where(df, F.col("id") == 2, title=F.lit("c"))) == [(1, "a", "x"), (2, "c", "y")]


def test_turns(spark):
    turns = [("a", i, "user" if i % 2 == 0 else "assistant", f" t{i} ") for i in range(21)]
    turns += [("b", 0, "user", "x"), ("b", 1, "assistant", "y")] + [("c", 0, "system", "x"), ("c", 1, "user", "y")] + [("d", 0, "user", None), ("d", 1, "user", "y")] + [("e", 0, "user", "z" * 3000), ("e", 1, "user", "  ")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    got = rows_of(moderation.sanitised_turns(df))
    assert [r[1] for r in got if r[0] == "a"] and sorted(r[1] for r in got if r[0] == "a") == list(range(6, 21))
    assert {r[0] for r in got} == {"a", "e"} and [len(r[3]) for r in got if r[0] == "e"] == [2000]


# --- normalisation ----------------------------------------------------------------------------------------------------


def test_normalised_with_reasons(spark):
    region = normalize.Region("Home", ("Old Hall",), ("Near Town",), ("Faraway",), (("Fixed", "Home"),), (("Wide", "area"),), "area")
    base = dict(title="Jazz [concert](http://x)", start="2026-10-03", end=None, time=None, time_text="7 pm", end_time_text=None, venue="Old Hall", address=None, description="A lovely evening of sound", url=None, price=None, tags=[], source="S")
    cases = [
        {}, {"source": "Bad"}, {"title": "**ab"}, {"start": "soon"}, {"start": "2020-01-01"}, {"venue": "x", "address": "1 St, Faraway"}, {"venue": "x"},
        {"title": "JAZZ concert"}, {"venue": "x", "source": "Wide"}, {"title": "Old  Hall", "venue": "old hall", "price": "Free!", "end": "2026-10-03 08:00"}, {"venue": "x", "address": "2 St, Near Town", "title": "Wine walk"},
    ]
    rows = [(i, *({**base, **c}[k] for k in base)) for i, c in enumerate(cases)]
    types = ", ".join(f"`{k}` {'array<string>' if k == 'tags' else 'string'}" for k in base)
    out = normalize.normalised(spark.createDataFrame(rows, f"ord int, {types}"), region, dt.date(2026, 9, 2), dt.date(2027, 9, 2), ("Bad",)).orderBy("ord").collect()
    assert [r.reject_reason for r in out] == [None, "excluded-source", "no-title", "no-date", "out-of-window", "out-of-area", "no-location", "dupe", "dupe", None, None]
    a, b, c = out[0], out[9], out[10]
    assert (a.title, a.category, a.city, a.start_at, a.all_day, a.is_free) == ("Jazz concert", "music", "Home", "2026-10-03T19:00:00-07:00", False, False)
    assert (b.venue, b.end_at, b.is_free) == (None, None, True) and (c.city, c.region) == ("Near Town", "area")
    counts = {r.reason: r.n for r in dedupe.reject_counts(normalize.normalised(spark.createDataFrame(rows, f"ord int, {types}"), region, dt.date(2026, 9, 2), dt.date(2027, 9, 2), ("Bad",))).collect()}
    assert counts["kept"] == 3 and sum(counts.values()) == len(cases)


def test_word_boundary_of_venues(spark):
    region = normalize.Region("Home", ("county fair",), (), ("Faraway",))
    df = spark.createDataFrame([("County Fairgrounds, Faraway",), ("County Fair, Faraway",)], "v string")
    none = F.lit(None).cast("string")
    got = [r.c for r in df.select(region.city(none, F.col("v"), none, none, none, none).alias("c")).collect()]
    assert got == ["Faraway", "Home"]


def test_heuristic_and_images(spark):
    raw = spark.createDataFrame([("Kids day", "2026-09-05", None, None, None, None, None, None, None, None, None, None), ("No date", None, None, None, None, None, None, None, None, None, None, None)], "title string, date string, start_time string, end_time string, venue string, address string, description string, image_url string, source_url string, category string, price string, is_family_friendly boolean")
    got = normalize.heuristic(raw).collect()
    assert [(r.title, r.category, r.is_family_friendly, r.price) for r in got] == [("Kids day", "other", True, None)]
    ev = spark.createDataFrame([("1", "A", "own", "S"), ("2", "B", None, "S"), ("3", "C c!", None, "S"), ("4", "D", "", "S")], "id string, title string, image_url string, source_name string")
    by_id = spark.createDataFrame([("2", "page")], "id string, image string")
    by_title = spark.createDataFrame([("S", "cc", "listed")], "source string, key string, image string")
    got = normalize.filled_images(ev, by_id, by_title, ["p0", "p1"]).orderBy("id").collect()
    assert [r.image_source for r in got] == ["listing", "event-page", "listing", "category-stock"] and [r.image_url for r in got][:3] == ["own", "page", "listed"]
    model = spark.createDataFrame([(" T ", "2026-01-01T10:00:00Z", "odd", list("abcdefgh"), "bad"), ("x", "never", "arts", None, None)], "title string, start_at string, category string, tags array<string>, end_at string")
    got = normalize.checked_model_rows(model, ("arts",)).collect()
    assert [(r.title, r.category, len(r.tags), r.end_at) for r in got] == [("T", "other", 6, None)]


def test_namespaces_and_image_work(spark):
    df = spark.createDataFrame([("a", "1", "S", "u", None), ("b", "2", "S", "u", ""), ("c", "3", "S", "u", "img"), ("d", "4", "T", "u", None)], "slug string, id string, source_name string, source_url string, image_url string")
    assert [r.slug for r in moderation.namespaced(df, "crawl-").orderBy("slug").collect()] == ["crawl-a", "crawl-b", "crawl-c", "crawl-d"]
    with pytest.raises(Exception, match="outside its namespace"):
        moderation.namespaced(moderation.namespaced(df, "crawl-"), "crawl-").collect()
    assert rows_of(moderation.image_work(df, ("S",))) == [("u", ["1", "2"])]


def test_kept_index_is_made_again_for_other_files(spark, tmp_path):
    def found():
        docs = spark.read.parquet(f"{tmp_path}/d").withColumns({"venue": F.lit(None).cast("string"), "date": F.lit(None).cast("string")})
        index = search.kept_index(docs, search.document_tokens(F.col("title")))
        q = spark.createDataFrame([("q", "market")], "query_id string, query string")
        return {r.id for r in search.matches(index, docs, q).collect()}

    spark.createDataFrame([(1, "farmers market"), (2, "concert")], "id long, title string").coalesce(1).write.parquet(f"{tmp_path}/d")
    assert found() == {1} == found()
    spark.createDataFrame([(3, "night market")], "id long, title string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    assert found() == {1, 3}


def test_digest_files_by_source(spark, tmp_path):
    rows = [("s", f"2024-01-{31 - i:02d}", f"## {31 - i}") for i in range(30)] + [("t", "2024-01-01", "## t")]
    documents.write_digests(spark.createDataFrame(rows, "source string, start_at string, section string"), f"{tmp_path}/d")
    parts = sorted((tmp_path / "d" / "source=s").glob("part-*"))
    assert [x for p in parts for x in p.read_text().split("\n") if x] == [f"## {i}" for i in range(2, 32)]
    assert "".join(p.read_text() for p in (tmp_path / "d" / "source=t").glob("part-*")) == "## t\n\n"


def test_live_chunks_and_null_categories(spark):
    one = lambda rows: spark.createDataFrame(rows, "id string, kind string")
    bundled = one([("a", "event"), ("b", "page")])
    assert {r.id for r in documents.live_chunks(one([("x", "event")]), bundled).collect()} == {"x", "b"}
    assert {r.id for r in documents.live_chunks(one([]), bundled).collect()} == {"a", "b"}
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b")], "id long, c string")
    got = {}
    for r in listing.related(df, "id", "c", ["id"]).collect():
        got.setdefault(r.id, []).append(r.related_id)
    assert got == {1: [2, 3, 4], 3: [1, 2, 4]}
