import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonld
from tidemark.operators import page_parsers as pp

SITES = pp.Sites("2026-09-02", "2027-09-02")
SCHEMA = "page_id int, parser string, md string, html string, url string"
LD = '<script type="application/ld+json">%s</script>'


@pytest.fixture(scope="module")
def read(spark):
    def run(*pages):
        """Records by page, of (parser, md, html, url) or shorter rows."""
        rows = [(i, *p, *(None, "https://x.org/a/the-page/")[len(p) - 2 :]) for i, p in enumerate(pages)]
        out = [[] for _ in pages]
        for r in pp.parsed(spark.createDataFrame(rows, SCHEMA), SITES).orderBy("page_id", "pos").collect():
            out[r.page_id].append({k: v for k, v in r.asDict().items() if v not in (None, []) and k not in ("page_id", "parser", "pos")})
        return out

    return run


def test_all_names_in_one_pass(spark, read):
    assert len(pp.PARSERS) == 11
    pages = [(name, md) for name in pp.PARSERS for md in (None, "", "nothing of the kind\n\n## \n* [")] + [("unknown", "# Fair\nMay 1, 2027"), (None, "# Fair\nMay 1, 2027")]
    assert all(r == [] for r in read(*pages))
    df = spark.createDataFrame([(1, "generic", "x", None, "u")], SCHEMA)
    plan = pp.parsed(df, SITES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("Scan ExistingRDD", "")


def test_details_and_spans(read):
    lv = "## Fair\n  **May 2, 2026 - May 3, 2026 (7 pm)** Hall <http://v> 1 St, Town - [directions](x) **Cost:** $5 [Buy Tickets](http://t)\nProse\n ## Indented\n**May 2, 2026**\n## None\n\n## X\r\n**June 1, 2026** rest"
    ac = "## Fair\n## Jan 30 - Feb 2, 2027\n![x](y)\n\nSome prose\n## Other\n\n## July 4 – 6 2027\n# no\n## Far\n\n\n## May 1, 2027"
    a, b = read(("lvwine", lv), ("acfair", ac))
    assert [(r["title"], r["start"], r.get("end"), r.get("time"), r.get("venue"), r.get("address"), r.get("price"), r.get("ticket"), r.get("description")) for r in a] == [
        ("Fair", "May 2, 2026", "May 3, 2026", "7 pm", "Hall", "1 St, Town", "$5", "http://t", "Prose"), ("X", "June 1, 2026", None, None, None, None, None, None, None)]
    assert [(r["title"], r["start"], r.get("end"), r.get("description")) for r in b] == [("Fair", "Jan 30, 2027", "Feb 2, 2027", "Some prose"), ("Other", "July 4, 2027", "July 6 2027", None)]


def test_walk_back(read):
    site = "https://vibetrivalley.com"
    near = f"## Featured\n## Title\n## [Hall]({site}/venue/h)\nSat, May 2\n## 7 pm\n## - 9:30 PM\n[more]({site}/event/x-y-2026-05-02/)\n({site}/event/x-y-2026-05-02/)"
    far = f"## Title\n## [Hall]({site}/venue/h)\n" + "\n" * 10 + f"{site}/event/lone-walk-2026-05-03/"
    first = f"{site}/event/at-the-top-2026-05-04/"
    a, b, c = read(("vibe", near), ("vibe", far), ("vibe", first))
    assert a == [{"title": "Title", "start": "2026-05-02", "time": "7 pm", "end_time": "9:30 PM", "venue": "Hall", "url": f"{site}/event/x-y-2026-05-02/"}]
    assert [(r["title"], r.get("venue")) for r in b] == [("Lone Walk", "Hall")]  # the title stands one line too far up
    assert [r["title"] for r in c] == ["At The Top"]


def test_one_event(read):
    md = f"# Old\nOct 3, 2026\n{pp.MENU}\n# Contact us\n## Wine Walk\nMay 2, 2026 and Saturday, Oct 3 at noon, Oct 10, 2026"
    late = "x" * 400 + " Sep 9, 2026 " + "y" * 400
    a, b, c = read(("pda", md), ("pda", late), ("pda", "# T\nMay 1, 2020"))
    assert [(r["title"], r["start"]) for r in a] == [("Wine Walk", "Oct 3, 2026")] and "Old" not in a[0]["description"]
    assert b[0]["title"] == "The Page" and b[0]["description"] == "x" * 199 + " Sep 9, 2026 " + "y" * 299
    assert c == []


def test_links(read):
    patch = "https://patch.com/california/pleasanton/calendar/event/20260905/12/x"
    weekly = "https://www.pleasantonweekly.com/calendar/#!/details/"
    bay = "https://dothebay.com/events/2026/"
    a, b, c = read(
        ("patch", f"[![i](z) ## Big Party Sep 5 7:00 PM 12 Main St, Pleasanton, CA Fun for all]({patch}) [no day here]({patch})"),
        ("pweekly", f"[Wine WalkOld Hall | Pleasanton, CA Nice time 10:00 am5.3 mi]({weekly}wine-walk/12/2026-05-02T18) [AbcdAbcd]({weekly}zz/13/2026-05-03T09) [Whole text]({weekly}zz/14/2026-05-03T09)"),
        ("dothebay", f"[Show]({bay}5/2/show) [Again]({bay}5/2/show) [Else]({bay}10/12/x) [abc]({bay}1/1/short)"),
    )
    assert a == [{"title": "Big Party", "start": "2026-09-05", "time": "7:00 PM", "address": "12 Main St, Pleasanton, CA", "description": "Fun for all", "url": patch}]
    assert [(r["title"], r.get("venue"), r["time"], r.get("address"), r.get("description")) for r in b] == [("Wine Walk", "Old Hall", "18:00", "Pleasanton, CA", "Nice time"), ("Abcd", None, "09:00", None, None), ("Whole text", None, "09:00", None, None)]
    assert [(r["title"], r["start"]) for r in c] == [("Show", "2026-05-02"), ("Else", "2026-10-12")]


def test_day_headers_and_headings(read):
    site = "https://livermorearts.org/events/"
    md = f"* [Early]({site}0)\nSatMay2\n* [![i](j)Show]({site}s)\n* 7:30 pm [x](y) note\nSunMay03\n* [Other](http://o)\n* [Third]({site}t)"
    gen = "# Menu\nMay 1, 2026\n### Walk [x](http://a)\n\non May 3 we go\n## May 9\n## Late\n\n\n\nMay 3"
    a, b, c = read(("bankhead", md, None, "https://x?month=May+2027"), ("generic", gen), ("generic", "# Walk\nMay 1, 2026", LD % '{"@type":"Event","name":"LD"}'))
    assert [(r["title"], r["start"], r.get("time")) for r in a] == [("Show", "May 2, 2027", "7:30 pm"), ("Third", "May 3, 2027", None)]
    assert [(r["title"], r["start"], r["description"], r["url"]) for r in b] == [("Walk x", "May 3", "on May 3 we go", "http://a")]
    assert [r["title"] for r in c] == ["LD"]


def test_a_long_page(read):
    site = "https://livermorearts.org/events/"
    md = "\n".join(f"SatMay{i % 28 + 1}\n* [Show {i}]({site}{i})\n* {i % 12 + 1} pm\nwords" for i in range(2_000))
    (got,) = read(("bankhead", md))
    assert len(got) == 2_000 and got[-1]["start"] == f"May {1_999 % 28 + 1}, 2026"


def of(spark, function, *scripts, url="http://site/list/"):
    df = spark.createDataFrame([("".join(LD % s for s in scripts), url)], "html string, url string")
    return [r.asDict() for r in df.select(function(F.col("html"), F.col("url")).alias("r")).first().r]


def test_events_in_document_order_however_deep(spark):
    event = lambda n, **kw: {"@type": "Event", "name": n, **kw}
    deep = event("deep")
    for _ in range(40):
        deep = {"@graph": [[deep]]}
    tree = [event("a", item=event("b", **{"@graph": [event("c")]}), location={"@type": "EventVenue", "name": "v"}), {"itemListElement": [{"item": event("d")}]}, deep]
    assert [r["title"] for r in of(spark, jsonld.records, json.dumps(tree), json.dumps(event("e")))] == ["a", "b", "c", "d", "deep", "e"]
    assert [r["title"] for r in of(spark, jsonld.wide_records, json.dumps({"@type": "Event", "subEvent": event("s")}))] == ["s"]
    assert of(spark, jsonld.records, "{broken", "", "null", "3", '{"@type":"Event","name":"x"} tail') == []
    assert [r["title"] for r in of(spark, jsonld.wide_records, '{"@type":"Event","name":"A"}\n{"@type":"X","mainEntity":{"@type":"Event","name":"B"}}')] == ["A", "B"]


@pytest.mark.parametrize(("offers", "want"), [({"price": 0}, "Free"), ({"price": ""}, "Free"), ({"price": " "}, "Free"), ({"price": "0.00"}, "Free"), ([{"price": 12.5, "priceCurrency": "USD"}], "$12.5"), ({"lowPrice": 7}, "7"), ({"price": None, "lowPrice": "8"}, "8"), ({"price": "ask"}, "ask"), ([], None), ("5", None), (None, None)])
def test_price(spark, offers, want):
    from tidemark.functions import html

    script = json.dumps({"@type": "Event", "name": "x", "offers": offers})
    assert of(spark, jsonld.records, script)[0]["price"] == want == html.price_of(offers)


def test_addresses_like_a_browser(spark):
    bases, hrefs = ["http://s/l/p?z=1", "https://s/a/b/", "https://s/"], ["x", "/x", "//h/x", "?q=1", "#f", "../x", "./x/./y/..", "http://q/a?c=/../d", "mailto:x", "..", "x/", "../../../x"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for b, h, a in df.select("b", "h", jsonld.absolute(F.col("b"), F.col("h"))).collect():
        assert a == urljoin(b, h), (b, h)
    odd = {"a b": "http://s/l/a%20b", "": None, "https://Ab.C": "https://ab.c/"}
    df = spark.createDataFrame([("http://s/l/p", h) for h in odd], "b string, h string")
    assert {r.h: r.a for r in df.select("h", jsonld.absolute(F.col("b"), F.col("h")).alias("a")).collect()} == odd
