"""Parsers of crawled pages by name, each one expression over a page, and their dispatch in one pass over the pages.

A page's text is split into lines once; a parser is a filter over line numbers, with a fold where a line's meaning
depends on those before it (days carried forward, a walk back from a link). No line becomes a row, nothing is shuffled,
and only the parser that a page names is worked out for it. A page that holds nothing of the expected form, or a null
text, gives no records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsonld
from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.functions.text import clean_html, let
from tidemark.operators.extract import DATE_ANY, NAV_NOISE

FIELDS = ("title", "start", "end", "time", "end_time", "venue", "address", "description", "url", "image", "price", "ticket")

#: The forms of lines and links that the parsers know.
DETAIL = r"^\*\*([A-Z][a-z]+ \d{1,2}, \d{4})\s*(?:-\s*([A-Z][a-z]+ \d{1,2}, \d{4}))?\s*(?:\(([^)]*)\))?\*\*\s*(.*)$"
DETAIL_PLACE = r"^([^<]*)<([^>]*)>([^\[]*?)\s*-\s*\[directions\]"
COST = r"\*\*Cost:\*\*\s*([^\[\n]{1,80})"
TICKETS = r"\[Buy Tickets\]\(([^)]+)\)"
HEADING_TIME = r"(?i)^##\s*-?\s*(\d{1,2}(?::\d{2})?\s*[ap]m)\s*$"
SHORT_DAY = r"^[A-Z][a-z]{2},\s+[A-Z][a-z]{2}\s+\d{1,2}$"
SPAN = rf"(?i)^##\s*((?:{tm.MONTH})\s*\d{{1,2}}(?:\s*[-–]\s*(?:{tm.MONTH})?\s*\d{{1,2}})?,?\s*\d{{4}})\s*$"
WORDED_DAY = rf"(?i)((?:Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday),?\s*)?({tm.MONTH})\s+(\d{{1,2}})(?:\s*[-–&]\s*\d{{1,2}})?,?\s*(20\d{{2}})?"
TITLE_DAY = rf"(?is)^(.+?)(?:{tm.MONTH})\s*\d{{1,2}}\s*(\d{{1,2}}:\d{{2}}\s*[AP]M)?(.*)$"
DAY_HEADER = r"^(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)([A-Z][a-z]{2})(\d{1,2})\s*$"
DAY_ITEM = r"^\*\s*\[(?:!\[[^\]]*\]\([^)]*\))?([^\]]{3,200})\]\((https?://[^)]+)\)\s*$"
ITEM_TIME = r"^\*\s*(?:\[)?(\d{1,2}(?::\d{2})?\s*[ap]m)"
HEADING = r"^#{1,4}\s+(.{4,140}?)\s*$"
PICTURE = r"!\[[^\]]*\]\([^)]*\)"
MENU = "Use tab to navigate through the menu items."


@dataclass(frozen=True)
class Sites:
    """What the parsers take as given: days, addresses of the sites, venues of those with one venue."""

    today: str
    horizon: str
    walk_site: str = "https://vibetrivalley.com"
    local_site: str = "https://patch.com/california/pleasanton/calendar/event"
    weekly_site: str = "https://www.pleasantonweekly.com/calendar/#!/details"
    bay_site: str = "https://dothebay.com/events"
    stage_site: str = "livermorearts.org/events/"
    fair: tuple[str, str] = ("Alameda County Fairgrounds", "4501 Pleasanton Ave, Pleasanton, CA 94566")
    street: tuple[str, str] = ("Downtown Pleasanton", "Main Street, Pleasanton, CA 94566")
    stage: tuple[str, str] = ("Bankhead Theater", "2400 First St, Livermore, CA 94550")

    @property
    def year(self) -> int:
        return int(self.today[:4])


@dataclass(frozen=True)
class Page:
    """Columns of a page."""

    md: Column
    html: Column
    url: Column


def quoted(s: str) -> str:
    """A pattern that matches just the text."""
    return rf"\Q{s}\E"


def group(c: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null if it is empty or there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def record(tags: Column | None = None, **known: Column | str | None) -> Column:
    """A record of the given fields; the others are null."""
    value = lambda k: F.lit(None) if known.get(k) is None else F.lit(known[k]) if isinstance(known[k], str) else known[k]
    none = F.array().cast("array<string>")
    return F.struct(*[value(k).cast("string").alias(k) for k in FIELDS], (none if tags is None else tags).alias("tags"))


def _lines(md: Column, trimmed: bool = True) -> Column:
    parts = F.split(md, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")) if trimmed else parts


def _line(lines: Column, i: Column) -> Column:
    """A line by its number; null beyond the last."""
    return F.get(lines, i)


def _numbers(lines: Column, wanted: Callable[[Column], Column]) -> Column:
    """Numbers of the lines that `wanted` is true of."""
    marked = F.transform(lines, lambda x, i: F.when(F.coalesce(wanted(x), F.lit(False)), i))
    return F.array_compact(marked)


def _records(made: Column) -> Column:
    """Without the nulls that stand for no record."""
    return F.array_compact(made)


def _links(md: Column, text: str, site: str, rest: str) -> Column:
    """Markdown links of a text pattern to a site, as they stand; group 1 is the text, 2 the whole address."""
    return F.regexp_extract_all(md, F.lit(rf"\[{text}\]\({site}{rest}\)"), F.lit(0))


# --- JSON -------------------------------------------------------------------------------------------------


def linked_data(page: Page, sites: Sites) -> Column:
    """Events in a page's JSON-LD scripts, wherever nested."""
    return F.transform(jsonld.wide_records(page.html, page.url), lambda r: record(**{k: r[k] for k in ("title", "start", "end", "venue", "address", "description", "image", "url", "price")}))


def calendar_api(page: Page, sites: Sites) -> Column:
    """Events of a calendar's JSON answer; text around the outermost braces is left out."""
    text = lambda v, k: jsonld.clean(jsonld.key(v, k))
    plain = lambda v, k: jsonld.key(v, k, "string")

    def of(e: Column) -> Column:
        place, names = jsonld.key(e, "venue"), jsonld.key(e, "categories", "array<variant>")
        address = F.nullif(F.concat_ws(", ", *[text(place, k) for k in ("address", "city", "state", "zip")]), F.lit(""))
        tags = F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<variant>")), lambda c: text(c, "name")))
        return record(
            tags, title=text(e, "title"), start=plain(e, "start_date"), end=plain(e, "end_date"), venue=text(place, "venue"), address=address, description=text(e, "description"),
            image=jsonld.at(e, "$.image.url", "string"), url=plain(e, "url"), price=text(e, "cost"),
        )

    data = jsonld.parsed(F.regexp_extract(page.md, r"(?s)\{.*\}", 0))
    return F.transform(jsonld.key(data, "events", "array<variant>"), of)


# --- headings ---------------------------------------------------------------------------------------------


def detail_lines(page: Page, sites: Sites) -> Column:
    """Headings whose next line tells days, time, place and cost; the line after that is the description."""

    def of(lines: Column, i: Column) -> Column:
        detail, title = _line(lines, i + 1), clean_html(F.substring(_line(lines, i), 3, 10**6))

        def with_rest(rest: Column) -> Column:
            return record(
                title=title, start=group(detail, DETAIL, 1), end=group(detail, DETAIL, 2), time=group(detail, DETAIL, 3), venue=clean_html(group(rest, DETAIL_PLACE, 1)), address=clean_html(group(rest, DETAIL_PLACE, 3)),
                description=clean_html(_line(lines, i + 2)), price=clean_html(group(rest, COST, 1)), ticket=group(rest, TICKETS, 1), url=page.url,
            )

        good = detail.rlike(DETAIL) & (F.length(title) <= 180)
        return F.when(F.coalesce(good, F.lit(False)), let(F.regexp_extract(detail, DETAIL, 4), with_rest))

    # a heading starts its line; the lines of the record are read trimmed
    raw = lambda x: F.regexp_extract(x, r"^## .*$", 0) != ""
    starts = _numbers(_lines(page.md, trimmed=False), raw)
    return let(_lines(page.md), lambda lines: _records(F.transform(starts, lambda i: of(lines, i))))


def span_headings(page: Page, sites: Sites) -> Column:
    """Headings with a line of a day or a span of days within two lines; a span's ends take year and month from each other."""

    def of(lines: Column, i: Column) -> Column:
        title = clean_html(F.substring(_line(lines, i), 4, 10**6))
        is_span = lambda k: F.coalesce(_line(lines, i + k).rlike(SPAN), F.lit(False))
        found = F.when(is_span(1), 1).when(is_span(2), 2)

        def with_span(at: Column) -> Column:
            span = F.regexp_extract(_line(lines, i + at), SPAN, 1)
            parts = F.split(span, r"\s*[-–]\s*")
            first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            year = group(span, r"(\d{4})", 1)
            dated = lambda c: F.when(year.isNotNull() & ~c.rlike(r"\d{4}"), F.concat(c, F.lit(", "), year)).otherwise(c)
            own = F.when(last.rlike(rf"(?i){tm.MONTH}"), last).otherwise(F.concat(F.regexp_extract(first, rf"(?i)^({tm.MONTH})", 1), F.lit(" "), last))
            prose = F.filter(F.slice(lines, i + at + 2, F.lit(7)), lambda x: (x != "") & ~x.rlike(r"^[!#\[]"))
            return record(title=title, start=dated(first), end=dated(own), venue=sites.fair[0], address=sites.fair[1], description=clean_html(F.get(prose, F.lit(0))), url=page.url)

        return F.when(F.coalesce((F.length(title) <= 150) & found.isNotNull(), F.lit(False)), let(found, with_span))

    return let(_lines(page.md), lambda lines: _records(F.transform(_numbers(lines, lambda x: x.startswith("## ")), lambda i: of(lines, i))))


def dated_headings(page: Page, sites: Sites) -> Column:
    """JSON-LD if the page has some; else headings with a date on their line or the next three, but for navigation."""

    def of(lines: Column, i: Column) -> Column:
        own = _line(lines, i)
        title = clean_html(F.regexp_replace(F.regexp_extract(own, HEADING, 1), r"\[(.+?)\]\([^)]*\)", "$1"))
        near = lambda n: F.array_join(F.filter(F.slice(lines, i + 1, F.lit(n)), lambda x: x != ""), " ")
        start = group(near(4), DATE_ANY, 1)
        prose = F.filter(F.slice(lines, i + 2, F.lit(5)), lambda x: (x != "") & ~x.rlike(r"^[!#*|]"))
        made = record(title=title, start=start, description=clean_html(F.get(prose, F.lit(0))), url=F.coalesce(group(near(3), r"\((https?://[^)]+)\)", 1), page.url))
        good = title.isNotNull() & ~title.rlike(NAV_NOISE) & ~title.rlike(rf"^(?:{DATE_ANY})") & start.isNotNull()
        return F.when(F.coalesce(good, F.lit(False)), made)

    headings = let(_lines(page.md), lambda lines: _records(F.transform(_numbers(lines, lambda x: x.rlike(HEADING)), lambda i: of(lines, i))))
    return let(linked_data(page, sites), lambda found: F.when(F.size(found) > 0, found).otherwise(headings))


def one_event(page: Page, sites: Sites) -> Column:
    """One record: the page's first heading that is no request, at the first day of its text between today and the horizon."""
    body = F.element_at(F.split(page.md, quoted(MENU)), -1)
    headings = F.filter(_lines(body), lambda x: x.rlike(r"^#{1,2}\s+.{3,120}$") & ~x.rlike(r"(?i)contact us|volunteer"))
    named = clean_html(F.regexp_extract(F.get(headings, F.lit(0)), r"^#{1,2}\s+(.{3,120})$", 1))
    from_url = F.initcap(clean_html(F.replace(F.regexp_extract(page.url, r"([^/]*)/*$", 1), F.lit("-"), F.lit(" "))))

    def of(text: Column) -> Column:
        said = F.regexp_extract_all(text, F.lit(WORDED_DAY), F.lit(0))
        start = lambda m: F.concat(F.regexp_extract(m, WORDED_DAY, 2), F.lit(" "), F.regexp_extract(m, WORDED_DAY, 3), F.lit(", "), F.coalesce(group(m, WORDED_DAY, 4), F.lit(str(sites.year))))
        # where each day stands: the fold cuts the text off at each in turn
        zero = F.struct(text.alias("left"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))

        def step(acc: Column, m: Column) -> Column:
            skip = F.instr(acc["left"], m) - 1
            low = (acc["at"] + skip).cast("int")
            high = (low + F.length(m)).cast("int")
            day = F.date_format(tm.parse_date(start(m), sites.year), "yyyy-MM-dd")
            good = F.coalesce(day.between(sites.today, sites.horizon), F.lit(False))
            rest = F.substring(acc["left"], skip + F.length(m) + 1, F.length(acc["left"]))
            out = F.struct(rest.alias("left"), high.alias("at"), F.when(good, start(m)).alias("start"), F.when(good, low).alias("low"), F.when(good, high).alias("high"))
            return F.when(acc["start"].isNotNull(), acc).otherwise(out)

        def made(hit: Column) -> Column:
            low = F.greatest(hit["low"] - 200, F.lit(0))
            around = clean_html(F.substring(text, low + 1, hit["high"] + 300 - low))
            one = record(title=F.coalesce(named, from_url), start=hit["start"], description=around, venue=sites.street[0], address=sites.street[1], url=page.url)
            return F.when(hit["start"].isNotNull(), F.array(one))

        return let(F.aggregate(said, zero, step), made)

    return let(body, of)


# --- folds over lines -------------------------------------------------------------------------------------


def day_headers(page: Page, sites: Sites) -> Column:
    """Items below headers of a day: the fold carries the day forward. The year is that of the page's address."""
    year = F.coalesce(group(page.url, r"month=[A-Za-z]+\+?(\d{4})", 1), F.lit(str(sites.year)))

    def of(lines: Column) -> Column:
        def item(day: Column, i: Column) -> Column:
            own, after = _line(lines, i), _line(lines, i + 1)
            title, href = clean_html(group(own, DAY_ITEM, 1)), F.regexp_extract(own, DAY_ITEM, 2)
            note = clean_html(F.regexp_replace(after, r"\[[^\]]*\]\([^)]*\)", " "))
            made = record(title=title, start=F.concat(day, F.lit(", "), year), time=group(after, ITEM_TIME, 1), venue=sites.stage[0], address=sites.stage[1], description=note, url=href)
            return F.when(F.coalesce(day.isNotNull() & title.isNotNull() & F.contains(href, F.lit(sites.stage_site)), F.lit(False)), made)

        none = F.array().cast(f"array<struct<{', '.join(f'{k}: string' for k in FIELDS)}, tags: array<string>>>")

        def step(acc: Column, i: Column) -> Column:
            own = _line(lines, i)
            header = F.concat(F.regexp_extract(own, DAY_HEADER, 1), F.lit(" "), F.regexp_extract(own, DAY_HEADER, 2).cast("int").cast("string"))
            new_day = F.struct(header.alias("day"), acc["out"].alias("out"))
            new_item = F.struct(acc["day"].alias("day"), F.concat(acc["out"], _records(F.array(item(acc["day"], i)))).alias("out"))
            return F.when(own.rlike(DAY_HEADER), new_day).otherwise(new_item)

        # only headers and items change the state
        some = _numbers(lines, lambda x: x.rlike(DAY_HEADER) | x.rlike(DAY_ITEM))
        return F.aggregate(some, F.struct(F.lit(None).cast("string").alias("day"), none.alias("out")), step)["out"]

    return let(_lines(page.md), of)


def walked_back(page: Page, sites: Sites) -> Column:
    """Each first link to an event: a fold over the eleven lines above it, upwards, finds its times, venue and title."""
    link = rf"({quoted(sites.walk_site)}/event/([a-z0-9\-]+?)-(\d{{4}}-\d{{2}}-\d{{2}})/)"
    venue_line = rf"^##\s*\[(.+?)\]\({quoted(sites.walk_site)}/venue/"

    def of(lines: Column) -> Column:
        links = F.transform(lines, lambda x: group(x, link, 1))

        def made(url: Column) -> Column:
            i = (F.array_position(links, url) - 1).cast("int")
            above = F.reverse(F.slice(lines, F.greatest(i - 10, F.lit(1)), F.least(i, F.lit(11))))
            text = lambda k: F.lit(None).cast("string").alias(k)
            zero = F.struct(text("venue"), text("start"), text("end"), text("title"))

            def step(acc: Column, x: Column) -> Column:
                now = lambda **new: F.struct(*[new.get(k, acc[k]).alias(k) for k in ("venue", "start", "end", "title")])
                time = F.when(x.startswith("##"), group(x, HEADING_TIME, 1))
                is_end = x.rlike(r"^[# ]*-") & acc["end"].isNull()
                name = clean_html(F.regexp_extract(x, r"^##\s+(.{3,180})$", 1))
                is_name = F.coalesce(acc["venue"].isNotNull() & ~F.lower(name).isin("featured", "featured events"), F.lit(False))
                return (
                    F.when(acc["title"].isNotNull() | (x == ""), acc)
                    .when(x.rlike(venue_line) & acc["venue"].isNull(), now(venue=clean_html(F.regexp_extract(x, venue_line, 1))))
                    .when(time.isNotNull(), F.when(is_end, now(end=time)).when(acc["start"].isNull(), now(start=time)).otherwise(acc))
                    .when(x.rlike(SHORT_DAY), acc)
                    .when(is_name, now(title=name))
                    .otherwise(acc)
                )

            slug = F.initcap(F.replace(F.regexp_extract(url, link, 2), F.lit("-"), F.lit(" ")))
            found = F.when(i > 0, F.aggregate(above, zero, step)).otherwise(zero)
            return let(found, lambda s: record(title=F.coalesce(s["title"], slug), start=F.regexp_extract(url, link, 3), venue=s["venue"], time=s["start"], end_time=s["end"], url=url))

        return F.transform(F.array_distinct(F.array_compact(links)), made)

    return let(_lines(page.md), of)


# --- links ------------------------------------------------------------------------------------------------


def dated_links(page: Page, sites: Sites) -> Column:
    """Links whose address ends in a day; their text tells title, time, address and more, without marks between."""
    rest = r"/(\d{8})/[^)]+"
    rx = rf"(?s)\[(.{{5,900}}?)\]\(({quoted(sites.local_site)}{rest})\)"

    place = r"^(.{5,120}?,\s*(?:CA|California))\b"

    # what several fields are made of is worked out once
    def of(m: Column) -> Column:
        def with_text(said: Column) -> Column:
            title = clean_html(F.regexp_replace(F.regexp_extract(said, TITLE_DAY, 1), r"^[#*\s>]+", ""))
            more = clean_html(F.regexp_extract(said, TITLE_DAY, 3))
            return let(title, lambda t: F.when(F.coalesce(said.rlike(TITLE_DAY) & (F.length(t) >= 4), F.lit(False)), let(more, lambda x: let(group(x, place, 1), lambda a: made(said, t, x, a)))))

        def made(said: Column, title: Column, more: Column, address: Column) -> Column:
            words = F.when(address.isNotNull(), F.substring(more, F.length(address) + 1, F.length(more))).otherwise(more)
            day = F.regexp_replace(F.regexp_extract(m, rx, 3), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
            return record(title=title, start=day, time=group(said, TITLE_DAY, 2), address=address, description=clean_html(words), url=F.regexp_extract(m, rx, 2))

        return let(F.regexp_replace(F.regexp_extract(m, rx, 1), PICTURE, " "), with_text)

    # a text of a link may hold pictures, so links are found without ] where the text has none
    return _records(F.transform(_links(page.md, "(?s:.{5,900}?)", f"({quoted(sites.local_site)}", rest + ")"), of))


def slugged_links(page: Page, sites: Sites) -> Column:
    """Links whose text runs title and venue together: the slug in the address tells where the title ends."""
    rest = r"/([^/]+)/(\d+)/(\d{4}-\d{2}-\d{2})T(\d{2})"
    rx = rf"\[([^\]]{{5,900}})\]\(({quoted(sites.weekly_site)}{rest})\)"

    def of(m: Column) -> Column:
        said = F.regexp_replace(F.regexp_extract(m, rx, 1), PICTURE, " ")
        head = F.regexp_replace(F.split(said, r"\|", 2)[0], r"^\s+|\s+$", "")
        tail = F.get(F.split(said, r"\|", 2), F.lit(1))
        place = r"(?s)^\s*([A-Za-z .'-]+,\s*CA)(.*)$"
        words = clean_html(F.when(tail.rlike(place), F.regexp_extract(tail, place, 2)).otherwise(tail))
        words = clean_html(F.regexp_replace(words, r"\s*\d{1,2}:\d{2}\s*[ap]m\s*[\d.]+\s*mi\s*$", ""))

        def with_parts(p: Column) -> Column:
            made = record(
                title=p["title"], venue=p["venue"], start=F.regexp_extract(m, rx, 5), time=F.concat(F.regexp_extract(m, rx, 6), F.lit(":00")), address=F.trim(group(tail, place, 1)), description=words, url=F.regexp_extract(m, rx, 2)
            )
            return F.when(F.coalesce(F.length(p["title"]) >= 4, F.lit(False)), made)

        return let(split_by_slug(head, F.regexp_extract(m, rx, 3)), with_parts)

    return _records(F.transform(_links(page.md, r"[^\]]{5,900}", f"({quoted(sites.weekly_site)}", rest + ")"), of))


def split_by_slug(head: Column, slug: Column) -> Column:
    """struct(title, venue): the shortest start of four letters or more with the slug; without one all, or half if it says all twice."""

    def of(x: Column, at: Column) -> Column:
        n = F.length(x)
        half = F.floor(n / 2).cast("int")
        twice = F.substring(x, F.lit(1), half)
        title = F.when(at.isNotNull(), F.substring(x, F.lit(1), at)).when((half > 0) & (F.substring(x, half + 1, half) == twice), twice).otherwise(x)
        return F.struct(clean_html(title).alias("title"), F.when(at.isNotNull(), clean_html(F.substring(x, at + 1, n))).alias("venue"))

    return let(head, lambda x: let(slug, lambda s: let(F.when(F.length(x) >= 4, tx.slug_end(x, s)), lambda at: of(x, at))))


def day_links(page: Page, sites: Sites) -> Column:
    """Links below a path of year, month and day; of one address only the first."""
    rest = r"/(\d{4})/(\d{1,2})/(\d{1,2})/[^)]+"
    rx = rf"\[([^\]]{{4,200}})\]\(({quoted(sites.bay_site)}{rest})\)"

    def of(links: Column) -> Column:
        addresses = F.transform(links, lambda m: F.regexp_extract(m, rx, 2))

        def made(url: Column) -> Column:
            m = F.get(links, (F.array_position(addresses, url) - 1).cast("int"))
            title = clean_html(F.regexp_replace(F.regexp_extract(m, rx, 1), PICTURE, " "))
            day = F.concat_ws("-", F.regexp_extract(m, rx, 3), *[F.lpad(F.regexp_extract(m, rx, g), 2, "0") for g in (4, 5)])
            return F.when(F.coalesce(F.length(title) >= 4, F.lit(False)), record(title=title, start=day, url=url))

        return _records(F.transform(F.array_distinct(addresses), made))

    return let(_links(page.md, r"[^\]]{4,200}", f"({quoted(sites.bay_site)}", rest + ")"), of)


#: Parsers by the names that pages use.
PARSERS: dict[str, Callable[[Page, Sites], Column]] = {
    "tribe_api": calendar_api,
    "lvwine": detail_lines,
    "vibe": walked_back,
    "acfair": span_headings,
    "pda": one_event,
    "patch": dated_links,
    "pweekly": slugged_links,
    "dothebay": day_links,
    "jsonld": linked_data,
    "bankhead": day_headers,
    "generic": dated_headings,
}


def parsed(pages: DataFrame, sites: Sites, parsers: dict | None = None, id_col: str = "page_id") -> DataFrame:
    """The id, parser, pos (from 0), the fields and tags of every record of every page.

    pages: id, parser, md, html, url. Each page is read once, by the parser that it names; one of an unknown name gives
    no records.
    """
    page = Page(F.col("md"), F.col("html"), F.col("url"))
    found = None
    for name, parse in (PARSERS if parsers is None else parsers).items():
        own = F.col("parser") == name
        found = F.when(own, parse(page, sites)) if found is None else found.when(own, parse(page, sites))
    rows = pages.select(F.col(id_col), "parser", F.posexplode(found).alias("pos", "r"))
    return rows.select(id_col, "parser", "pos", "r.*")
