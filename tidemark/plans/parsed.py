"""Queries of the page parsers: pages written from orders, one page a customer, in all the shapes that a parser tells apart.

The text of an order is one expression that both engines read, so a query and its oracle work on the same pages; the oracle
parses them its own way, with rows of lines, joins and windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import jsonld
from tidemark.operators import page_parsers as pp
from tidemark.operators.extract import DATE_ANY, NAV_NOISE
from tidemark.plans.registry import query
from tidemark.sources import load

SITES = pp.Sites("1995-01-01", "1997-12-31")
_K, _D, _Y = "o_orderkey", "day(o_orderdate)", "year(o_orderdate)"
_S = f"cast({_K} AS string)"
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3)"
_DAY = f"{_MON} || ' ' || cast({_D} AS string)"
_DATE = f"{_DAY} || ', ' || cast({_Y} AS string)"
_ISO = "cast(cast(o_orderdate AS date) AS string)"
_NL = "chr(10)"


def pages_of(spark, sf_dir, parser, text, before="''", html=None):
    """A page a customer: the orders' texts below each other, by order."""
    rows = load(spark, sf_dir, "orders").withColumn("part", F.expr(text))
    rows = rows.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "part"))).alias("parts"))
    md = F.concat(F.expr(before), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    url = F.concat(F.lit("https://x.org/month=May+"), (F.col("page_id") % 3 + 1996).cast("string"), F.lit("/the-page/"))
    return rows.select("page_id", F.lit(parser).alias("parser"), md.alias("md"), F.lit(html).cast("string").alias("html"), url.alias("url"))


def _sql(text, before="''"):
    return f"""WITH pages AS (SELECT o_custkey AS page_id, {before} || string_agg({text}, chr(10) ORDER BY o_orderkey) AS md,
    'https://x.org/month=May+' || (o_custkey % 3 + 1996) || '/the-page/' AS url FROM orders GROUP BY 1),
l AS (SELECT page_id, url, no, raw, trim(raw) AS line FROM (SELECT page_id, url, unnest(range(len(parts))) AS no, unnest(parts) AS raw FROM (SELECT page_id, url, string_split(md, chr(10)) AS parts FROM pages)))
"""


_CLEAN = lambda x: rf"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')"
_POS = "(row_number() OVER (PARTITION BY page_id ORDER BY no) - 1)::INTEGER AS pos"


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _g(c, pattern, i):
    return f"nullif(regexp_extract({c}, {_rx(pattern)}, {i}), '')"


def parsed(spark, sf_dir, name, text, *columns):
    rows = pp.parsed(pages_of(spark, sf_dir, name, text), SITES)
    return rows.select("page_id", "pos", *columns)


DETAILS = f"""CASE WHEN {_K} % 5 = 4 THEN ' ' ELSE '' END || '## Order ' || {_S} || {_NL} || CASE {_K} % 6
    WHEN 0 THEN '**' || {_DATE} || '** see you'
    WHEN 1 THEN '  **' || {_DATE} || ' - Dec 31, ' || cast({_Y} AS string) || ' (7 pm)**'
    WHEN 2 THEN '**' || {_DATE} || '** Hall ' || {_S} || '<http://v/' || {_S} || '>' || {_S} || ' Elm St, Dale - [directions](d) **Cost:** $' || {_S} || ' [Buy Tickets](http://t/' || {_S} || ')'
    WHEN 3 THEN 'no day'
    WHEN 4 THEN '**' || {_DATE} || '**' || {_NL} || 'Prose  of ' || {_S}
    ELSE '**Tomorrow**' END"""


@query(
    "parsed_details",
    _sql(DETAILS)
    + rf""", n AS (SELECT *, lead(line) OVER w AS detail, lead(line, 2) OVER w AS after FROM l WINDOW w AS (PARTITION BY page_id ORDER BY no)),
h AS (SELECT *, regexp_extract(detail, {_rx(pp.DETAIL)}, 4) AS rest FROM n WHERE raw LIKE '## %' AND regexp_matches(detail, {_rx(pp.DETAIL)}))
SELECT page_id, {_POS}, {_CLEAN("substr(line, 3)")} AS title, {_g("detail", pp.DETAIL, 1)} AS start, {_g("detail", pp.DETAIL, 2)} AS end_, {_g("detail", pp.DETAIL, 3)} AS time,
    {_CLEAN(f"regexp_extract(rest, {_rx(pp.DETAIL_PLACE)}, 1)")} AS venue, {_CLEAN(f"regexp_extract(rest, {_rx(pp.DETAIL_PLACE)}, 3)")} AS address, {_CLEAN("after")} AS description,
    {_CLEAN(f"regexp_extract(rest, {_rx(pp.COST)}, 1)")} AS price, {_g("rest", pp.TICKETS, 1)} AS ticket FROM h""",
)
def parsed_details(spark, sf_dir):
    """Headings with a line of details."""
    return parsed(spark, sf_dir, "lvwine", DETAILS, "title", "start", F.col("end").alias("end_"), "time", "venue", "address", "description", "price", "ticket")


WALK = f"""'## ' || CASE {_K} % 4 WHEN 0 THEN 'Featured' WHEN 1 THEN 'Order ' || {_S} ELSE 'Fair of ' || {_S} || {_NL} END
    || CASE {_K} % 3 WHEN 0 THEN '' ELSE {_NL} || '## [Hall ' || {_S} || '](https://vibetrivalley.com/venue/h)' END || {_NL} || 'Sat, May 2'
    || CASE WHEN {_K} % 5 < 3 THEN {_NL} || '## ' || cast({_K} % 12 + 1 AS string) || ' pm' ELSE '' END || CASE WHEN {_K} % 5 = 1 THEN {_NL} || '## - 11:30 PM' ELSE '' END
    || {_NL} || 'go to https://vibetrivalley.com/event/walk-' || cast({_K} % 40 AS string) || '-' || {_ISO} || '/ now' || CASE WHEN {_K} % 7 = 0 THEN {_NL} || 'again https://vibetrivalley.com/event/walk-0-1995-05-05/' ELSE '' END"""
_LINK, _VENUE = r"(https://vibetrivalley\.com/event/([a-z0-9\-]+?)-(\d{4}-\d{2}-\d{2})/)", r"^##\s*\[(.+?)\]\(https://vibetrivalley\.com/venue/"


@query(
    "parsed_walk_back",
    _sql(WALK)
    + rf""", hits AS (SELECT page_id, min(no) AS i, {_g("line", _LINK, 1)} AS url FROM l WHERE regexp_matches(line, {_rx(_LINK)}) GROUP BY ALL),
near AS (SELECT h.page_id, h.i, h.url, h.i - l.no AS d, l.line, regexp_matches(l.line, {_rx(_VENUE)}) AS is_venue, regexp_extract(l.line, {_rx(pp.HEADING_TIME)}, 1) AS t
    FROM hits h LEFT JOIN l ON l.page_id = h.page_id AND h.i - l.no BETWEEN 1 AND 11 AND l.line <> ''),
v AS (SELECT *, min(d) FILTER (WHERE is_venue) OVER w AS venue_d FROM near WINDOW w AS (PARTITION BY page_id, i)),
named AS (SELECT *, min(d) FILTER (WHERE d > venue_d AND t = '' AND NOT regexp_matches(line, {_rx(pp.SHORT_DAY)}) AND regexp_matches(line, '^##\s+.{{3,180}}$')
    AND lower(line) NOT IN ('## featured', '## featured events')) OVER w AS title_d FROM v WINDOW w AS (PARTITION BY page_id, i)),
ends AS (SELECT *, min(d) FILTER (WHERE t <> '' AND regexp_matches(line, '^[# ]*-') AND (title_d IS NULL OR d < title_d)) OVER w AS end_d FROM named WINDOW w AS (PARTITION BY page_id, i)),
starts AS (SELECT *, min(d) FILTER (WHERE t <> '' AND d IS DISTINCT FROM end_d AND (title_d IS NULL OR d < title_d)) OVER w AS start_d FROM ends WINDOW w AS (PARTITION BY page_id, i)),
one AS (SELECT page_id, i AS no, url, max({_CLEAN("regexp_extract(line, '^##\\s+(.+)$', 1)")}) FILTER (WHERE d = title_d) AS title, max(regexp_extract(line, {_rx(_VENUE)}, 1)) FILTER (WHERE d = venue_d) AS venue,
    max(t) FILTER (WHERE d = start_d) AS time, max(t) FILTER (WHERE d = end_d) AS end_time FROM starts GROUP BY ALL)
SELECT page_id, {_POS}, coalesce(title, 'Walk ' || regexp_extract(url, 'walk-(\d+)', 1)) AS title, regexp_extract(url, {_rx(_LINK)}, 3) AS start, time, end_time, venue, url FROM one""",
)
def parsed_walk_back(spark, sf_dir):
    """Links to events, described by the lines above them."""
    return parsed(spark, sf_dir, "vibe", WALK, "title", "start", "time", "end_time", "venue", "url")


SPANS = f"""'## Fair ' || {_S} || CASE {_K} % 3 WHEN 0 THEN {_NL} ELSE '' END || {_NL} || CASE {_K} % 5
    WHEN 0 THEN '## ' || {_DATE} WHEN 1 THEN '## ' || {_DAY} || ' - 31, ' || cast({_Y} AS string) WHEN 2 THEN '## ' || {_DAY} || ' – December 31 ' || cast({_Y} AS string)
    WHEN 3 THEN '## ' || {_DAY} ELSE 'On ' || {_DATE} END || {_NL} || '![i](p)' || {_NL} || CASE WHEN {_K} % 2 = 0 THEN 'Words <b>of</b> ' || {_S} ELSE '' END"""


@query(
    "parsed_spans",
    _sql(SPANS)
    + rf""", n AS (SELECT *, lead(line) OVER w AS a, lead(line, 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY page_id ORDER BY no)),
h AS (SELECT *, CASE WHEN regexp_matches(a, {_rx(pp.SPAN)}) THEN 1 WHEN regexp_matches(b, {_rx(pp.SPAN)}) THEN 2 END AS k FROM n WHERE line LIKE '## %'),
s AS (SELECT *, regexp_split_to_array(regexp_extract(CASE k WHEN 1 THEN a ELSE b END, {_rx(pp.SPAN)}, 1), '\s*[-–]\s*') AS p, regexp_extract(CASE k WHEN 1 THEN a ELSE b END, '\d{{4}}') AS y FROM h WHERE k IS NOT NULL),
d AS (SELECT s.*, (SELECT min_by({_CLEAN("x.line")}, x.no) FROM l x WHERE x.page_id = s.page_id AND x.no BETWEEN s.no + k + 1 AND s.no + k + 7 AND x.line <> '' AND NOT regexp_matches(x.line, '^[!#\[]')) AS words FROM s)
SELECT page_id, {_POS}, substr(line, 4) AS title, p[1] || CASE WHEN regexp_matches(p[1], '\d{{4}}') THEN '' ELSE ', ' || y END AS start,
    CASE WHEN regexp_matches(p[2], '(?i)dec') THEN '' ELSE regexp_extract(p[1], '^[A-Za-z]+') || ' ' END || p[2] || CASE WHEN regexp_matches(p[2], '\d{{4}}') THEN '' ELSE ', ' || y END AS end_, words AS description FROM d""",
)
def parsed_spans(spark, sf_dir):
    """Headings with a day or span of days below."""
    return parsed(spark, sf_dir, "acfair", SPANS, "title", "start", F.col("end").alias("end_"), "description")


ONE = f"""CASE {_K} % 4 WHEN 0 THEN '# Contact us now' WHEN 1 THEN '## Walk of ' || {_S} WHEN 2 THEN '### deep' ELSE '' END || {_NL} || 'Come on ' || CASE WHEN {_K} % 2 = 0 THEN 'Friday, ' ELSE '' END || {_DAY} || ', ' || cast({_Y} + 8 AS string) || ' to ' || {_S}"""
_MENU = f"'# Old page' || {_NL} || CASE WHEN o_custkey % 2 = 0 THEN '{pp.MENU}' ELSE '' END || {_NL}"
_BODY = f"list_last(string_split(md, '{pp.MENU}'))"


@query(
    "parsed_one_event",
    _sql(ONE, _MENU).replace("'# Old page'", "any_value('# Old page')").replace("CASE WHEN o_custkey % 2 = 0 THEN 'Use", "CASE WHEN any_value(o_custkey) % 2 = 0 THEN 'Use")
    + rf""", b AS (SELECT page_id, url, {_BODY} AS body FROM pages),
lines AS (SELECT page_id, unnest(range(len(p))) AS no, trim(unnest(p)) AS line FROM (SELECT page_id, string_split(body, chr(10)) AS p FROM b)),
heads AS (SELECT page_id, min_by(regexp_extract(line, '^#{{1,2}}\s+(.+)$', 1), no) AS title FROM lines WHERE regexp_matches(line, '^#{{1,2}}\s+.{{3,120}}$') AND NOT regexp_matches(line, '(?i)contact us|volunteer') GROUP BY 1),
said AS (SELECT page_id, body, unnest(range(len(m))) AS no, unnest(m) AS m FROM (SELECT page_id, body, regexp_extract_all(body, {_rx(pp.WORDED_DAY)}, 0) AS m FROM b)),
days AS (SELECT *, regexp_extract(m, '([A-Z][a-z]{{2}}) (\d+), (\d{{4}})', 0) AS start FROM said),
good AS (SELECT * FROM days WHERE strptime(start, '%b %d, %Y') BETWEEN DATE '2003-01-01' AND DATE '2005-12-31' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY no) = 1)
SELECT page_id, 0 AS pos, coalesce(title, 'The Page') AS title, start, {_CLEAN("substr(body, greatest(instr(body, m) - 200, 1), least(instr(body, m) - 1, 200) + length(m) + 300)")} AS description FROM good LEFT JOIN heads USING (page_id)""",
)
def parsed_one_event(spark, sf_dir):
    """One record a page, at the first day in the window, with the words around it."""
    pages = pages_of(spark, sf_dir, "pda", ONE, _MENU.replace("o_custkey", "page_id"))
    return pp.parsed(pages, pp.Sites("2003-01-01", "2005-12-31")).select("page_id", "pos", "title", "start", "description")


LOCAL = f"""'[' || CASE WHEN {_K} % 3 = 0 THEN '![i](p.png) ' ELSE '' END || '## Party of ' || {_S} || CASE WHEN {_K} % 5 = 0 THEN '' ELSE {_DAY} || CASE WHEN {_K} % 2 = 0 THEN ' 7:30 PM' ELSE '' END END
    || CASE {_K} % 4 WHEN 0 THEN ' 12 Elm St, Dale, CA Fun of ' || {_S} WHEN 1 THEN ' only words' ELSE '' END || '](https://patch.com/california/pleasanton/calendar/event/' || replace({_ISO}, '-', '') || '/' || {_S} || '/party)'"""
_LOCAL = r"(?s)\[(.{5,900}?)\]\((https://patch\.com/california/pleasanton/calendar/event/(\d{8})/[^)]+)\)"
_PLACE = r"^(.{5,120}?,\s*(?:CA|California))\b"


@query(
    "parsed_dated_links",
    _sql(LOCAL)
    + rf""", m AS (SELECT page_id, unnest(range(len(x))) AS no, unnest(x) AS m FROM (SELECT page_id, regexp_extract_all(md, {_rx(_LOCAL)}, 0) AS x FROM pages)),
s AS (SELECT *, regexp_replace(regexp_extract(m, {_rx(_LOCAL)}, 1), '!\[[^\]]*\]\([^)]*\)', ' ', 'g') AS said, regexp_extract(m, {_rx(_LOCAL)}, 3) AS day FROM m),
t AS (SELECT *, {_CLEAN(f"regexp_extract(said, {_rx(pp.TITLE_DAY)}, 3)")} AS more FROM s WHERE regexp_matches(said, {_rx(pp.TITLE_DAY)}))
SELECT page_id, {_POS}, {_CLEAN(f"regexp_replace(regexp_extract(said, {_rx(pp.TITLE_DAY)}, 1), '^[#*\\s>]+', '')")} AS title, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7) AS start, {_g("said", pp.TITLE_DAY, 2)} AS time,
    {_g("more", _PLACE, 1)} AS address, {_CLEAN(f"regexp_replace(more, {_rx(_PLACE)}, '')")} AS description, regexp_extract(m, {_rx(_LOCAL)}, 2) AS url FROM t""",
)
def parsed_dated_links(spark, sf_dir):
    """X11: links whose address ends in a day."""
    return parsed(spark, sf_dir, "patch", LOCAL, "title", "start", "time", "address", "description", "url")


WEEKLY = f"""'[Wine ' || CASE {_K} % 4 WHEN 0 THEN '& ' WHEN 1 THEN 'Walk ' ELSE '' END || {_S} || CASE {_K} % 3 WHEN 0 THEN 'Hall of Dale' WHEN 1 THEN '' ELSE 'Wine ' || {_S} END || CASE {_K} % 5 WHEN 0 THEN '' WHEN 1 THEN '|Port Dale, CAGood words10:00 am5.3 mi' ELSE ' | words | more' END
    || '](https://www.pleasantonweekly.com/calendar/#!/details/' || CASE WHEN {_K} % 7 = 0 THEN 'other' WHEN {_K} % 4 = 1 THEN 'wine-walk-' || {_S} ELSE 'wine-' || {_S} END || '/' || {_S} || '/' || {_ISO} || 'T' || lpad(cast({_K} % 24 AS string), 2, '0') || ')'"""
_WEEKLY = r"\[([^\]]{5,900})\]\((https://www\.pleasantonweekly\.com/calendar/#!/details/([^/]+)/(\d+)/(\d{4}-\d{2}-\d{2})T(\d{2}))\)"
_SLUG = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "parsed_slugged_links",
    _sql(WEEKLY)
    + rf""", m AS (SELECT page_id, unnest(range(len(x))) AS no, unnest(x) AS m FROM (SELECT page_id, regexp_extract_all(md, {_rx(_WEEKLY)}, 0) AS x FROM pages)),
s AS (SELECT *, regexp_extract(m, {_rx(_WEEKLY)}, 1) AS said, regexp_extract(m, {_rx(_WEEKLY)}, 3) AS slug FROM m),
h AS (SELECT *, trim(split_part(said, '|', 1)) AS head, CASE WHEN instr(said, '|') > 0 THEN substr(said, instr(said, '|') + 1) END AS tail FROM s),
e AS (SELECT *, list_filter(range(4, length(head) + 1), lambda i: {_SLUG("head[1:i]")} = slug)[1] AS i, length(head) // 2 AS half FROM h)
SELECT page_id, {_POS}, trim(CASE WHEN i IS NOT NULL THEN head[1:i] WHEN head[1:half] = head[half + 1:2 * half] THEN head[1:half] ELSE head END) AS title, nullif(trim(head[i + 1:]), '') AS venue,
    regexp_extract(m, {_rx(_WEEKLY)}, 5) AS start, regexp_extract(m, {_rx(_WEEKLY)}, 6) || ':00' AS time, nullif(trim(regexp_extract(tail, '^\s*([A-Za-z .''-]+,\s*CA)', 1)), '') AS address,
    nullif(trim(regexp_replace(regexp_replace(tail, '^\s*[A-Za-z .''-]+,\s*CA', ''), '\s*\d{{1,2}}:\d{{2}}\s*[ap]m\s*[\d.]+\s*mi\s*$', '')), '') AS description FROM e""",
)
def parsed_slugged_links(spark, sf_dir):
    """X11: links whose text runs title and venue together."""
    return parsed(spark, sf_dir, "pweekly", WEEKLY, "title", "venue", "start", "time", "address", "description")


BAY = f"""'[' || CASE {_K} % 3 WHEN 0 THEN 'Show ' || {_S} WHEN 1 THEN '  Show   <i>x</i> ' ELSE 'a  b' END || '](https://dothebay.com/events/' || cast({_Y} AS string) || '/' || cast(month(o_orderdate) AS string) || '/' || cast({_D} AS string) || '/show-' || cast({_K} % 2 AS string) || ') and [x](https://dothebay.com/events/1995/1/1/show)'"""
_BAY = r"\[([^\]]{4,200})\]\((https://dothebay\.com/events/(\d{4})/(\d{1,2})/(\d{1,2})/[^)]+)\)"


@query(
    "parsed_day_links",
    _sql(BAY)
    + rf""", m AS (SELECT page_id, unnest(range(len(x))) AS k, unnest(x) AS m FROM (SELECT page_id, regexp_extract_all(md, {_rx(_BAY)}, 0) AS x FROM pages)),
first AS (SELECT page_id, regexp_extract(m, {_rx(_BAY)}, 2) AS url, min(k) AS no, min_by(m, k) AS m FROM m GROUP BY ALL)
SELECT page_id, {_POS}, {_CLEAN(f"regexp_extract(m, {_rx(_BAY)}, 1)")} AS title, regexp_extract(m, {_rx(_BAY)}, 3) || '-' || lpad(regexp_extract(m, {_rx(_BAY)}, 4), 2, '0') || '-' || lpad(regexp_extract(m, {_rx(_BAY)}, 5), 2, '0') AS start, url
FROM first WHERE length({_CLEAN(f"regexp_extract(m, {_rx(_BAY)}, 1)")}) >= 4""",
)
def parsed_day_links(spark, sf_dir):
    """X11: links below a path of year, month and day."""
    return parsed(spark, sf_dir, "dothebay", BAY, "title", "start", "url")


STAGE = f"""CASE WHEN {_K} % 3 = 0 THEN 'Sat' || {_MON} || lpad(cast({_D} AS string), cast({_K} % 2 + 1 AS int), '0') || {_NL} ELSE '' END || '* [' || CASE WHEN {_K} % 2 = 0 THEN '![p](https://p/i.png)' ELSE '' END || 'Show ' || {_S} || '](https://' || CASE WHEN {_K} % 5 = 0 THEN 'x.org/' ELSE 'livermorearts.org/events/' END || {_S} || ')'
    || {_NL} || CASE {_K} % 4 WHEN 0 THEN '* 7:30 pm [tickets](t)' WHEN 1 THEN '* [8 pm](t) late' WHEN 2 THEN 'Doors open' ELSE '' END"""


@query(
    "parsed_day_headers",
    _sql(STAGE)
    + rf""", n AS (SELECT *, lead(line) OVER (PARTITION BY page_id ORDER BY no) AS after, last_value(CASE WHEN regexp_matches(line, {_rx(pp.DAY_HEADER)}) THEN regexp_extract(line, {_rx(pp.DAY_HEADER)}, 1) || ' ' || regexp_extract(line, {_rx(pp.DAY_HEADER)}, 2)::INTEGER END IGNORE NULLS)
    OVER (PARTITION BY page_id ORDER BY no) AS day FROM l)
SELECT page_id, {_POS}, {_g("line", pp.DAY_ITEM, 1)} AS title, day || ', ' || (page_id % 3 + 1996) AS start, {_g("after", pp.ITEM_TIME, 1)} AS time, {_CLEAN("regexp_replace(after, '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g')")} AS description, regexp_extract(line, {_rx(pp.DAY_ITEM)}, 2) AS url
FROM n WHERE day IS NOT NULL AND regexp_matches(line, {_rx(pp.DAY_ITEM)}) AND instr(line, 'livermorearts.org/events/') > 0""",
)
def parsed_day_headers(spark, sf_dir):
    """Items below headers that carry the day forward."""
    return parsed(spark, sf_dir, "bankhead", STAGE, "title", "start", "time", "description", "url")


HEADS = f"""CASE {_K} % 6 WHEN 0 THEN '# Calendar' WHEN 1 THEN '## ' || {_DATE} WHEN 2 THEN '### Walk [of ' || {_S} || '](https://x.org/' || {_S} || ')' WHEN 3 THEN '#### Fair ' || {_S} || ' ' || {_ISO} WHEN 4 THEN '##### Deep ' || {_S} ELSE '# Late ' || {_S} || {_NL} || {_NL} END
    || {_NL} || CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN '* a point' ELSE '![i](p)' END || {_NL} || CASE {_K} % 3 WHEN 0 THEN 'On ' || {_DAY} || ', 2001 we go' WHEN 1 THEN 'No day, (https://x.org/l)' ELSE '' END || {_NL} || 'End of ' || {_S}"""


@query(
    "parsed_headings",
    _sql(HEADS)
    + rf""", h AS (SELECT *, {_CLEAN(f"regexp_replace(regexp_extract(line, {_rx(pp.HEADING)}, 1), '\\[(.+?)\\]\\([^)]*\\)', '\\1', 'g')")} AS title FROM l WHERE regexp_matches(line, {_rx(pp.HEADING)})),
near AS (SELECT h.page_id, h.no, any_value(h.title) AS title, any_value(h.url) AS page_url, string_agg(x.line, ' ' ORDER BY x.no) FILTER (WHERE x.line <> '' AND x.no <= h.no + 3) AS window_, string_agg(x.line, ' ' ORDER BY x.no) FILTER (WHERE x.no <= h.no + 2) AS close_,
    min_by(x.line, x.no) FILTER (WHERE x.no > h.no AND x.line <> '' AND NOT regexp_matches(x.line, '^[!#*|]')) AS words
    FROM h JOIN l x ON x.page_id = h.page_id AND x.no BETWEEN h.no AND h.no + 5 GROUP BY 1, 2)
SELECT page_id, {_POS}, title, {_g("window_", DATE_ANY, 1)} AS start, {_CLEAN("words")} AS description, coalesce({_g("close_", r"\((https?://[^)]+)\)", 1)}, page_url) AS url
FROM near WHERE title IS NOT NULL AND NOT regexp_matches(title, {_rx(NAV_NOISE)}) AND NOT regexp_matches(title, {_rx(f"^(?:{DATE_ANY})")}) AND {_g("window_", DATE_ANY, 1)} IS NOT NULL""",
)
def parsed_headings(spark, sf_dir):
    """Headings with a date near, but for navigation."""
    return parsed(spark, sf_dir, "generic", HEADS, "title", "start", "description", "url")


API = f"""CASE WHEN {_K} % 9 = 8 THEN 'null' ELSE '{{"title": "Order &amp; ' || {_S} || '", "start_date": "' || {_ISO} || ' 10:00", "url": ' || CASE WHEN {_K} % 2 = 0 THEN '"https://x.org/' || {_S} || '"' ELSE 'null' END
    || ', "cost": "' || CASE WHEN {_K} % 3 = 0 THEN '' ELSE '$' || {_S} END || '", "venue": ' || CASE {_K} % 4 WHEN 0 THEN '[]' WHEN 1 THEN '{{"venue": "Hall", "city": "Dale", "zip": "' || {_S} || '"}}' WHEN 2 THEN '{{"address": "1 <b>Elm</b>"}}' ELSE 'null' END
    || ', "image": ' || CASE WHEN {_K} % 5 = 0 THEN 'false' ELSE '{{"url": "i' || {_S} || '"}}' END || ', "categories": ' || CASE WHEN {_K} % 2 = 0 THEN '[{{"name": "Art"}}, {{"name": null}}, {{"name": "' || o_orderpriority || '"}}]' ELSE 'null' END || '}}' END"""


@query(
    "parsed_calendar_api",
    f"""WITH e AS (SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS pos, ({API})::JSON AS j FROM orders WHERE o_custkey % 10 > 0),
x AS (SELECT *, list_filter([json_extract_string(c, '$.name') FOR c IN coalesce(from_json(json_extract(j, '$.categories'), '["JSON"]'), [])], lambda n: n IS NOT NULL) AS tags FROM e)
SELECT page_id, pos, {_CLEAN("replace(j->>'$.title', '&amp;', '&')")} AS title, j->>'$.start_date' AS start, j->>'$.url' AS url, nullif(j->>'$.cost', '') AS price, j->>'$.venue.venue' AS venue,
    nullif(concat_ws(', ', {_CLEAN("j->>'$.venue.address'")}, j->>'$.venue.city', j->>'$.venue.zip'), '') AS address, j->>'$.image.url' AS image, array_to_string(tags, ',') AS tags FROM x""",
)
def parsed_calendar_api(spark, sf_dir):
    """S13, X7-X13's sibling: events of a calendar's JSON answer; every tenth page holds none that can be read."""
    pages = pages_of(spark, sf_dir, "tribe_api", API)
    body = F.concat(F.lit('```json\n{"total": 3, "events": ['), F.replace("md", F.lit("\n"), F.lit(", ")), F.when(F.col("page_id") % 10 == 0, "").otherwise("]}\n```"))
    rows = pp.parsed(pages.withColumn("md", body), SITES)
    return rows.select("page_id", "pos", "title", "start", "url", "price", "venue", "address", "image", F.array_join("tags", ",").alias("tags"))


_EVENT = r"""'{{"@type": ' || CASE page_id % 3 WHEN 0 THEN '"MusicEvent"' WHEN 1 THEN '["Thing", "Event"]' ELSE '"Place"' END || ', "name": ' || CASE page_id % 11 WHEN 0 THEN 'null' WHEN 1 THEN '["  Page ' || page_id || ' ", "b"]' ELSE '"Page ' || page_id || '"' END || ', "startDate": "2024-05-0' || page_id % 9 || '", "url": "' || CASE page_id % 5 WHEN 0 THEN '/e/' || page_id WHEN 1 THEN 'https://x.org/e' WHEN 2 THEN 'e' || page_id WHEN 3 THEN '' ELSE '?q=1' END
    || '", "location": ' || CASE page_id % 4 WHEN 0 THEN '"Hall"' WHEN 1 THEN '[{{"name": "Hall", "address": "1 Elm"}}]' WHEN 2 THEN '{{"@type": "EventVenue", "name": " Hall ", "address": {{"streetAddress": "1 Elm", "addressLocality": "", "postalCode": "9"}}}}' ELSE 'null' END
    || ', "offers": ' || CASE page_id % 7 WHEN 0 THEN '{{"price": 0}}' WHEN 1 THEN '[{{"price": "", "priceCurrency": "USD"}}]' WHEN 2 THEN '{{"price": "12.50", "priceCurrency": "USD"}}' WHEN 3 THEN '{{"lowPrice": 7, "priceCurrency": ["USD"]}}' WHEN 4 THEN '{{"price": "ask"}}' WHEN 5 THEN '{{"price": null, "lowPrice": "0.00"}}' ELSE '[]' END || '}}'""".replace("{{", "{").replace("}}", "}").replace("|| page_id ||", "|| cast(page_id AS string) ||").replace("|| page_id WHEN", "|| cast(page_id AS string) WHEN").replace("page_id % 9 ||", "cast(page_id % 9 AS string) ||")
_SCRIPT = f"""CASE page_id % 6 WHEN 0 THEN {_EVENT} WHEN 1 THEN '{{"@graph": [1, ' || {_EVENT} || ', {{"@type": "Thing", "item": ' || {_EVENT} || '}}]}}' WHEN 2 THEN '[[' || {_EVENT} || '], {{"itemListElement": [{{"item": ' || {_EVENT} || '}}]}}]'
    WHEN 3 THEN '{{"@type": "X", "subEvent": ' || {_EVENT} || '}}' WHEN 4 THEN {_EVENT} || ' ' || {_EVENT} ELSE '{{broken' END"""
_HTML = f"""replace(html, '</head>', '<script type="application/ld+json">' || ({_SCRIPT}) || '</script></head>')"""


def _linked(keys: str, salvage: str) -> str:
    """Event objects of the pages by JSON trees; a node counts if only the keys lead to it."""
    return rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS origin, url, {_SCRIPT} AS raw, {_EVENT} AS event FROM pages),
v AS (SELECT page_id, origin, url, unnest(CASE WHEN json_valid(raw) THEN [raw] {salvage} ELSE [] END)::JSON AS j, unnest(CASE WHEN json_valid(raw) THEN [0] {salvage.replace("[event, event]", "[0, 1]")} ELSE [] END) AS k FROM p),
t AS (SELECT v.page_id, v.origin, v.url, v.k, n.id, n.value::JSON AS e FROM v, json_tree(v.j) n WHERE n.type = 'OBJECT' AND regexp_matches(n.fullkey, '^\$(\[\d+\]|\."?({keys})"?)*$')),
events AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY k, id) - 1)::INTEGER AS pos, e->'$.location' AS l0, e->'$.offers' AS o0 FROM t WHERE json_type(e->'$."@type"') IN ('VARCHAR', 'ARRAY') AND regexp_matches((e->'$."@type"')::VARCHAR, '(?i)event')),
x AS (SELECT *, CASE WHEN json_type(l0) = 'ARRAY' THEN l0->'$[0]' ELSE l0 END AS loc, CASE WHEN json_type(o0) = 'ARRAY' THEN o0->'$[0]' ELSE o0 END AS offer, CASE WHEN json_type(e->'$.name') = 'ARRAY' THEN e->>'$.name[0]' ELSE e->>'$.name' END AS name FROM events)
"""


@query(
    "linked_events",
    _linked("@graph|itemListElement|item", "")
    + r"""SELECT page_id, pos, nullif(trim(name), '') AS title, e->>'$.startDate' AS date, nullif(trim(CASE WHEN json_type(loc) = 'VARCHAR' THEN loc->>'$' ELSE loc->>'$.name' END), '') AS venue,
    CASE WHEN json_type(loc->'$.address') = 'VARCHAR' THEN loc->>'$.address' ELSE nullif(concat_ws(', ', nullif(loc->>'$.address.streetAddress', ''), nullif(loc->>'$.address.addressLocality', ''), nullif(loc->>'$.address.postalCode', '')), '') END AS address,
    CASE WHEN e->>'$.url' = '' THEN url WHEN e->>'$.url' LIKE 'https:%' THEN e->>'$.url' WHEN e->>'$.url' LIKE '/%' THEN origin || (e->>'$.url') WHEN e->>'$.url' LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || (e->>'$.url') ELSE regexp_extract(url, '^[^?#]*/') || (e->>'$.url') END AS source_url,
    CASE WHEN trim(coalesce(offer->>'$.price', offer->>'$.lowPrice')) IN ('', '0', '0.00') THEN 'Free' ELSE CASE WHEN coalesce(offer->>'$.priceCurrency[0]', offer->>'$.priceCurrency') = 'USD' THEN '$' ELSE '' END || coalesce(offer->>'$.price', offer->>'$.lowPrice') END AS price FROM x""",
)
def linked_events(spark, sf_dir):
    """X1, F-ABS, F-PLACE, F-PRICE: events of JSON-LD scripts as VARIANT, however nested."""
    p = load(spark, sf_dir, "pages").withColumn("html", F.expr(_HTML))
    rows = p.select("page_id", F.posexplode(jsonld.records(F.col("html"), F.col("url"))).alias("pos", "r"))
    return rows.select("page_id", "pos", *[F.col(f"r.{k}").alias(k) for k in ("title", "date", "venue", "address", "source_url", "price")])


@query(
    "linked_events_wide",
    _linked("@graph|itemListElement|item|subEvent|mainEntity", "WHEN page_id % 6 = 4 THEN [event, event]")
    + r"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k, id) - 1)::INTEGER AS pos, CASE WHEN json_type(e->'$.name') = 'ARRAY' THEN '[" Page ' || page_id || ' ","b"]' ELSE name END AS title, e->>'$.startDate' AS start, CASE WHEN e->>'$.url' = '' THEN url ELSE e->>'$.url' END AS url,
    CASE WHEN offer->>'$.price' IN ('0', '0.0', '0.00') THEN 'Free' ELSE '$' || (offer->>'$.price') END AS price FROM x WHERE name IS NOT NULL""",
)
def linked_events_wide(spark, sf_dir):
    """Named events below more keys, objects in a row read one by one."""
    p = load(spark, sf_dir, "pages").withColumn("html", F.expr(_HTML))
    rows = p.select("page_id", F.posexplode(jsonld.wide_records(F.col("html"), F.col("url"))).alias("pos", "r"))
    return rows.select("page_id", "pos", *[F.col(f"r.{k}").alias(k) for k in ("title", "start", "url", "price")])
