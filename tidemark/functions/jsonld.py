"""JSON-LD of pages as VARIANT: the walk over a page's values is one fold by levels, in the JVM.

Values that can't be read, and those of which a key stands twice in one object, give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import clean_html, let

#: Keys below which listings nest events.
KEYS = ("@graph", "itemListElement", "item")
WIDE_KEYS = (*KEYS, "subEvent", "mainEntity")
SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: One of several objects in a row.
OBJECT = r"(?s)\{.*?\}(?=\s*[\{\[]|\s*$)"
_NODES = "array<struct<path:array<int>,v:variant>>"


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path as a kind; null if there is none, or none of that kind."""
    return F.try_variant_get(v, path, kind)


def key(v: Column, name: str, kind: str = "variant") -> Column:
    return at(v, f"$['{name}']", kind)


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def head(v: Column, deep: int = 3) -> Column:
    """The first element of a list, and of a list that stands first in one; any other value itself."""
    for _ in range(deep):
        v = let(v, lambda x: F.when(is_kind(x, "ARRAY"), at(x, "$[0]")).otherwise(x))
    return v


def first_text(v: Column) -> Column:
    """Trimmed text of a value that is one, or that starts with one; null if it is empty or of another kind."""
    return let(head(v), lambda x: F.nullif(F.trim(F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), F.lit("")))


def parsed(raw: Column) -> Column:
    """The one JSON value of a text; null if it can't be read or more follows, which the parser alone lets pass."""
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.when(alone, at(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$[0]"))


def values(raw: Column, salvage: bool) -> Column:
    """The values of a script: one, or with `salvage` the objects in a row that can be read."""
    whole = parsed(raw)
    if not salvage:
        return F.array(whole)
    parts = F.transform(F.regexp_extract_all(raw, F.lit(OBJECT), F.lit(0)), parsed)
    return let(whole, lambda x: F.when(x.isNull(), parts).otherwise(F.array(x)))


def events(raws: Column, keys: tuple[str, ...] = KEYS, named: bool = False, salvage: bool = False) -> Column:
    """Objects whose type names an event, in document order, from an array of scripts; `named`: only those with a name.

    The fold takes one level of nesting at a time, as many as there are brackets at the most.
    """
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    there = lambda nodes: F.filter(nodes, lambda n: n["v"].isNotNull())
    first = F.flatten(F.transform(raws, lambda raw, i: F.transform(values(raw, salvage), lambda v, j: node(F.array(i, j), v))))
    none = F.array().cast(_NODES)

    def below(n: Column) -> Column:
        items = F.coalesce(at(n["v"], "$", "array<variant>"), F.array().cast("array<variant>"))
        parts = F.concat(items, F.array(*[key(n["v"], k) for k in keys]))
        return there(F.transform(parts, lambda v, i: node(F.concat(n["path"], F.array(i)), v)))

    def is_event(n: Column) -> Column:
        kind = key(n["v"], "@type")
        out = F.when(is_kind(kind, "STRING") | is_kind(kind, "ARRAY"), F.to_json(kind).rlike("(?i)event")).otherwise(F.lit(False))
        if named:
            name = key(n["v"], "name")
            out = out & F.coalesce(~F.to_json(name).isin('""', "null", "false", "0", "[]", "{}"), F.lit(False))
        return F.coalesce(out, F.lit(False))

    def level(acc: Column, _: Column) -> Column:
        more = F.struct(F.flatten(F.transform(acc["todo"], below)).alias("todo"), F.concat(acc["done"], F.filter(acc["todo"], is_event)).alias("done"))
        return F.when(F.size(acc["todo"]) > 0, more).otherwise(acc)

    levels = F.sequence(F.lit(0), F.aggregate(raws, F.lit(0), lambda n, raw: n + F.size(F.split(raw, r"[\[{]"))))
    done = F.aggregate(levels, F.struct(F.coalesce(there(first), none).alias("todo"), none.alias("done")), level)["done"]
    ordered = F.array_sort(done, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return F.transform(ordered, lambda n: n["v"])


def _joined(parts: list[Column]) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def place(v: Column, clean=first_text) -> Column:
    """struct(venue, address) of a location: a text, an object, or the first of a list. `clean` reads texts."""
    parts = lambda a: _joined([clean(key(a, k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")])

    def of(x: Column) -> Column:
        a = key(x, "address")
        text = F.nullif(x.cast("string"), F.lit(""))
        venue = F.when(is_kind(x, "STRING"), text).when(is_kind(x, "OBJECT"), clean(key(x, "name")))
        address = F.when(is_kind(x, "OBJECT"), F.when(is_kind(a, "STRING"), F.nullif(a.cast("string"), F.lit(""))).when(is_kind(a, "OBJECT"), parts(a)))
        return F.struct(venue.alias("venue"), address.alias("address"))

    return let(head(v), of)


def price(v: Column) -> Column:
    """Price of the first offer, its low price if it has none: Free for 0 and for an empty text, with $ for US dollars."""

    def of(x: Column) -> Column:
        said = F.coalesce(key(x, "price", "string"), key(x, "lowPrice", "string"))
        nothing = (F.trim(said) == "") | (F.trim(said).try_cast("double") == 0) | (said == "false")
        sign = F.when(first_text(key(x, "priceCurrency")) == "USD", "$").otherwise("")
        return F.when(F.coalesce(nothing, F.lit(False)), "Free").when(said.isNotNull(), F.concat(sign, said))

    return let(head(v, 1), of)


def absolute(base: Column, href: Column) -> Column:
    """An address as seen from a page's: with its scheme and host, without . and .. in its path. Null or empty: null."""
    rx = r"(?i)^([a-z][a-z0-9+.-]*:)//([^/?#]*)([^?#]*)"
    scheme, host, path = (F.regexp_extract(base, rx, i) for i in (1, 2, 3))
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("//"), host, href))
        .when(href.startswith("?"), F.concat(scheme, F.lit("//"), host, F.when(path == "", "/").otherwise(path), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), href))
        .otherwise(F.concat(scheme, F.lit("//"), host, F.when(folder == "", "/").otherwise(folder), href))
    )
    whole = F.when(base.rlike(rx) | href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), whole).otherwise(href)

    def tidy(x: Column) -> Column:
        tail = F.regexp_extract(x, r"^[^?#]*([?#].*)$", 1)
        steps = F.split(F.regexp_extract(x, rx, 3), "/")
        n = F.size(steps)

        def step(acc: Column, s: Column) -> Column:
            up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            return F.when(s == "..", F.when(F.size(acc) > 1, up).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

        kept = F.aggregate(steps, F.array().cast("array<string>"), step)
        kept = F.when(F.element_at(steps, n).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        way = F.array_join(kept, "/")
        out = F.concat(F.lower(F.regexp_extract(x, rx, 1)), F.lit("//"), F.lower(F.regexp_extract(x, rx, 2)), F.when(way == "", "/").otherwise(way), tail)
        return F.replace(F.when(x.rlike(r"(?i)^https?://[^/?#]"), out).otherwise(x), F.lit(" "), F.lit("%20"))

    return F.when(F.coalesce(href, F.lit("")) != "", let(whole, tidy))


def records(html: Column, url: Column) -> Column:
    """Records of a page's events: title, date, start_time, end_time, venue, address, description, image_url, source_url, price."""

    def of(v: Column) -> Column:
        own = lambda k: first_text(key(v, k))
        where = place(key(v, "location"))
        return let(
            F.struct(where.alias("where"), own("startDate").alias("start")),
            lambda x: F.struct(
                own("name").alias("title"), x["start"].alias("date"), x["start"].alias("start_time"), own("endDate").alias("end_time"), x["where"]["venue"].alias("venue"), x["where"]["address"].alias("address"),
                own("description").alias("description"), absolute(url, own("image")).alias("image_url"), F.coalesce(absolute(url, own("url")), url).alias("source_url"), price(key(v, "offers")).alias("price"),
            ),
        )

    return F.transform(events(scripts(html)), of)


def clean(v: Column) -> Column:
    """Any value as a text without tags; null for none."""
    return clean_html(v.cast("string"))


def wide_records(html: Column, url: Column) -> Column:
    """Records of named events anywhere in a page's scripts, broken ones salvaged: title, start, end, venue, address, description, image, url, price."""

    def of(v: Column) -> Column:
        own = lambda k: clean(key(v, k))
        offer = head(key(v, "offers"), 1)
        said = key(offer, "price", "string")
        image = let(head(key(v, "image"), 1), lambda x: clean(F.when(is_kind(x, "OBJECT"), key(x, "url")).otherwise(x)))
        where = place(key(v, "location"), clean)
        return F.struct(
            own("name").alias("title"), own("startDate").alias("start"), own("endDate").alias("end"), clean_html(where["venue"]).alias("venue"), clean_html(where["address"]).alias("address"), own("description").alias("description"),
            image.alias("image"), F.coalesce(own("url"), url).alias("url"), F.when(said.isin("0", "0.0", "0.00"), "Free").otherwise(F.concat(F.lit("$"), said)).alias("price"),
        )

    return F.transform(events(scripts(html), WIDE_KEYS, named=True, salvage=True), of)
