"""Document compiler: digests and crawled pages to typed chunks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm

#: Target and greatest size of a page slice, and the word characters below which one is dropped.
SLICE, LONGEST, LEAST = 1400, 2100, 40
#: The fields of a digest section, in order.
FIELDS = "id slug date when start end all_day venue address city category tags price free family_friendly url tickets source".split()


def normal_lines(c: Column) -> Column:
    """Without byte-order mark, and with plain line ends."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def front_matter(c: Column) -> Column:
    """struct(fields map, body) of a document; without front matter an empty map and the whole text."""
    text = normal_lines(c)
    rx = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    block = F.filter(F.split(F.regexp_extract(text, rx, 1), "\n"), lambda x: F.instr(x, ":") > 1)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))
    has = text.rlike(rx)
    fields = F.when(has, _last_of_each(F.transform(block, pair))).otherwise(F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))
    return F.struct(fields.alias("fields"), F.when(has, F.regexp_extract(text, rx, 2)).otherwise(text).alias("body"))


def _last_of_each(pairs: Column) -> Column:
    """A map of pairs (k, v); of a repeated key the last one counts."""
    return tx.let(pairs, lambda p: F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda q: q["k"] == x["k"]))))


def sections(docs: DataFrame, body: str = "body") -> DataFrame:
    """A row for every section of a digest that has an id: title, fields (map), text; all columns kept."""
    parts = F.split(F.concat(F.lit("\n"), F.col(body)), r"\n(?=## )")
    rows = docs.select("*", F.posexplode(parts).alias("section", "__s")).where(F.col("__s").startswith("## "))
    rx = r"(?s)^## ([^\n]*)((?:\n(?:- [a-z_]+:[^\n]*|[ \t]*(?=\n)))*)\n?(.*)$"
    lines = F.filter(F.split(F.regexp_extract("__s", rx, 2), "\n"), lambda x: x.startswith("- "))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^- ([a-z_]+):", 1).alias("k"), F.nullif(F.trim(F.regexp_replace(x, r"^- [a-z_]+:", "")), F.lit("")).alias("v"))
    text = F.trim(F.regexp_replace(F.regexp_extract("__s", rx, 3), r"^\s+|\s+$", ""))
    out = rows.withColumns({"title": F.trim(F.regexp_extract("__s", rx, 1)), "fields": _last_of_each(F.transform(lines, entry)), "text": F.when(text == "(no description)", "").otherwise(text)})
    return out.where(F.col("fields")["id"].isNotNull()).drop("__s")


def section_text(title: Column, fields: dict[str, Column], description: Column) -> Column:
    """A row as a digest section: the inverse of sections()."""
    line = lambda k: F.concat(F.lit(f"- {k}: "), F.coalesce(fields[k].cast("string"), F.lit("")) if k in fields else F.lit(""))
    body = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), "\r", ""))
    body = F.when(body == "", "(no description)").otherwise(body)
    return F.concat_ws("\n", F.concat(F.lit("## "), tx.collapse(title)), F.lit(""), *map(line, FIELDS), F.lit(""), body)


def digests(rows: DataFrame, source: str, order: str, section: str, header: Column) -> DataFrame:
    """One markdown text per source: a header, then its sections in order. A digest is a file, so as large as its source."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, section))), lambda x: x[section])
    return rows.groupBy(source).agg(F.count("*").alias("events"), parts.alias("parts")).select(source, "events", F.concat(header, F.array_join("parts", "\n\n"), F.lit("\n")).alias("markdown"))


def clean_markdown(c: Column) -> Column:
    """The words of crawled markdown: no images, links to their text, no tags, no rules, single spaces."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("<[^>]+>", ""), (r"(?m)^\s*[-*_]{3,}\s*$", ""), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dates_in(c: Column, crawled: Column | None = None, checked: bool = False) -> Column:
    """Sorted distinct yyyy-MM-dd of a text: ISO, month/day/year, and month names, whose next occurrence from the crawl day on is meant without a year. `checked` drops days that no calendar has."""
    two = lambda x: F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 2, "0")
    iso = F.regexp_extract_all(c, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    us_rx = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    us = F.transform(F.regexp_extract_all(c, F.lit(us_rx), F.lit(0)), lambda m: F.concat_ws("-", F.regexp_extract(m, us_rx, 3), two(F.regexp_extract(m, us_rx, 1)), two(F.regexp_extract(m, us_rx, 2))))
    rx = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"
    months = F.array(*map(F.lit, tm.MONTHS))

    def named(m):
        month = F.array_position(months, F.lower(F.substring(F.regexp_extract(m, rx, 1), 1, 3)))
        day, year = F.regexp_extract(m, rx, 2), F.regexp_extract(m, rx, 3)
        rest = F.concat(F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), two(day))
        base = F.date_format(crawled, "yyyy-MM-dd") if crawled is not None else F.lit(None).cast("string")
        this = F.concat(F.substring(base, 1, 4), rest)
        following = F.concat((F.substring(base, 1, 4).cast("int") + 1).cast("string"), rest)
        whole = F.when(year != "", F.concat(year, rest)).when(this < base, following).otherwise(this)
        return F.when(day.cast("int").between(1, 31), whole)

    out = F.concat(iso, us, F.filter(F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(0)), named), lambda d: d.isNotNull()))
    if checked:
        out = F.filter(out, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())
    return F.array_sort(F.array_distinct(out))


def slices(c: Column) -> Column:
    """A text packed greedily by paragraphs into slices of about SLICE characters; what is longer than LONGEST is cut hard.

    The fold only moves places in the joined paragraphs; the slices are cut from those at the end.
    """
    paras = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    kind = "array<struct<a:int,b:int>>"
    piece = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("at"))

    def add(acc, n):
        full = (acc["b"] > acc["a"]) & (acc["b"] - acc["a"] + n + 2 > SLICE)
        fresh = full | (acc["b"] == acc["a"])
        start = F.when(fresh, acc["at"]).otherwise(acc["a"])
        done = F.when(full, F.concat(acc["done"], F.array(piece(acc["a"], acc["b"])))).otherwise(acc["done"])
        end = acc["at"] + n
        k = F.greatest(F.ceil((end - start - LONGEST) / SLICE), F.lit(0)).cast("int")
        hard = F.transform(F.filter(F.sequence(F.lit(0), k), lambda i: i < k), lambda i: piece(start + i * SLICE, start + (i + 1) * SLICE))
        return F.struct(F.when(k > 0, F.concat(done, hard)).otherwise(done).alias("done"), (start + k * SLICE).cast("int").alias("a"), end.cast("int").alias("b"), (end + 2).cast("int").alias("at"))

    last = lambda acc: F.when(acc["b"] > acc["a"], F.concat(acc["done"], F.array(piece(acc["a"], acc["b"])))).otherwise(acc["done"])
    both = lambda p: F.struct(F.array_join(p, "\n\n").alias("text"), F.aggregate(F.transform(p, lambda x: F.length(x)), zero, add, last).alias("at"))
    return tx.let(tx.let(paras, both), lambda x: F.transform(x["at"], lambda s: F.substring(x["text"], s["a"] + 1, s["b"] - s["a"])))


def city_in(c: Column, cities) -> Column:
    """The first of the cities, in their order, that the text names."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(tx.contains_any_case(c, x), F.lit(x)) for x in cities])


def city_of(address: Column, venue: Column, tags: Column | None, cities, home_tag: str | None = None) -> Column:
    """City by address and venue, else the home town by its tag."""
    where = F.concat_ws(" ", address, venue)
    by_tag = F.when(F.coalesce(F.array_contains(tags, home_tag), F.lit(False)), F.lit(cities[0])) if tags is not None and home_tag else F.lit(None).cast("string")
    return F.coalesce(city_in(where, cities), by_tag)


def page_chunks(pages: DataFrame, doc: str, text: str, title: Column, crawled: Column | None = None, cities=()) -> DataFrame:
    """Slices of pages as chunks; numbered after short ones are dropped, titled by part if the page had several."""
    kept = lambda s: F.struct(F.size(s).alias("n"), F.filter(s, lambda x: F.length(F.regexp_replace(x, r"\W", "")) > LEAST).alias("texts"))
    rows = pages.withColumns({"__title": title, "__s": tx.let(slices(clean_markdown(F.col(text))), kept)})
    # an outer explode: a plain one would make Spark work the slices out once more, to test for empty lists
    rows = rows.select("*", F.col("__s.n").alias("__n"), F.posexplode_outer("__s.texts").alias("__i", "__text")).where(F.col("__text").isNotNull())
    dates = dates_in(F.col("__text"), crawled)
    part = F.concat(F.col("__title"), F.lit(" (part "), (F.col("__i") + 1).cast("string"), F.lit(")"))
    return rows.withColumn("__dates", dates).select(
        F.concat(F.col(doc).cast("string"), F.lit("#"), (F.col("__i") + 1).cast("string")).alias("id"),
        F.lit("page").alias("kind"), F.col(doc).alias("doc"),
        F.when(F.col("__n") > 1, part).otherwise(F.col("__title")).alias("title"),
        F.get("__dates", F.lit(0)).alias("date"),
        F.when(F.size("__dates") > 1, F.element_at("__dates", -1)).alias("end_date"),
        city_in(F.col("__text"), cities).alias("city"), F.col("__text").alias("text"),
    )


def event_chunks(events: DataFrame, doc: Column, cities=(), home_tag: str | None = None, zone: str = tm.ZONE) -> DataFrame:
    """Events as chunks, with a summary of 600 characters."""
    return events.select(
        "id", F.lit("event").alias("kind"), doc.alias("doc"), F.coalesce("source_name", F.lit("Unknown source")).alias("source"),
        F.col("source_url").alias("url"), "title", tm.local_day(F.col("start_at"), zone).alias("date"), F.lit(None).cast("string").alias("end_date"),
        F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss").alias("start_at"), F.date_format("end_at", "yyyy-MM-dd'T'HH:mm:ss").alias("end_at"),
        F.coalesce(F.array_contains("tags", "all-day"), F.lit(False)).alias("all_day"), "venue", "address",
        city_of(F.col("address"), F.col("venue"), F.col("tags"), cities, home_tag).alias("city"), "category", "price",
        F.coalesce("is_free", F.lit(False)).alias("is_free"), F.coalesce("is_family_friendly", F.lit(False)).alias("is_family_friendly"),
        F.concat(F.lit("/events/"), F.coalesce("slug", F.col("id"))).alias("link"), tx.summary(F.col("description"), 600).alias("text"),
    )


def completed_address(address: Column, city: Column, state: str = "CA") -> Column:
    """The address with its city, unless it names it."""
    full = F.concat(city, F.lit(f", {state}"))
    blank = F.coalesce(address, F.lit("")) == ""
    return F.when(city.isNull(), address).when(blank, full).when(~F.contains(F.lower(address), F.lower(city)), F.concat(address, F.lit(", "), full)).otherwise(address)


def event_slug(title: Column, id_: Column) -> Column:
    return F.concat(tx.slug(title, 70), F.lit("-"), F.substring(id_, 1, 6))


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count_distinct("doc").alias("documents"), F.count_if(F.col("kind") == "event").alias("event_chunks"), F.count_if(F.col("kind") == "page").alias("page_chunks"))


def live_chunks(events: DataFrame, bundled: DataFrame) -> DataFrame:
    """The table that is searched: chunks of live events, and of the bundled ones the pages; without live events all bundled ones."""
    return bundled if events.isEmpty() else events.unionByName(bundled.where(F.col("kind") == "page"), allowMissingColumns=True)


def write_digests(sections_: DataFrame, path: str, source: str = "source", order: str = "start_at", text: str = "section") -> None:
    """Sections as text files in a folder of each source, in order, one blank line after each. A large source is several files, in order too."""
    n = int(sections_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sections_.select(source, order, F.concat(F.col(text), F.lit("\n")).alias("value"))
    rows.repartitionByRange(n, source, order).sortWithinPartitions(source, order).select(source, "value").write.partitionBy(source).text(path)
