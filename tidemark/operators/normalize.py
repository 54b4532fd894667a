"""Raw listing records to typed events: classification, geography, checks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm
from tidemark.operators.dedupe import ordered_rejects, record_id

#: Categories with the patterns that decide them, first match wins.
CATEGORY_RULES = (
    ("music", r"\b(concert|live music|band|dj|acoustic|jazz|symphony|orchestra|tribute|open mic|karaoke|singer|blues|rock|tunes|sings?)\b"),
    ("festival", r"\b(festival|fest\b|parade|fair\b|palooza|carnival|gathering|games\b)\b"),
    ("market", r"\b(farmers.? market|market\b|craft fair|flea|thrift|vendor|bazaar|swap meet)\b"),
    ("food-drink", r"\b(wine|winery|tasting|brew|beer|cocktail|dinner|brunch|food truck|culinary|stroll|pairing|vineyard|sips?|cork|taproom|happy hour)\b"),
    ("family", r"\b(kids?|children|family|storytime|story time|toddler|teen|youth|bunny|santa|halloween|trick.or.treat|corgi|petting)\b"),
    ("arts", r"\b(art|gallery|exhibit|theat(er|re)|museum|play\b|comedy|dance|ballet|film|screening|craft|paint|photograph|author|book)\b"),
    ("sports", r"\b(run\b|5k|10k|race|yoga|fitness|hike|hiking|walk\b|swim|golf|tournament|mma|bike|cycling|pickleball|soccer|baseball)\b"),
    ("education", r"\b(class|workshop|lecture|seminar|training|tutor|lesson|talk\b|learn|genealogy|citizenship|library)\b"),
    ("nightlife", r"\b(nightlife|bar crawl|late night|after dark|pub crawl|21\+)\b"),
    ("community", r"\b(council|meeting|volunteer|blood drive|clean.?up|town hall|support group|senior|nonprofit|fundraiser|commission)\b"),
)
#: Fixed value: descriptions that say nothing.
JUNK = r"(?i)^(\W+|event details|read more|details|more info|[\d\s:.apm]+mi)$"


@dataclass(frozen=True)
class Region:
    """The area that rows must be in: the home town with its venues, nearby towns, and other towns that names may point to."""

    home: str
    venues: tuple[str, ...] = ()
    nearby: tuple[str, ...] = ()
    elsewhere: tuple[str, ...] = ()
    source_city: tuple[tuple[str, str], ...] = ()
    source_region: tuple[tuple[str, str], ...] = ()
    area: str = "nearby"

    def city(self, address: Column, venue: Column, url: Column, title: Column, description: Column, source: Column) -> Column:
        """Strongest sign first: in each field the home town before any other; then its venues in the description; then the source's own."""
        home = rf"(?i)\b{self.home}\b"
        venues = rf"(?i)\b({'|'.join(self.venues)})\b" if self.venues else "(?!)"
        towns = rf"(?i)\b({'|'.join((*self.nearby, *self.elsewhere))})\b" if self.nearby or self.elsewhere else "(?!)"
        signs = []
        for f in (address, venue, url, title):
            signs.append(F.when(f.rlike(home) | f.rlike(venues), F.lit(self.home)))
            signs.append(F.when(f.rlike(towns), F.initcap(F.regexp_extract(f, towns, 1) if self.nearby or self.elsewhere else F.lit(""))))
        signs.append(F.when(description.rlike(venues), F.lit(self.home)))
        signs += [F.when(source == s, F.lit(c)) for s, c in self.source_city]
        return F.coalesce(*signs)

    def region(self, city: Column, source: Column) -> Column:
        """home, the area, `out-of-area` for other towns; null where nothing is known."""
        own = [F.when(source == s, F.lit(r)) for s, r in self.source_region]
        unknown = F.coalesce(F.lit(None).cast("string"), *own)
        return F.when(city == self.home, F.lit(self.home)).when(F.lower(city).isin([x.lower() for x in self.nearby]), F.lit(self.area)).when(city.isNotNull(), "out-of-area").otherwise(unknown)


def clean_title(c: Column) -> Column:
    """Markdown links to their text, no leading marks; null under four characters."""
    out = tx.clean_html(F.regexp_replace(F.regexp_replace(tx.clean_html(c), r"\[(.+?)\]\([^)]*\)", "$1"), r"^[#*>\s]+", ""))
    return F.when(F.length(out) >= 4, out)


def clean_description(c: Column, most: int = 900) -> Column:
    out = tx.clean_html(c)
    out = F.when((F.length(out) >= 12) & ~out.rlike(JUNK), out)
    head = F.regexp_replace(F.substring(out, 1, most - 3), r" [^ ]*$", "")
    return F.when(F.length(out) > most, F.concat(head, F.lit("…"))).otherwise(out)


def normalised(raw: DataFrame, region: Region, first: dt.date, last: dt.date, excluded: tuple[str, ...] = (), rules=CATEGORY_RULES, policy: str = "fixed", order: str = "ord") -> DataFrame:
    """All raw rows with their normalised columns and `reject_reason` (null: kept), in the order of the reasons."""
    title, desc, venue = clean_title(F.col("title")), clean_description(F.col("description")), tx.clean_html(F.col("venue"))
    start = tm.iso_start(F.col("start"), F.coalesce("time", "time_text"), first.year, policy)
    end = tm.iso_start(F.col("end"), F.col("end_time_text"), first.year, policy)
    rows = raw.withColumns({"__t": title, "__d": desc, "__s": start, "__e": end})
    rows = rows.withColumn("city", region.city(F.col("address"), F.col("venue"), F.col("url"), F.col("__t"), F.col("__d"), F.col("source")))
    rows = rows.withColumn("region", region.region(F.col("city"), F.col("source")))
    category = tx.classify(F.concat_ws(" ", "__t", "__d", "venue", F.concat_ws(" ", "tags")), rules)
    price = tx.clean_html(F.col("price"))
    rows = rows.withColumns({"category": category, "price": price, "day": F.date_format("__s.day", "yyyy-MM-dd")}).withColumns(
        {
            "id": record_id(F.col("__t"), F.col("day")), "title_key": tx.title_key(F.col("__t")), "start_at": F.col("__s.iso"),
            "end_at": F.when(F.col("__e.iso") > F.col("__s.iso"), F.col("__e.iso")), "all_day": ~F.col("__s.had_time"),
            "venue": F.when(F.lower(venue) != F.lower(F.col("__t")), venue), "is_free": tx.is_free(F.col("price"), F.col("__t")),
            "is_family_friendly": F.col("category").isin(*tx.FAMILY_CATEGORIES), "title": F.col("__t"), "description": F.col("__d"),
        }
    )
    reasons = [
        ("excluded-source", F.coalesce(F.col("source").isin(list(excluded)), F.lit(False)) if excluded else F.lit(False)),
        ("no-title", F.col("title").isNull()),
        ("no-date", F.col("start_at").isNull()),
        ("out-of-window", ~F.col("__s.day").between(F.lit(first), F.lit(last))),
        ("out-of-area", F.col("region") == "out-of-area"),
        ("no-location", F.col("region").isNull()),
    ]
    return ordered_rejects(rows, reasons, ["title_key", "day"], [order]).drop("__t", "__d", "__s", "__e")


def heuristic(raw: DataFrame) -> DataFrame:
    """Records of the scheduled ingest: a title and a date that parses are required; price and family are inferred."""
    at = lambda c: F.coalesce(F.try_to_timestamp(c), tm.parse_date(c).cast("timestamp"))
    start = at(F.coalesce(F.nullif("start_time", F.lit("")), F.col("date")))
    free = tx.is_free_loose(F.col("price"), F.col("description"))
    rows = raw.where(F.coalesce("title", F.lit("")) != "").withColumns({"start_at": start, "is_free": free}).where("start_at IS NOT NULL")
    return rows.select(
        F.trim("title").alias("title"), F.nullif(F.substring(F.trim("description"), 1, 600), F.lit("")).alias("description"), "start_at", at(F.col("end_time")).alias("end_at"),
        F.nullif("venue", F.lit("")).alias("venue"), F.nullif("address", F.lit("")).alias("address"), F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category"),
        F.array().cast("array<string>").alias("tags"), F.coalesce(F.nullif("price", F.lit("")), F.when(F.col("is_free"), "Free")).alias("price"), "is_free",
        tx.is_family(F.col("is_family_friendly"), F.col("title"), F.coalesce("description", F.lit(""))).alias("is_family_friendly"), "image_url", "source_url",
    )


def checked_model_rows(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Rows that a model has made: those without a date that parses go, unknown categories become other, six tags stay."""
    at = F.try_to_timestamp("start_at")
    return rows.withColumn("start_at", at).where("start_at IS NOT NULL").withColumns(
        {"title": F.trim("title"), "category": F.when(F.col("category").isin(list(categories)), F.col("category")).otherwise("other"), "tags": F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6), "end_at": F.try_to_timestamp("end_at")}
    )


def filled_images(events: DataFrame, by_id: DataFrame, by_title: DataFrame, pool: list[str]) -> DataFrame:
    """An image for every event: its own, else by id, else by source and title key, else one of the pool by hash; with where it came from."""
    a = by_id.select(F.col("id").alias("__id"), F.col("image").alias("__page"))
    b = by_title.select(F.col("source").alias("__s"), F.col("key").alias("__k"), F.col("image").alias("__listed"))
    rows = events.join(a, F.col("id") == F.col("__id"), "left").join(b, (F.col("source_name") == F.col("__s")) & (tx.title_key(F.col("title")) == F.col("__k")), "left")
    stock = F.get(F.array(*map(F.lit, pool)), tx.hash_mod(F.col("id"), len(pool)).cast("int"))
    own = F.nullif("image_url", F.lit(""))
    came = F.when(own.isNotNull(), "listing").when(F.col("__page").isNotNull(), "event-page").when(F.col("__listed").isNotNull(), "listing").otherwise("category-stock")
    return rows.withColumns({"image_source": came, "image_url": F.coalesce(own, "__page", "__listed", stock)}).drop("__id", "__page", "__s", "__k", "__listed")
