"""Listing queries: filters folded into one predicate, day groups, months, top-k rails.

The operators take any table with the columns of `LISTING`; `as_of` is explicit. Filters are plain column
predicates, so what Parquet can skip, it skips.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm

#: Tags that mark rows rather than describe them.
ALL_DAY = "all-day"


@dataclass(frozen=True)
class Listing:
    """Names of the columns that listing operators read."""

    id: str = "id"
    start: str = "start_at"
    category: str = "category"
    status: str = "status"
    duplicate_of: str = "duplicate_of"
    free: str = "is_free"
    family: str = "is_family_friendly"
    places: tuple[str, ...] = ("venue", "address")
    texts: tuple[str, ...] = ("title", "description", "venue")
    tags: str | None = "tags"
    hidden_tags: tuple[str, ...] = (ALL_DAY,)
    zone: str = tm.ZONE


@dataclass(frozen=True)
class EventFilters:
    """What a caller may ask for; None asks nothing."""

    category: str | None = None
    free: bool = False
    family: bool = False
    location: str | None = None
    search: str | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    columns: Listing = field(default_factory=Listing)

    def predicate(self) -> Column:
        c, p = self.columns, F.lit(True)
        if self.category:
            p = p & (F.col(c.category) == self.category)
        if self.free:
            p = p & F.coalesce(F.col(c.free), F.lit(False))
        if self.family:
            p = p & F.coalesce(F.col(c.family), F.lit(False))
        if self.location:
            p = p & any_of([tx.contains_any_case(F.col(x), self.location) for x in c.places])
        if self.search:
            hits = [tx.contains_any_case(F.col(x), self.search) for x in c.texts]
            if c.tags:
                hits.append(F.coalesce(F.exists(visible_tags(F.col(c.tags), c.hidden_tags), lambda t: F.contains(F.lower(t), F.lit(self.search.lower()))), F.lit(False)))
            p = p & any_of(hits)
        if self.start is not None:
            p = p & (F.col(c.start) >= F.lit(self.start))
        if self.end is not None:
            p = p & (F.col(c.start) <= F.lit(self.end))
        return p


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def visible_tags(tags: Column, hidden=(ALL_DAY,)) -> Column:
    return F.filter(tags, lambda t: ~t.isin(list(hidden)))


def with_tag(tags: Column, tag: str, on: Column) -> Column:
    """The tags without the marker, and with it at the end where `on`."""
    rest = F.array_remove(F.coalesce(tags, F.array().cast("array<string>")), tag)
    return F.when(on, F.concat(rest, F.array(F.lit(tag)))).otherwise(rest)


def has_tag(tags: Column, tag: str = ALL_DAY) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def public(df: DataFrame, c: Listing = Listing()) -> DataFrame:
    """Approved rows, duplicates included: what anyone may read."""
    return df.where(F.col(c.status) == "approved")


def visible(df: DataFrame, c: Listing = Listing()) -> DataFrame:
    """Approved rows that are no duplicate."""
    return public(df, c).where(F.col(c.duplicate_of).isNull())


def filtered(df: DataFrame, filters: EventFilters) -> DataFrame:
    return df.where(filters.predicate())


def upcoming(df: DataFrame, as_of: dt.datetime, c: Listing = Listing(), grace=dt.timedelta(hours=3)) -> DataFrame:
    return df.where(F.col(c.start) >= F.lit(as_of - grace))


def within(df: DataFrame, as_of: dt.datetime, span=dt.timedelta(days=7), c: Listing = Listing()) -> DataFrame:
    return df.where(F.col(c.start) <= F.lit(as_of + span))


def on_days(df: DataFrame, days: list[str], c: Listing = Listing()) -> DataFrame:
    """Rows of some local days. The instants that bound the days are tested too: those reach the scan."""
    if not days:
        return df.limit(0)
    first, last = dt.datetime.fromisoformat(min(days)) - dt.timedelta(days=1), dt.datetime.fromisoformat(max(days)) + dt.timedelta(days=2)
    near = F.col(c.start).between(F.lit(first), F.lit(last))
    return df.where(near & tm.local_day(F.col(c.start), c.zone).isin(days))


def today(df: DataFrame, as_of: dt.datetime, c: Listing = Listing()) -> DataFrame:
    return on_days(df, [tm.day_of(as_of, c.zone).isoformat()], c)


def weekend(df: DataFrame, as_of: dt.datetime, c: Listing = Listing()) -> DataFrame:
    return on_days(df, tm.weekend_listing(as_of, c.zone), c)


def coming_weekend(df: DataFrame, as_of: dt.datetime, c: Listing = Listing()) -> DataFrame:
    """The weekend of `weekend_range`."""
    first, last = map(dt.date.fromisoformat, tm.weekend_range(as_of, c.zone))
    return on_days(df, [(first + dt.timedelta(i)).isoformat() for i in range((last - first).days + 1)], c)


def overlapping(start: Column, end: Column, first: str | None = None, last: str | None = None) -> Column:
    """Closed interval [start, end or start] meets [first, last]; open bounds allowed; a null start never does."""
    p = start.isNotNull()
    if first is not None:
        p = p & (F.coalesce(end, start) >= F.lit(first))
    if last is not None:
        p = p & (start <= F.lit(last))
    return p


def by_day(df: DataFrame, *rows: str, c: Listing = Listing(), **aggs: Column) -> DataFrame:
    """Rows of each local day in order of start, as an array of structs `rows`, with further aggregates."""
    day = tm.local_day(F.col(c.start), c.zone).alias("day")
    items = F.array_sort(F.collect_list(F.struct(c.start, *rows))).alias("items")
    return df.groupBy(day).agg(items, *[v.alias(k) for k, v in aggs.items()])


def day_facet(df: DataFrame, day: Column, missing: str = "undated", **aggs: Column) -> DataFrame:
    """Matches by day, before any limit; no day counts under `missing`."""
    return df.groupBy(F.coalesce(day, F.lit(missing)).alias("day")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in aggs.items()])


def month_rollup(df: DataFrame, day: Column, *aggs: Column) -> DataFrame:
    """Counts by day, by month (day null) and in all (both null), in one pass."""
    d = df.withColumn("day", day).withColumn("month", F.substring("day", 1, 7))
    return d.rollup("month", "day").agg(F.count("*").alias("n"), *aggs)


def month_nav(df: DataFrame, month: Column, asked: str | None, current: str) -> DataFrame:
    """One row: the active month (asked for, else the current one, else the earliest, as far as it has rows) and its neighbours that have rows."""
    w = Window.orderBy("month")  # a row per month
    months = df.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    months = months.withColumns({"prev": F.lag("month").over(w), "next": F.lead("month").over(w)})
    rank = F.when(F.col("month") == F.lit(asked), 0).when(F.col("month") == F.lit(current), 1).otherwise(2)
    return months.orderBy(rank, "month").limit(1)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, more: bool = True) -> DataFrame:
    """The first k rows of each group, with their number `pos` and, if asked for, how many more the group has (`more`).

    Every task keeps only its first k of a group before the shuffle; what a group has more is counted on the side.
    """
    first = df.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("pos") <= k)
    if not more:
        return first
    rest = df.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return first.join(rest, reduce(and_, same)).drop(*[f"__g{i}" for i in range(len(group))])


def related(df: DataFrame, id_col: str, group: str, order: list[str], k: int = 3) -> DataFrame:
    """For every row the first k other rows of its category; for a row without one the first k others of all.

    The k + 1 first of a category serve all its rows: no self-join of whole categories.
    """
    w = Window.partitionBy(group).orderBy(*order)
    own = df.where(F.col(group).isNotNull()).select(id_col, group, *order).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k + 1)
    every = df.select(id_col, *order).orderBy(*order).limit(k + 1).select(id_col, F.lit(None).cast(df.schema[group].dataType).alias(group), F.struct(*order).alias("pos"))
    head = lambda rows: rows.groupBy(F.col(group).alias("__g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(id_col).alias("id")))), lambda h: h["id"]).alias("heads"))
    rows = df.select(id_col, group).join(head(own).unionByName(head(every)), F.col(group).eqNullSafe(F.col("__g")))
    others = F.slice(F.filter("heads", lambda h: h != F.col(id_col)), 1, k)
    return rows.select(id_col, F.posexplode(others).alias("at", "h")).select(id_col, (F.col("at") + 1).alias("rank"), F.col("h").alias("related_id"))


def by_id_or_slug(df: DataFrame, key: str, id_col: str = "id", slug_col: str = "slug") -> DataFrame:
    """Point lookup: a UUID is an id, all else a slug."""
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return df.where(F.when(F.lit(key).rlike(uuid), F.col(id_col) == key).otherwise(F.col(slug_col) == key)).limit(1)
