"""Writers: versioned upserts, appends, JSON, NDJSON, markdown, iCalendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """Existing rows that the new ones don't replace, and the new ones (the last of a key by `order`, where given)."""
    if order is not None:
        row = F.struct(*[F.col(c) for c in new.columns])
        new = new.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a table's next version beside the one that it may be reading; readers switch to the returned path."""
    to = f"{path}/v={version}"
    df.write.parquet(to)
    return to


def deleted(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(key).isin(values), F.lit(False)))


def touched(sources: DataFrame, runs: DataFrame, key: str = "source") -> DataFrame:
    """Sources with time and status of their run in this batch."""
    r = runs.select(F.col(key).alias("__k"), F.col("finished_at").alias("__at"), F.col("status").alias("__st"))
    out = sources.join(r, F.col(key) == F.col("__k"), "left")
    return out.withColumns({"last_run_at": F.coalesce("__at", "last_run_at"), "last_status": F.coalesce("__st", "last_status")}).drop("__k", "__at", "__st")


def ndjson_lines(df: DataFrame) -> DataFrame:
    """value: each row as one JSON line, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    ndjson_lines(df).write.text(path)


def page(df: DataFrame, order: list, limit: int | None) -> tuple[int, DataFrame]:
    """Number of matches and the first of them: 100 where no limit is given, 200 at the most; a negative limit leaves off that many at the end."""
    n = df.count()
    k = min(limit or 100, 200)
    return n, df.orderBy(*order).limit(max(0, n + k) if k < 0 else k)


def ics_time(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def ics_escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def calendar_entry(id_: Column, start: Column, end: Column, title: Column, description: Column, place: Column, url: Column, stamp: dt.datetime, host: str = "tidemark") -> Column:
    """An iCalendar text of one event; without an end it takes two hours."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), c))
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:-//{host}//EN"), F.lit("CALSCALE:GREGORIAN"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), id_.cast("string"), F.lit(f"@{host}")), F.lit(f"DTSTAMP:{stamp:%Y%m%dT%H%M%SZ}"),
        F.concat(F.lit("DTSTART:"), ics_time(start)), F.concat(F.lit("DTEND:"), ics_time(F.coalesce(end, start + F.expr("INTERVAL 2 HOURS")))),
        F.concat(F.lit("SUMMARY:"), ics_escaped(title)), some("DESCRIPTION", ics_escaped(description)), some("LOCATION", ics_escaped(place)), some("URL", url),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    )


def report(sections: list[tuple[str, str, DataFrame]]) -> str:
    """A markdown report of small tables (counts by month, category, source): title, header row, rows in order."""
    out = []
    for title, header, rows in sections:
        out += [f"## {title}", "", header, "|" + "---|" * header.strip("|").count("|") + "---|"]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows.toLocalIterator()]  # as long as its groups are many
        out.append("")
    return "\n".join(out)


def exported_pages(pages: DataFrame, excluded: tuple[str, ...] = (), least: int = 200) -> DataFrame:
    """key, text of crawled pages for the document folder: fetched well, from a wanted source, long enough, with a header."""
    good = (F.col("status") == 200) & (F.length("md") >= least)
    if excluded:
        good = good & ~F.col("source").isin(list(excluded))
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = F.concat_ws("\n", F.lit("---"), F.lit("kind: page"), line("source", "source"), line("url", "url"), line("crawled", "crawled"), F.lit("---"))
    return pages.where(good).select("key", F.concat(head, F.lit("\n\n"), F.col("md")).alias("text"))
