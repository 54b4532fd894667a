"""Counts and per-source summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, by: Column, name: str, **conditions: Column) -> DataFrame:
    """Rows by a key, and how many of them meet each condition."""
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def source_rollup(pages: DataFrame, events: DataFrame, key: str, ok: Column) -> DataFrame:
    """Per source its pages, how many are fine, and its events; both sides are summed before they meet."""
    p = pages.groupBy(key).agg(F.count("*").alias("urls"), F.count_if(ok).alias("ok"))
    e = events.groupBy(key).agg(F.count("*").alias("events"))
    return p.join(e, key, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long")))


def best_page(pages: DataFrame, source: str, url: str, ordinal: str, productive: Column) -> DataFrame:
    """Per source the shortest address of a productive page; of equals the first."""
    best = F.min_by(F.struct(url, ordinal), F.struct(F.length(url), F.col(ordinal)))
    return pages.where(productive).groupBy(source).agg(best.alias("best")).select(source, f"best.{url}")


def overridden(best: DataFrame, canonical: DataFrame, key: str, value: str) -> DataFrame:
    """A canonical value instead, but only for keys that there are."""
    other = canonical.select(key, F.col(value).alias("__canonical"))
    return best.join(other, key, "left").withColumn(value, F.coalesce("__canonical", value)).drop("__canonical")


def productive(sources: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Sources with an event."""
    return sources.join(events.select(key).distinct(), key, "left_semi")


def run_summary(logs: DataFrame) -> DataFrame:
    """One row for a whole run: sums over its sources, and the errors by source."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "created", "duplicates")]
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("source", "error"))))
    return logs.agg(F.count("*").alias("sources"), *sums, errors.alias("errors"))


def audit_log(rows: DataFrame, source: str, created: Column, duplicate: Column, sample: Column, order: str, k: int = 3) -> DataFrame:
    """Per source the numbers found, created and duplicate, and the first k raw rows; only those are gathered."""
    w = Window.partitionBy(source).orderBy(order)
    rows = rows.withColumn("__pos", F.row_number().over(w)).withColumns({"__new": created, "__dup": duplicate})
    first = F.array_sort(F.collect_list(F.when(F.col("__pos") <= k, F.struct("__pos", sample.alias("raw")))))
    return rows.groupBy(source).agg(
        F.count("*").alias("found"), F.count_if("__new").alias("created"), F.count_if("__dup").alias("duplicates"),
        F.transform(first, lambda x: x["raw"]).alias("raw_sample"),
    )
