"""Readers of digests, archives, page folders, NDJSON and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import documents


def or_else(df: DataFrame, other: DataFrame) -> DataFrame:
    """The other table if the first is empty; a branch on the driver, of one task."""
    return other if df.isEmpty() else df


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """doc, text of all markdown files below a folder but its own README."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/")
    root = F.lit(folder.split(":", 1)[-1].rstrip("/").lstrip("/"))
    doc = F.substring(path, F.length(root) + 3, F.length(path))
    rows = files.select(doc.alias("doc"), F.col("value").alias("text"))
    return rows.where("doc <> 'README.md'")


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc, fields, body of markdown files with front matter."""
    return markdown(spark, folder).withColumn("__fm", documents.front_matter(F.col("text"))).select("doc", "__fm.fields", "__fm.body")


def archive(spark: SparkSession, path: str, schema: str, events: str = "events") -> DataFrame:
    """Rows of an archive file {..., "events": [...]}; `schema` is that of one event."""
    whole = spark.read.schema(f"generated_at string, `{events}` array<struct<{schema}>>").json(path, multiLine=True)
    return whole.select("generated_at", F.inline(events))


def page_folder(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The manifest with md and html of each page's key; null where a file is missing."""

    def texts(ext: str) -> DataFrame:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*.{ext}")
        return files.select(F.regexp_extract("_metadata.file_name", rf"^(.*)\.{ext}$", 1).alias("key"), F.col("value").alias(ext))

    return manifest.join(texts("md"), "key", "left").join(texts("html"), "key", "left")


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of NDJSON; lines that can't be read, a torn last one too, are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def worklist(spark: SparkSession, first: str, months: int, sources: DataFrame) -> DataFrame:
    """Addresses to crawl: each source's pattern for every month ahead and page. sources: source, pattern ({month}, {page}), pages."""
    ahead = F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.add_months(F.trunc(F.lit(first).cast("date"), "MM"), months - 1), F.expr("INTERVAL 1 MONTH"))
    monthly = F.contains("pattern", F.lit("{month}"))
    rows = sources.withColumn("month", F.explode(F.when(monthly, ahead).otherwise(F.array(F.trunc(F.lit(first).cast("date"), "MM")))))
    rows = rows.withColumn("page", F.explode(F.sequence(F.lit(1), F.coalesce("pages", F.lit(1)))))
    url = F.replace(F.replace("pattern", F.lit("{month}"), F.date_format("month", "yyyy-MM")), F.lit("{page}"), F.col("page").cast("string"))
    return rows.select("source", url.alias("url"), F.substring(F.sha1(url.cast("binary")), 1, 12).alias("key")).dropDuplicates(["url"])


def rekeyed(results: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """The wanted pages with what a crawl returned for their address, in any order and with or without a last slash; the first of several."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"/+$", ""))
    cols = [c for c in results.columns if c not in (url, "ord")]
    first = results.groupBy(plain(F.col(url)).alias("__u")).agg(F.min_by(F.struct(*cols), "ord").alias("__r"))
    return wanted.join(first, plain(F.col(url)) == F.col("__u"), "left").select(*wanted.columns, "__r.*")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A whole table of a database, read by ranges of a numeric key at once: complete, whatever its size. Needs the driver's jar."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def indexed_by_month(df: DataFrame, at: str, path: str, zone_day: Column | None = None) -> None:
    """Writes a table by month of its start, sorted inside the files, so scans for a range skip months and row groups."""
    day = zone_day if zone_day is not None else F.to_date(at)
    df.withColumn("month", F.date_format(day, "yyyy-MM")).repartition("month", F.pmod(F.hash(at), F.lit(8))).sortWithinPartitions(at).write.partitionBy("month").parquet(path)
