"""Submissions, updates and chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: What a submission may hold, and how many characters of it are kept.
LENGTHS = {"title": 200, "description": 2000, "start_time": 10, "end_time": 10, "venue": 200, "address": 300, "category": 60, "image_url": 600, "ticket_url": 600, "price": 60, "contact_email": 200}
#: Columns that an editor may change.
EDITABLE = ("title", "description", "start_at", "end_at", "venue", "address", "category", "price", "is_free", "is_family_friendly", "image_url", "ticket_url", "status")


def submissions(df: DataFrame) -> DataFrame:
    """All rows, trimmed and cut, with `error` (null: accepted as pending)."""
    clean = {c: F.nullif(F.substring(F.trim(F.col(c)), 1, n), F.lit("")) for c, n in LENGTHS.items() if c in df.columns}
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    missing = blank("title") | blank("event_date") | blank("contact_email")
    error = F.when(missing, "Title, date, and contact email are required.").when(~F.trim("contact_email").rlike(EMAIL), "Please provide a valid contact email.")
    out = df.withColumn("error", error).withColumns(clean)
    return out.withColumn("status", F.when(F.col("error").isNull(), "pending").otherwise("rejected"))


def pending(df: DataFrame, order: str = "start_at") -> DataFrame:
    return df.where(F.col("status") == "pending").orderBy(order)


def patched(df: DataFrame, patch: DataFrame, key: str, columns: tuple[str, ...] = EDITABLE) -> DataFrame:
    """Rows with the patch's non-null values in editable columns; other columns of the patch are ignored."""
    names = [c for c in patch.columns if c in columns and c in df.columns]
    p = patch.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names])
    out = df.join(p, F.col(key) == F.col("__key"), "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*df.columns)


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Predicate update."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def merged_away(df: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Soft delete: rows that merges (id, target) names are hidden and point to their target."""
    m = merges.select(F.col("id").alias("__key"), "target")
    out = df.join(m, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    return out.withColumns({"status": F.when(hit, "hidden").otherwise(F.col("status")), "duplicate_of": F.coalesce("target", "duplicate_of")}).drop("__key", "target")


def published(submission: DataFrame, year_policy: str = "month") -> DataFrame:
    """Accepted submissions as event rows: start by date and time (18:00 without one)."""
    from tidemark.functions import text as tx
    from tidemark.functions import times as tm

    day = F.try_to_timestamp("event_date", F.lit("yyyy-MM-dd")).cast("date")
    at = lambda t, default: F.when(t.isNotNull() | F.lit(default is not None), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.coalesce(t, F.lit(default)), F.lit(":00"), tm.offset(day, year_policy)))
    return submission.where("status = 'pending'").select(
        "id", "title", tx.slug(F.col("title")).alias("slug"), "description", at(F.col("start_time"), "18:00").alias("start_at"), at(F.col("end_time"), None).alias("end_at"),
        "venue", "address", F.coalesce("category", F.lit("other")).alias("category"), "price", F.coalesce(F.col("price").rlike("(?i)free"), F.lit(False)).alias("is_free"),
        F.lit("approved").alias("status"),
    )


def sanitised_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", last: int = 16, most: int = 2000) -> DataFrame:
    """The turns of each conversation that go to an answer: the last 16, trimmed and cut; without empty ones, from the
    first user turn on. A conversation with a bad role or a null text among them, or one that does not end with the user, is rejected whole."""
    recent = df.withColumn("__back", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))).where(F.col("__back") <= last)
    every = Window.partitionBy(conv)
    bad = ~F.coalesce(F.col(role).isin("user", "assistant"), F.lit(False)) | F.col(text).isNull()
    rows = recent.withColumn("__bad", F.max(bad).over(every)).where(~F.col("__bad"))
    rows = rows.withColumn(text, F.substring(F.trim(text), 1, most)).where(F.col(text) != "")
    so_far = every.orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__begun", F.max(F.col(role) == "user").over(so_far)).where("__begun")
    rows = rows.withColumn("__last", F.max_by(role, turn).over(every)).where(F.col("__last") == "user")
    return rows.select(conv, turn, role, text)


def namespaced(df: DataFrame, prefix: str, slug: str = "slug") -> DataFrame:
    """Rows re-keyed into a namespace of their own; the job fails if a slug is null or has the prefix already."""
    guard = F.assert_true(F.col(slug).isNotNull() & ~F.col(slug).startswith(prefix), F.concat(F.lit("slug outside its namespace: "), F.coalesce(F.col(slug), F.lit("null"))))
    return df.withColumn(slug, F.coalesce(guard.cast("string"), F.concat(F.lit(prefix), F.col(slug))))


def image_work(df: DataFrame, sources: tuple[str, ...], url: str = "source_url") -> DataFrame:
    """Pages to visit for pictures: addresses of rows without an image from some sources, with the ids that want it."""
    wanted = df.where(F.col("source_name").isin(list(sources)) & (F.coalesce("image_url", F.lit("")) == "") & F.col(url).isNotNull())
    return wanted.groupBy(url).agg(F.array_sort(F.collect_list("id")).alias("ids"))
