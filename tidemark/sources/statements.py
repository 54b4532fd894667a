"""Upserts as SQL text: rows as literals, in statements of a few hundred rows, written by all tasks at once.

Every statement stands alone and a key stands in one of them only, so files and statements may be run in any order, and
again. Statements are numbered within their part of the key's range; a part's rows are counted where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a statement; larger ones time out where they are pasted.
ROWS = 250


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def literal(c: Column, kind: T.DataType) -> Column:
    """SQL literal of a column: null, true, numbers as they are, all else quoted; of a list its elements, empty ones and nulls left out."""
    if isinstance(kind, T.ArrayType):
        some = F.filter(c, lambda x: x.isNotNull() & (x.cast("string") != ""))
        parts = F.array_join(F.transform(some, lambda x: literal(x, kind.elementType)), ",")
        return F.when(F.size(F.coalesce(some, F.array().cast(kind))) > 0, F.concat(F.lit("array["), parts, F.lit("]::text[]"))).otherwise("'{}'::text[]")
    text = c.cast("string")
    if not isinstance(kind, T.BooleanType | T.NumericType):
        text = quoted(text)
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), quoted(text)).otherwise(text)
    return F.coalesce(text, F.lit("null"))


def value_lines(df: DataFrame) -> Column:
    """A row as `(literal, literal, ...)`."""
    parts = [literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return F.concat(F.lit("  ("), F.concat_ws(", ", *parts), F.lit(")"))


def statements(df: DataFrame, table: str, key: str, update: tuple[str, ...] | None = None, rows: int = ROWS, order: list | None = None, touch: str | None = None) -> DataFrame:
    """part, no, n, statement: `insert ... on conflict (key) do update` of `rows` rows each; of a repeated key the last by `order` counts.

    update: columns that a row with a known key takes over, all but the key if not given; touch: a column set to now().
    A null key conflicts with nothing and is inserted.
    """
    columns = [c for c in df.columns]
    one = df.groupBy(F.col(key).alias("__key"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("__own"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    df = one.agg(F.max_by(row, F.struct(*order)).alias("__row") if order else F.first(row).alias("__row")).select("__row.*")
    sets = [f"{c} = excluded.{c}" for c in (update or tuple(c for c in columns if c != key))] + ([f"{touch} = now()"] if touch else [])
    head = f"insert into {table} ({', '.join(columns)}) values\n"
    tail = f"\non conflict ({key}) do update set {', '.join(sets)};"
    lines = df.select(F.col(key).alias("k"), value_lines(df).alias("line"))
    lines = lines.repartitionByRange("k", "line").sortWithinPartitions("k", "line").withColumn("id", F.monotonically_increasing_id())
    part, at = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND((1 << 33) - 1)
    chunks = lines.groupBy(part.alias("part"), F.floor(at / rows).cast("long").alias("no")).agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"))
    text = F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), ",\n"), F.lit(tail))
    return chunks.select("part", "no", F.size("l").alias("n"), text.alias("statement"))


def write_statements(df: DataFrame, path: str, table: str, key: str, **kw) -> None:
    """The statements as text files, each below a comment with its place and rows."""
    s = statements(df, table, key, **kw)
    note = F.concat(F.lit(f"-- {table}, part "), F.col("part").cast("string"), F.lit(", statement "), (F.col("no") + 1).cast("string"), F.lit(", rows: "), F.col("n").cast("string"), F.lit("\n"))
    s.select(F.concat(note, F.col("statement"), F.lit("\n")).alias("value")).write.text(path)
