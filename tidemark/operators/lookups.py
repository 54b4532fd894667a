"""Lookups as joins. Dimension tables join plainly: Spark broadcasts them below its size limit, and shuffles beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_name(df: DataFrame, dim: DataFrame, key: str, dim_key: str, **columns: str) -> DataFrame:
    """All rows, with columns of the dimension under new names (new=old); null where there is no match."""
    d = dim.select(F.col(dim_key).alias("__key"), *[F.col(v).alias(k) for k, v in columns.items()])
    return df.join(d, F.col(key) == F.col("__key"), "left").drop("__key")


def with_default(df: DataFrame, dim: DataFrame, key: str, dim_key: str, default: str, **columns: str) -> DataFrame:
    """As with_name, but rows without a match get the dimension's row of the key `default`."""
    known = dim.select(F.col(dim_key).alias("__known"))
    found = df.join(known, F.col(key) == F.col("__known"), "left").withColumn("__use", F.coalesce("__known", F.lit(default))).drop("__known")
    return with_name(found, dim, "__use", dim_key, **columns).drop("__use")


def unmatched(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Rows without a match: what has no adapter or parser."""
    return df.join(dim.select(F.col(dim_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def answer_sources(answers: DataFrame, chunks: DataFrame, links: Column, id_col: str = "answer_id", link: str = "link", most: int = 8, otherwise: int = 6) -> DataFrame:
    """Chunks that an answer links to, in order of mention, each once, `most` at the most; for an answer that links to none, its first `otherwise` event chunks by ordinal."""
    from tidemark.operators.listing import top_per_group

    asked = answers.select(id_col, F.posexplode(links).alias("pos0", link)).groupBy(id_col, link).agg(F.min("pos0").alias("at"))
    hit = asked.join(chunks, [id_col, link]).withColumn("order", F.col("at"))
    rest = chunks.join(hit.select(id_col).distinct(), id_col, "left_anti").where("kind = 'event'").withColumn("order", F.col("ord"))
    cols = [id_col, link, "order"]
    a = top_per_group(hit.select(*cols), [id_col], [F.col("order")], most, more=False)
    b = top_per_group(rest.select(*cols), [id_col], [F.col("order")], otherwise, more=False)
    return a.unionByName(b).select(id_col, link, "pos")


def last_by_id(rounds: DataFrame, id_col: str, order: str, *columns: str) -> DataFrame:
    """Accumulated hits: the last value of each id, at the place where the id came first."""
    return rounds.groupBy(id_col).agg(F.min(order).alias("first_seen"), F.max_by(F.struct(*columns), F.col(order)).alias("last")).select(id_col, "first_seen", "last.*")
