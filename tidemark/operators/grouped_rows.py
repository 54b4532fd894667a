"""Groups as rows in order, with each row's place in its group: a group is never one array or one task.

Rows are range-partitioned by group and order and written as they lie, with the number of their part and their place in
it. What a part holds of each group is a small table; its running sums per group turn places in parts into places in
groups. A group with a third of all rows so lies in a third of the parts.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import shared_folder

PART, AT = "__part", "__at"


def positioned(df: DataFrame, group: list[str], order: list[str], parts: int | None = None, folder: str | None = None) -> DataFrame:
    """The rows with `pos` (from 1) in their group and its `size`; null groups and orders come first, equal rows in any order.

    The rows are written below `folder`, the shared folder if not given, and stay there as long as the result is used.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    spread = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    laid = spread.sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(PART), at.alias(AT))
    path = f"{folder or shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)

    named = {g: f"__g{i}" for i, g in enumerate(group)}
    held = laid.groupBy(*[F.col(g).alias(n) for g, n in named.items()], F.col(PART).alias("__p")).agg(F.min(AT).alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy(*named.values())
    held = held.select("*", (F.sum("__n").over(own.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(own).alias("__size"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in named.items()], F.col(PART) == F.col("__p"))
    rows = laid.join(held, same)
    return rows.select(*df.columns, (F.col(AT) - F.col("__first") + F.col("__before") + 1).alias("pos"), F.col("__size").alias("size"), PART, AT)


def lines(rows: DataFrame, header: Column, item: Column) -> DataFrame:
    """value: the positioned rows as texts, a header before the first of each group; with the columns that order them."""
    text = F.posexplode(F.when(F.col("pos") == 1, F.array(header, item)).otherwise(F.array(item))).alias("__no", "value")
    return rows.select(PART, AT, text)


def write_lines(texts: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes texts in order: the files of the folder, by name, are one text after another."""
    keys = (PART, AT, "__no")
    spread = texts.repartitionByRange(parts, *keys) if parts else texts.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).select("value").write.text(path)
