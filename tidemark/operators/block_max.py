"""The best hits of a search without scoring all: blocks of documents that can't hold one are not read.

Postings are dealt to blocks of some documents each. A term's greatest number of occurrences and least length in a block
bound what it can count there, and the sum over a query's words bounds every score of the block. The blocks with the
greatest bounds are scored first; their worst kept score then says which of the others may still hold better hits. The
result is that of `ranked(matches(...), more=False)`, whatever the blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.search import Index
from tidemark.sources.folders import written

#: Documents of a block, and blocks of each query that are scored first.
SIZE, FIRST = 64, 8


@dataclass(frozen=True)
class Blocked:
    """An index whose postings have a block, and the bounds: term, block, tf (greatest), len (least)."""

    index: Index
    bounds: DataFrame


def blocked(index: Index, size: int = SIZE) -> Blocked:
    n = max(1, math.ceil(index.n / size))
    postings = index.postings.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return Blocked(replace(index, postings=postings), postings.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("len").alias("len")))


def save(b: Blocked, path: str) -> None:
    """Writes the index; postings and bounds lie by term and block, so that a search reads few row groups."""
    n = int(b.bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b.index.postings.repartitionByRange(n, "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    b.index.terms.repartitionByRange(n, "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    b.index.lengths.write.parquet(f"{path}/lengths")
    spark = b.bounds.sparkSession
    spark.createDataFrame([(b.index.n, b.index.avg_len)], "n long, avg_len double").write.parquet(f"{path}/stats")
    postings = spark.read.parquet(f"{path}/postings")
    bounds = postings.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("len").alias("len"))
    bounds.repartitionByRange(n, "term").sortWithinPartitions("term").write.parquet(f"{path}/bounds")


def read(spark, path: str) -> Blocked:
    return Blocked(search.read_index(spark, path), spark.read.parquet(f"{path}/bounds"))


def bounded(b: Blocked, queries: DataFrame, boost: float, hit: DataFrame | None = None, **kw) -> DataFrame:
    """query_id, block, bound: no document of the block scores more. Blocks without any of the words are left out."""
    hit = search.weighted(b.index, queries, **kw) if hit is None else hit
    # only bounds of words that are asked for are worked out
    asked = b.bounds.join(hit.select(F.col("variant").alias("term")).distinct(), "term", "left_semi")
    t = asked.join(hit.withColumnRenamed("term", "word"), F.col("variant") == F.col("term")).select("query_id", "n_terms", "block", "word", "tf", "len", "w")
    per = t.groupBy("query_id", "n_terms", "block", "word").agg(F.sum(F.col("w") * search.saturated(b.index)).alias("s"))
    per = per.groupBy("query_id", "n_terms", "block").agg(F.sum("s").alias("s"), F.count("*").alias("matched"))
    return per.select("query_id", "block", (search.covered() * boost).alias("bound"))


def to_read(b: Blocked, docs: DataFrame, queries: DataFrame, limit: int, keep: Column | None = None, local: Column | None = None, id_col: str = "id", first: int = FIRST, hit: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks that are scored first, the best hits there, and the other blocks that may hold better ones; each as query_id and block, or hits."""
    boost = search.PHRASE_BOOST * (search.LOCAL_BOOST if local is not None else 1.0)
    hit = search.weighted(b.index, queries, **kw) if hit is None else hit
    bounds = written(bounded(b, queries, boost, hit), "bounds")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    placed = bounds.withColumn("place", order)
    one = placed.where(F.col("place") <= first).select("query_id", "block")
    hits = written(search.best(b.index, docs, queries, limit, keep, local, id_col, only=one, hit=hit), "hits")
    least = hits.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") >= limit, F.min("score")).alias("least"))
    rest = placed.where(F.col("place") > first).join(least, F.col("query_id") == F.col("q"), "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - search.SLACK)
    return one, hits, rest.select("query_id", "block")


def top(b: Blocked, docs: DataFrame, queries: DataFrame, limit: int = search.DEFAULT_RESULTS, keep: Column | None = None, local: Column | None = None, id_col: str = "id", ord_col: str = "ord", first: int = FIRST, **kw) -> DataFrame:
    """The best `limit` hits of each query that `keep` lets through, with pos."""
    hit = search.weighted(b.index, queries, **kw)
    _, hits, rest = to_read(b, docs, queries, limit, keep, local, id_col, first, hit)
    more = search.best(b.index, docs, queries, limit, keep, local, id_col, ord_col, rest, hit)
    both = hits.select(*more.columns).unionByName(more)
    return search.ranked(both, limit, ord_col, more=False)
