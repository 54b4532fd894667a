"""Mixing sources to target weights.

Sizes are words. Sources weigh as `weights`, in code-point order of their names, null last, and share
`share` times all sizes; a target stops at `most` times its source's size and what is over goes to the other
sources by weight until none is above. That fixed point is one water level: target = min(most * size,
level * weight). A document is taken floor(target / source size) times, plus once more with the probability
of the fraction, decided by a hash of seed and id, so that reruns and retried tasks agree.

Only one row per source is ever gathered; the documents are read in place and joined with those few rows.

Defined results: a null text has size 0; a null source is a source of its own; a source of size 0 has target
0 and takes nothing; a null id hashes as the empty text; repeated rows decide alike and each counts; an
empty table gives an empty result; other columns, whatever their names, are kept by `mixed` (but for `copy_no`,
which it sets) and ignored by `rates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load, n_words, spare

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from rows of source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("no") % len(weights) + 1).cast("int"))
    per = per.withColumn("no", F.row_number().over(order) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        per.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        # the level if this source and those that fill up before it were full, over the rest by weight
        .withColumn("full", F.sum("cap").over(fill) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - (F.sum("weight").over(fill) - F.col("weight")))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "no", "level"))).over(everything)["level"])
    )
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def rates(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """doc_id, size, source_size, target and copies of every row."""
    sized = docs.select("doc_id", "source", n_words("text").alias("size"))
    per = targets(sized, **kw)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("rate", rate).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.floor("rate") + (uniform(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """Every row as often as the mix takes it, with its copy's number `copy_no`; all other columns kept."""
    of, rate, n = spare(docs, "of"), spare(docs, "rate"), spare(docs, "n")
    sized = docs.select("source", n_words("text").alias("size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = targets(sized, **kw).select(F.col("source").alias(of), share.alias(rate))
    more = uniform(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate)
    rows = docs.drop("copy_no").join(per, F.col("source").eqNullSafe(F.col(of)), "left")
    rows = rows.withColumn(n, (F.floor(rate) + more.cast("int")).cast("int")).where(F.col(n) > 0)
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(of, rate, n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rates(load(spark, sf_dir, "documents"))
    return r.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
       sum(cap) OVER (ORDER BY cap / weight, no ROWS UNBOUNDED PRECEDING) - cap AS full_before,
       sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap / weight, no ROWS UNBOUNDED PRECEDING) - weight) AS open_weight FROM w),
l AS (SELECT *, (total - full_before) / open_weight AS lv FROM f),
m AS (SELECT min(struct_pack(c := cap / weight, k := no, lv := lv)) AS s FROM l WHERE lv * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN s IS NULL THEN cap ELSE least(cap, s.lv * weight) END AS target FROM l, m),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
