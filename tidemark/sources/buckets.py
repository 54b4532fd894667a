"""Tables in hash buckets of their key: an upsert writes the buckets that it touches, and a manifest that swaps them in.

    <path>/manifests/<version>.json     buckets, key, schema, and the folder of each bucket
    <path>/data/<run>/bucket=<n>/...     files, never changed once written

A version is what the newest manifest lists. It appears by one rename after all files are there, so readers see all of an
upsert or nothing, and a run that fails leaves the last version as it was. Of two writers that start from the same version
the second gets an error and may try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import folders

BUCKET = "__bucket"


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    n: int
    schema: T.StructType
    #: bucket -> folder below data/, for buckets that have rows
    runs: dict[int, str]


def bucket_of(key: str, n: int) -> Column:
    """The bucket of a key; equal values have one, a null key that of its own hash."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version of a table, or a given one."""
    there = [n for n in folders.names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
    if not there:
        raise FileNotFoundError(f"no table at {path}")
    name = there[-1] if version is None else f"{version:09}.json"
    m = json.loads(folders.read_text(spark, f"{path}/manifests/{name}"))
    return Manifest(int(name[:-5]), m["key"], m["n"], T.StructType.fromJson(m["schema"]), {int(b): r for b, r in m["runs"].items()})


def _commit(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    text = json.dumps({"key": m.key, "n": m.n, "schema": m.schema.jsonValue(), "runs": m.runs})
    folders.write_once(spark, f"{path}/manifests/{m.version:09}.json", text)
    return m


def _write(df: DataFrame, path: str, n: int) -> dict[int, str]:
    """Writes rows with their bucket, a task for each bucket; buckets with rows and the run's folder."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{run}")
    return {int(name.split("=")[1]): run for name in folders.names(spark, f"{path}/data/{run}") if name.startswith(f"{BUCKET}=")}


def _read(spark: SparkSession, path: str, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
    wanted = [f"{path}/data/{run}/{BUCKET}={b}" for b, run in sorted(m.runs.items()) if buckets is None or b in buckets]
    return spark.read.schema(m.schema).parquet(*wanted) if wanted else spark.createDataFrame([], m.schema)


def create(df: DataFrame, path: str, key: str, n: int = 64) -> Manifest:
    """The first version of a table. A bucket is the least that an upsert rewrites; some 256 MB to 1 GB are a good size."""
    return _commit(df.sparkSession, path, Manifest(1, key, n, df.schema, _write(df.withColumn(BUCKET, bucket_of(key, n)), path, n)))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _read(spark, path, manifest(spark, path, version))


def lookup(spark: SparkSession, path: str, values: list) -> DataFrame:
    """The rows of given keys, from their buckets only."""
    m = manifest(spark, path)
    kind = m.schema[m.key].dataType
    keys = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(m.key, kind)]))
    buckets = {r[0] for r in keys.select(bucket_of(m.key, m.n)).distinct().collect()}
    return _read(spark, path, m, buckets).where(F.col(m.key).isin(values))


def upsert(new: DataFrame, path: str, order: list | None = None, drop: Column | None = None) -> Manifest:
    """The next version: rows of a known key replaced, others added; of a repeated new key the last by `order`.

    Only the touched buckets are read and written. drop: new rows that delete their key instead. Columns that the new rows
    lack are null; columns that the table lacks are an error.
    """
    spark = new.sparkSession
    m = manifest(spark, path)
    if extra := set(new.columns) - set(m.schema.names):
        raise ValueError(f"the table has no column {', '.join(sorted(extra))}")
    gone = F.lit(False) if drop is None else F.coalesce(drop, F.lit(False))
    rows = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in m.schema], gone.alias("__gone"), *[o.alias(f"__o{i}") for i, o in enumerate(map(_column, order or []))])
    whole = F.struct(*[F.col(c) for c in (*m.schema.names, "__gone")])
    last = F.max_by(whole, F.struct(*[F.col(f"__o{i}") for i in range(len(order))])) if order else F.first(whole)
    rows = rows.groupBy(F.col(m.key).alias("__key")).agg(last.alias("__row")).select("__row.*").withColumn(BUCKET, bucket_of(m.key, m.n))
    touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # numbers below n
    if not touched:
        return m
    old = _read(spark, path, m, touched).withColumn(BUCKET, bucket_of(m.key, m.n))
    keys = rows.select(F.col(m.key).alias("__k"), F.col(BUCKET).alias("__b"))
    # the bucket is a key of the join, so that the join's shuffle is by bucket and key alike
    kept = old.join(keys, (F.col(BUCKET) == F.col("__b")) & F.col(m.key).eqNullSafe(F.col("__k")), "left_anti")
    after = kept.unionByName(rows.where(~F.col("__gone")).drop("__gone"))
    made = _write(after, path, m.n)
    return _commit(spark, path, Manifest(m.version + 1, m.key, m.n, m.schema, {b: r for b, r in m.runs.items() if b not in touched} | made))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes files that none of the last `keep` versions lists, and older manifests; the number of folders deleted.

    Files of a run that has not ended yet are listed nowhere, so it must not run beside an upsert.
    """
    there = [n for n in folders.names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
    used = {(run, b) for n in there[-keep:] for b, run in manifest(spark, path, int(n[:-5])).runs.items()}
    n = 0
    for run in folders.names(spark, f"{path}/data"):
        for name in folders.names(spark, f"{path}/data/{run}"):
            if not name.startswith(f"{BUCKET}=") or (run, int(name.split("=")[1])) in used:
                continue
            folders.delete(spark, f"{path}/data/{run}/{name}")
            n += 1
        if not any(r == run for r, _ in used):
            folders.delete(spark, f"{path}/data/{run}")
    for name in there[:-keep]:
        folders.delete(spark, f"{path}/manifests/{name}")
    return n
