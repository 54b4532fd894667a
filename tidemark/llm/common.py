"""What the corpus operators share: text columns, Arrow chunks, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python code handles at once.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch, where the session sets no limit.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of Arrow batches, which Spark limits only in rows by default; a limit that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c: str | Column = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def held_out(n: int, remainder: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod n, equals the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n == remainder


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own, but only if there is a single machine."""
    bound_batches(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """The rows, written to the checkpoint folder that the executors share, without their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- rolling hashes over the words of many texts -------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1B54A32D192ED03
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, mod 2^64."""
    if len(_powers.get("b", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 17)) if n < 4 * CHUNK_BYTES else n + 1
        for k, base in (("b", _BASE), ("i", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    b, i = _powers["b"], _powers["i"]
    if n > 4 * CHUNK_BYTES:  # don't keep the powers that only a very long text needs
        _powers.clear()
    return b, i


class Words:
    """The words of a list of texts (bytes), one space between any two, and hashes of runs of words.

    doc: number of the text of each word; first, n: first word and number of words of each text.
    """

    def __init__(self, words: list[list[bytes]]):
        self.buffer = b" ".join(w for d in words for w in d) + b" "
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.doc = np.repeat(np.arange(len(words)), self.n)
        raw = np.frombuffer(self.buffer, np.uint8)
        self.end = np.flatnonzero(raw == 32)[:total]
        self.start = np.empty(total, np.int64)
        if total:
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        b, self._inv = _power(len(raw))
        self._sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * b[: len(raw)], out=self._sum[1:])

    def runs(self, k: int) -> np.ndarray:
        """Numbers of the words where a run of k words starts that stays in its text."""
        left = np.repeat(self.first + self.n, self.n) - np.arange(len(self.doc))
        return np.flatnonzero(left >= k)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """A 64-bit hash of the k words from each of the words `at`, the same in any text."""
        s, e = self.start[at], self.end[at + (k - 1)]
        h = (self._sum[e] - self._sum[s]) * self._inv[s]
        h ^= h >> np.uint64(32)
        h *= _MUL
        return h ^ (h >> np.uint64(29))

    def slice(self, word: int, k: int) -> bytes:
        return self.buffer[self.start[word] : self.end[word + k - 1]]


# --- tables written on the way --------------------------------------------------------------------

_folders: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` writes inside the block are deleted at its end."""
    path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _folders.append(path)
    try:
        yield
    finally:
        _folders.pop()
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows, written as Parquet under the checkpoint folder that all executors share, and read again."""
    folder = folder or (_folders[-1] if _folders else checkpoint_dir(df.sparkSession))
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


# --- joins that no single key or small side can break ------------------------------------------------

#: Rows that a side of a join may have to be sent to every task.
SMALL_ROWS = 500_000
#: Rows of one key from which on it is split.
HOT_ROWS = 20_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The rows, marked for broadcast if they are counted and found to be few; otherwise as they are, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def hot_keys(df: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """key, parts of the keys of very many rows, or None: under 5,000 keys, whatever the size of the table."""
    most = max(least, df.count() // 5_000)
    hot = df.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    rows = hot.collect()
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows from a count on, `most` rows at the most."""
    band = F.floor(F.log2(F.col(count) + 1) * 8)
    bands = sorted(((r[0], r[1]) for r in df.groupBy(band).count().collect()), reverse=True)  # a few hundred
    total, least = 0, None
    for b, n in bands:
        total += n
        if total > most:
            break
        least = b
    return df.where(band >= least) if least is not None else df.limit(0)


def joined(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Inner or left join with a table of one row a key; rows of a key of `hot` are dealt to several tasks."""
    if hot is None:
        return left.join(right, key, how)
    parts, part = spare(left, "parts"), spare(left, "part")
    hot, n = F.broadcast(hot.toDF(key, parts)), F.coalesce(F.col(parts), F.lit(1))
    left = left.join(hot, key, "left").withColumn(part, F.floor(F.rand(1) * n).cast("int")).drop(parts)
    right = right.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [key, part], how).drop(part)
