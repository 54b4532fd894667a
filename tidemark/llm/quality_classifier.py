"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy.

Units are the lower-case cores of words, the runs of marks around them and a mark for capitals, hashed into
`BUCKETS`. Every bucket has an index vector, `NONZERO` of `DIM` places being +1 or -1 by its number. Its context
vector sums the index vectors of the units up to `REACH` places away over all texts; Spark adds up the
tasks' sums. The word vector is the normalised context vector plus the index vector, and a text's features are
the mean of its units' vectors.

A network of one hidden layer learns from at most `MOST` labelled texts, those of the least hash, of which a
fifth is held back to fit the temperature that divides its output before the logistic function.

Defined results: a null or empty text has features zero and is scored like any other; a null label or id is
not learnt from; ids with several labels count with their mean, from a half up as 1; with labels of one class
only, or none, every score is that class, or 0.5; repeated rows score alike; other columns, whatever their
names, are kept by `scored` (but for `quality_score`, which it sets) and otherwise ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, held_out, load

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
MOST, HIDDEN, STEPS = 20_000, 32, 400
REMEMBERED, LONG = 150_000, 200
_PARTS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+|[0-9A-Za-z\x80-\xff]+")


class Units(dict):
    """Word -> buckets of its units, for the words of up to LONG bytes met of late."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        parts = _PARTS.findall(word)
        out = [zlib.crc32(p.lower()) % BUCKETS for p in parts]
        core = max(parts, key=len)
        if len(core) > 1 and core.isupper():
            out.append(zlib.crc32(b"<capitals>") % BUCKETS)
        out = tuple(out)
        if len(word) <= LONG:
            self[word] = out
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of the texts one after another, and the number of each text's."""
        lists = [list(chain.from_iterable(map(self.__getitem__, (t or b"").split()))) for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO], rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM word vectors from all rows."""
    place, sign = index_vectors()

    def run(batches):
        units, total = Units(), np.zeros(BUCKETS * DIM)
        for b in chunks(batches):
            u, n = units.of(b.column("text").to_pylist())
            doc = np.repeat(np.arange(len(n)), n)
            for o in range(1, REACH + 1):
                same = doc[o:] == doc[:-o]
                left, right = u[:-o][same], u[o:][same]
                for x, y in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(x * DIM + place[y, k], sign[y, k], BUCKETS * DIM)
        rows = total.reshape(BUCKETS, DIM)
        at = np.flatnonzero(rows.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows[at].astype(np.int64).ravel()), DIM).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), values], names=["bucket", "v"])

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"))
    sums = rows.mapInArrow(run, "bucket int, v array<bigint>").groupBy("bucket").agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(DIM)]).toArrow()
    out = np.zeros((BUCKETS, DIM))
    out[sums.column("bucket").to_numpy()] = np.column_stack([sums.column(f"v{i}").to_numpy() for i in range(DIM)]) if sums.num_rows else 0.0
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)
    np.add.at(out, (np.arange(BUCKETS)[:, None], place), sign / np.sqrt(NONZERO))
    return out.astype(np.float32)


def pooled(units: Units, vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean vector of each text, zero without units."""
    u, n = units.of(texts)
    ends = np.cumsum(n)
    out = np.zeros((len(texts), DIM))
    for at in range(0, len(u), 200_000):  # bounds the memory of long texts
        to = min(len(u), at + 200_000)
        doc = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, to - 1, "right") + 1)
        first = np.maximum(ends[doc] - n[doc], at) - at
        has = n[doc] > 0
        out[doc[has]] += np.add.reduceat(vectors[u[at:to]], first[has], axis=0, dtype=np.float64)
    return out / np.maximum(n, 1)[:, None]


class Network:
    """Standardised features, tanh layer, logistic output divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        if len(y) < 5 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        held = np.arange(len(y)) % 5 == 4
        w = [rng.normal(0, 1 / np.sqrt(DIM), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        z, t = self._scaled(x[~held]), y[~held]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, STEPS + 1):
            h = np.tanh(z @ w[0] + w[1])
            d = (_logistic(h @ w[2] + w[3]) - t) / len(t)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logits, t = self._logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.mean(np.logaddexp(0, logits / k) - t * logits / k) for k in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x):
        return np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _logistic(self._logits(x) / self.temperature)


def _logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, network from at most `most` of those with a label (doc_id, quality)."""
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    per = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # `most` rows of two numbers at the most
    some = F.broadcast(per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "y"))

    def run(batches):
        units = Units()
        for b in chunks(batches):
            x = pooled(units, shared.value, b.column("text").to_pylist())
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), values], names=["id", "y", "x"])

    rows = docs.join(some, F.col("doc_id") == F.col("id")).select("id", "y", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "x").limit(most).toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, DIM)
    return vectors, Network(x, got.column("y").to_numpy().astype(float))


def scored(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """All columns of every row and `quality_score`, which replaces a column of that name."""
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = docs.schema.names.index("text")

    def run(batches):
        units = Units()
        for b in chunks(batches):
            vectors, network = shared.value
            texts = [t.encode() if t else b"" for t in b.column(name).to_pylist()]
            score = network(pooled(units, vectors, texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "quality_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, quality_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, load(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", "quality"))
    rows = scored(docs, model).drop("text")
    score = F.col("quality_score")
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
