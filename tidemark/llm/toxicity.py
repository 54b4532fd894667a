"""Toxicity: maximal-scoring segments of token log-odds, calibrated by extreme values.

Log-odds. Of every unit (a run of letters and digits, lower case; longer runs than LONG_UNIT by pairs of letters) the
labelled texts with it are counted by class, and so are those with its beginnings of 4, 5 and 6 bytes, in BUCKETS by hash.
Each count has a Dirichlet prior of STRENGTH pseudo-texts: the classes' sizes for a beginning of 4, and for all longer ones
and the unit itself the posterior of the next shorter beginning, from the texts that lack the longer one. A unit's score is its
log-odds less DRIFT, so that ordinary text has a falling sum; the k-th time in a text, a gain is divided by k.

Segments. One scan, linear in the text, finds all maximal-scoring segments: those that can't be made longer or shorter for a
greater sum, each apart from the others. Of a text of n units the greatest sum among clean texts follows an
extreme-value law, P(S > x) = 1 - exp(-K n exp(-lambda x)); lambda and K are fitted to clean labelled texts that were not
counted. A segment is significant if K n exp(-lambda s) is SIGNIFICANT or less. The text's evidence is the least
chance, over r, of r such segments at once (sum statistics, halved for each further r), and the score a rising
function of its logarithm, fitted to the same held-back texts of both classes, MOST of them at the most.

Defined results: null and empty texts have evidence 0 and are scored like any other; null ids and labels are not learnt
from; ids with several labels count with their mean, from a half up as 1; with one class only, or none, every score is that
class, or 0.5; repeated rows score alike; ties between segments of equal sum go to the earlier, shorter one; other columns are
kept by `scored` (but for `toxicity`, which it sets) and otherwise ignored.
"""

from __future__ import annotations

import math
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, chunks, held_out, load

BUCKETS, STRENGTH, DRIFT, SIGNIFICANT = 1 << 20, 8.0, 0.5, 0.05
#: Labelled texts that the calibration uses at most; every FOLDS-th labelled text, by hash, is held back for it.
MOST, FOLDS = 20_000, 4
LONG_UNIT = 24
MASK = BUCKETS - 1
#: Letters that are hashed at once.
PART = 1 << 19
#: Marks beyond ASCII that part words.
_MARKS = re.compile("[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2000-\u206f\u2190-\u2bff\u2e00-\u2e7f\u3000-\u3003\u3008-\u3020\ufe30-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def units(text: str) -> list[bytes]:
    """The units of a text; a run of over LONG_UNIT letters gives all its pairs of neighbours instead."""
    low = text.lower()
    words = (low if low.isascii() else _MARKS.sub(" ", low)).encode().translate(_PARTED).split()
    if words and max(map(len, words)) > LONG_UNIT:
        runs = ([w] if len(w) <= LONG_UNIT or len(u := w.decode()) <= LONG_UNIT else [(x + y).encode() for x, y in zip(u, u[1:])] for w in words)
        words = list(chain.from_iterable(runs))
    return words


class Units(Words):
    """The units of texts, their hashes and buckets."""

    def hashed(self, size: np.ndarray, level: int) -> np.ndarray:
        """A 64-bit hash of the first `size` bytes of each unit, other ones for each level."""
        h = (self._sum[self.start + size] - self._sum[self.start]) * self._inv[self.start]
        h = (h ^ np.uint64(level)) * _MIX
        h ^= h >> np.uint64(32)
        return h * _MIX

    def levels(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of the units; and per beginning of 4, 5 and 6 bytes, then for the units, which have it and the buckets of all."""
        size, out = self.end - self.start, []
        for k in (4, 5, 6):
            out.append((size > k, (self.hashed(np.minimum(size, k), k) >> np.uint64(40)).astype(np.int64) & MASK))
        whole = self.hashed(size, 0)
        return whole, [*out, (np.ones(len(size), bool), (whole >> np.uint64(40)).astype(np.int64) & MASK)]


def parts(texts: list[str]) -> list[tuple[list[int], list[str]]]:
    """Numbers and texts in groups of about PART letters; a longer text is cut at white space."""
    out, held, size = [], ([], []), 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            to = min(len(t), at + PART)
            while to < len(t) and not t[to].isspace():
                to += 1
            held[0].append(i)
            held[1].append(t[at:to])
            size += to - at
            at = to or 1
            if size >= PART:
                out.append(held)
                held, size = ([], []), 0
    return [*out, held] if held[0] else out


class Model(NamedTuple):
    """Texts by class and bucket; scale and size of the extreme-value law; evidence to score; or one score for all."""

    clean: np.ndarray
    toxic: np.ndarray
    n_clean: int
    n_toxic: int
    scale: float = 1.0
    size: float = 1.0
    knots: np.ndarray = np.array([0.0, 2.0, 10.0])
    values: np.ndarray = np.array([0.05, 0.1, 0.9])
    constant: float | None = None


def scores(model: Model, texts: list[str]) -> list[np.ndarray]:
    """The scores of each text's units; a unit's gains count less each time it comes back."""
    doc, total, whole = [], [], []
    base = model.n_toxic / max(1, model.n_toxic + model.n_clean)
    offset = DRIFT + math.log(base / (1 - base)) if 0 < base < 1 else DRIFT
    for numbers, group in parts(texts):
        w = Units([units(t) for t in group])
        h, levels = w.levels()
        counts = [(model.toxic[b].astype(np.float64), model.clean[b].astype(np.float64)) for _, b in levels]
        share = np.full(len(h), base)
        for k, (has, _) in enumerate(levels):
            toxic, clean = counts[k]
            for j in range(k + 1, len(levels)):  # each text is evidence once: at the longest beginning that it has
                then = levels[j][0] & ~np.any([levels[i][0] for i in range(k + 1, j)], axis=0) if j > k + 1 else levels[j][0]
                toxic, clean = (np.where(then, np.maximum(own - longer, 0), own) for own, longer in zip((toxic, clean), counts[j]))
            share = np.where(has, (toxic + STRENGTH * share) / (toxic + clean + STRENGTH), share)
        doc.append(np.array(numbers, np.int64)[w.doc])
        whole.append(h)
        total.append(np.log(share / (1 - share)) - offset)
    if not doc:
        return []
    doc, s, h = np.concatenate(doc), np.concatenate(total), np.concatenate(whole)
    gain = np.flatnonzero(s > 0)
    order = gain[np.lexsort((gain, h[gain], doc[gain]))]
    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])]) if len(order) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    s[order] /= np.arange(len(order)) - np.flatnonzero(new)[run] + 1 if len(order) else 1
    return np.split(s, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of the maximal-scoring segments, in order."""
    if not len(scores):
        return []
    sign = scores > 0
    first = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1])
    sums = np.add.reduceat(scores, first)
    ends = np.append(first[1:], len(scores))
    left: list[float] = []  # sum before and up to each candidate's end
    right: list[float] = []
    start: list[int] = []
    stop: list[int] = []
    back: list[int] = []  # the nearest earlier candidate with a smaller sum before it
    total = 0.0
    for f, e, s in zip(first.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        low, high, begin = total, total + s, f
        total = high
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], start[j]
            del left[j:], right[j:], start[j:], stop[j:], back[j:]
        left.append(low)
        right.append(high)
        start.append(begin)
        stop.append(e)
        back.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(start, stop, left, right)]


def _evidence(sums: np.ndarray, n: int, scale: float, size: float) -> tuple[float, np.ndarray]:
    """-log of the least chance of the best 1, 2, ... significant segments, and which segments are significant."""
    if not len(sums):
        return 0.0, np.zeros(0, bool)
    x = scale * sums - math.log(size * n)
    good = x >= -math.log(SIGNIFICANT)
    best = np.sort(x[good])[::-1] if good.any() else x.max(keepdims=True)
    r = np.arange(1, len(best) + 1)
    total = np.cumsum(best)
    logs = np.cumsum(np.log(r))  # log r!
    with np.errstate(divide="ignore"):
        chance = total - np.where(r > 1, (r - 1) * np.log(np.maximum(total, 1e-300)), 0) + logs + (logs - np.log(r)) - r * math.log(2)
    e = math.exp(-best[0])
    chance[0] = -math.log(-math.expm1(-e)) - math.log(2) if e > 1e-12 else best[0] - math.log(2)
    return float(chance.max()), good


def found(model: Model, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """The texts' evidence and their significant segments as (first unit, end, sum)."""
    out = []
    for s in scores(model, texts):
        all_ = segments(s)
        evidence, good = _evidence(np.array([x[2] for x in all_]), max(len(s), 1), model.scale, model.size)
        out.append((evidence, [x for x, g in zip(all_, good) if g]))
    return out


def law(greatest: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and size of the extreme-value law with the greatest likelihood, from texts' greatest sums and lengths."""
    x, n = np.asarray(greatest, float), np.maximum(np.asarray(n, float), 1)

    def slope(k):
        w = n * np.exp(-k * (x - x.min()))
        return 1 / k - x.mean() + (x * w).sum() / w.sum()

    low, high = 1e-3, 1e3
    if not len(x) or x.max() - x.min() < 1e-9:
        return 1.0, 1.0
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    k = math.sqrt(low * high)
    return k, float(len(x) / (n * np.exp(-k * x)).sum())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the best rising function from x to the share of ones; adjacent violators are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # texts, ones, least and greatest x
    for u, v in zip(x[order].tolist(), y[order].tolist()):
        pools.append([1, v, u, u])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, ones, _, most = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + ones, pools[-1][2], most]
    n, ones, least, most = np.array(pools, float).T
    values = np.maximum.accumulate((ones + y.mean()) / (n + 1))
    return np.column_stack([least, most]).ravel(), np.repeat(values, 2)


def _labels(labels: DataFrame) -> DataFrame:
    """id, y, back (held back for the calibration)."""
    per = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    return per.withColumn("back", F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0)


def _packed(docs: DataFrame) -> DataFrame:
    """id, n (bytes), z (the text, compressed), for the way to where the labels are."""

    def run(batches):
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            z = [pa.compress(t, codec="zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(z, pa.binary())], names=["id", "n", "z"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, z binary")


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Texts by class and bucket, from all rows (y, n, z), and the numbers of the classes' texts."""

    def run(batches):
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            texts = [pa.decompress(z, n, codec="zstd", asbytes=True).decode() for n, z in zip(b.column("n").to_pylist(), b.column("z").to_pylist())]
            y, met = b.column("y").to_numpy(), []
            for numbers, group in parts(texts):
                w = Units([units(t) for t in group])
                doc = np.array(numbers, np.int64)[w.doc]
                met += [np.unique((doc * BUCKETS + at)[has]) for has, at in w.levels()[1]]
            met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            for k in (0, 1):
                total[k, :BUCKETS] += np.bincount(met[y[met // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
                total[k, BUCKETS] += int((y == k).sum())
        at = np.flatnonzero(total.any(axis=0))
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[0, part]), pa.array(total[1, part])], names=["bucket", "clean", "toxic"])

    sums = rows.select("y", "n", "z").mapInArrow(run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    at = sums.column("bucket").to_numpy()
    out[0, at], out[1, at] = sums.column("clean").to_numpy(), sums.column("toxic").to_numpy()
    return out[0, :-1].astype(np.float32), out[1, :-1].astype(np.float32), int(out[0, -1]), int(out[1, -1])


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """The model from all documents with a label (doc_id, toxic)."""
    per = _labels(labels)
    # always a shuffled join: labels grow with the documents
    clean, toxic, n_clean, n_toxic = _counted(_packed(docs.select("doc_id", "text")).join(per.where("NOT back").hint("merge"), "id"))
    if not n_clean or not n_toxic:
        return Model(clean, toxic, n_clean, n_toxic, constant=float(n_toxic > 0) if n_clean or n_toxic else 0.5)
    model = Model(clean, toxic, n_clean, n_toxic)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            s = scores(shared.value, b.column("text").to_pylist())
            best = [sorted((x[2] for x in segments(v)), reverse=True)[:20] for v in s]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([len(v) for v in s], pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["id", "y", "n", "best"])

    some = F.broadcast(per.where("back").orderBy(F.xxhash64("id"), "id").limit(most).select("id", "y"))  # `most` rows of two numbers at the most
    sample = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("id")).select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    got = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, y int, n long, best array<double>").orderBy(F.xxhash64("id"), "id", "n", "best").limit(most).collect()
    got = [r[1:] for r in got]
    y, n = np.array([r[0] for r in got], float), [max(r[1], 1) for r in got]
    if not len(y) or y.min() == y.max():
        return model
    best = [np.array(r[2]) for r in got]
    greatest = np.array([b[0] if len(b) else 0.0 for b in best])
    scale, size = law(greatest[y == 0], np.array(n)[y == 0])
    x = np.array([_evidence(b, k, scale, size)[0] for b, k in zip(best, n)])
    knots, values = isotonic(x, y)
    return model._replace(scale=scale, size=size, knots=knots, values=values)


def _score(model: Model, evidence: float) -> float:
    if model.constant is not None:
        return model.constant
    more = max(evidence, 0.0)
    return 0.98 * float(np.interp(evidence, model.knots, model.values)) + 0.02 * more / (more + 10)  # rises everywhere


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of every row and `toxicity`: struct of score and the significant passages (first unit, end, sum)."""
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "text"
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())])))])

    def run(batches):
        model = shared.value
        for b in chunks(batches, name):
            texts = [t or "" for t in b.column(name).to_pylist()]
            each = [(0.0, [])] * len(texts) if model.constant is not None else found(model, texts)
            out = [{"score": _score(model, evidence), "passages": [{"first": f, "end": e, "sum": s} for f, e, s in passages]} for evidence, passages in each]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "toxicity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, toxicity struct<score: double, passages: array<struct<first: bigint, end: bigint, sum: double>>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, load(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "toxic"))
    rows = scored(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity.score").alias("score"), F.size("toxicity.passages").alias("n_passages"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
