"""Benchmark decontamination by item-sized windows and a prefix join of their shingles.

Texts and items become lower-case words without punctuation. Every window of a text that is as long as some
item is a candidate; one only goes on if enough of its shingles may be shingles of items, by a filter of fixed
size. A window and an item of m shingles each have the similarity s only if they share t = 2 s m / (1 + s) of
them, so if both put their shingles in the order of their hashes, some shingle is among the first m - t + 1 of
either. The distinct windows meet the items in a join on those, and the exact similarity of the two multisets of
shingles, sum of minima over sum of maxima, decides. Neither step loses a window that reaches the similarity.

Items are never collected: they meet the windows in joins, which Spark broadcasts only below its size limit.
What goes to every task is the filter and the list of item lengths.

Defined results: null and empty texts match nothing, nor do items without a word; an item of under five
words is one shingle; rows of one id count as one text (a null id too); an empty table or benchmark
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, checkpointed, chunks, load

SHINGLE, SIMILARITY = 5, 0.8
#: Slots of the shingle filter, as a power of two: 2 MB.
SLOT_BITS = 18
_ONLY = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_ONLY).split()


def _size(n: int) -> int:
    return min(SHINGLE, n)


def _shared(m: int, similarity: float) -> int:
    """Shingles that two lists of m must share to reach the similarity."""
    return max(1, int(np.ceil(2 * similarity * m / (1 + similarity) - 1e-9)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """The arrays of hashes as lists of longs."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([*rows, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)))


def item_rows(bench: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """item_id, n (words), keys (first hashes of shingles), words of the items that have a word."""

    def run(batches):
        for b in chunks(batches):
            lists = [words_of(t) for t in b.column("text").to_pylist()]
            w = Words(lists)
            keep = np.flatnonzero(w.n)
            keys = []
            for i in keep:
                m = w.n[i] - _size(w.n[i]) + 1
                keys.append(np.unique(np.sort(w.hashes(w.first[i] + np.arange(m), _size(w.n[i])))[: m - _shared(m, similarity) + 1]))
            cols = [b.column("item_id").take(pa.array(keep)), pa.array(w.n[keep].astype(np.int32)), _lists(keys), pa.array([b" ".join(lists[i]) for i in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "n", "keys", "words"])

    kind = bench.schema["item_id"].dataType.simpleString()
    return bench.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n int, keys array<bigint>, words binary")


def _slot(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.zeros(len(h), np.uint64)
    for by in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(by)) & np.uint64(63))
    return h >> np.uint64(64 - SLOT_BITS), mask


def shingle_filter(items: DataFrame) -> np.ndarray:
    """A filter of all items' shingles; its size does not depend on theirs."""

    def run(batches):
        for b in batches:
            w = Words([x.split(b" ") for x in b.column("words").to_pylist()])
            for k in range(1, SHINGLE + 1):
                at = w.runs(k)
                at = at[np.minimum(SHINGLE, w.n[w.doc[at]]) == k]
                slot, mask = _slot(w.hashes(at, k))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(mask.view(np.int64))], names=["slot", "m"])

    got = items.select("words").mapInArrow(run, "slot int, m long").groupBy("slot").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint64)
    if got.num_rows:
        out[got.column("slot").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return out


def windows(docs: DataFrame, lengths: list[int], shared, similarity: float) -> DataFrame:
    """doc_id, at, n, wh (hash of the words), keys (first hashes of shingles), words of the item-sized windows that may be similar to an item."""

    def run(batches):
        filt = shared.value
        for b in chunks(batches):
            lists = [words_of(t) for t in b.column("text").to_pylist()]
            w = Words(lists)
            for k in sorted({_size(n) for n in lengths}):
                at = w.runs(k)
                h = w.hashes(at, k)
                slot, mask = _slot(h)
                known = (filt[slot] & mask) == mask
                if not known.any():
                    continue
                full, before = np.zeros(len(w.doc), np.uint64), np.zeros(len(w.doc) + 1, np.int64)
                full[at] = h
                before[at[known] + 1] = 1
                np.cumsum(before, out=before)
                some = np.zeros(len(w.n), bool)
                some[w.doc[at[known]]] = True
                for n in (n for n in lengths if _size(n) == k):
                    m = n - k + 1
                    least = _shared(m, similarity)
                    s = np.concatenate([np.arange(w.first[d], w.first[d] + w.n[d] - n + 1) for d in np.flatnonzero(some & (w.n >= n))] or [np.empty(0, np.int64)])
                    s = s[before[s + m] - before[s] >= least]
                    if not len(s):
                        continue
                    keys = []
                    for p in np.array_split(s, len(s) * m // 100_000 + 1):
                        h = np.sort(full[p[:, None] + np.arange(m)], axis=1)[:, : m - least + 1]
                        slot, mask = _slot(h.ravel())
                        keys += [np.unique(x[k]) for x, k in zip(h, ((filt[slot] & mask) == mask).reshape(h.shape), strict=True)]
                    doc = w.doc[s]
                    cols = [b.column("doc_id").take(pa.array(doc)), pa.array((s - w.first[doc]).astype(np.int32)), pa.array(np.full(len(s), n, np.int32)), pa.array(w.hashes(s, n).view(np.int64)), _lists(keys), pa.array([w.slice(i, n) for i in s.tolist()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "n", "wh", "keys", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, at int, n int, wh long, keys array<bigint>, words binary")


def similarity_of(a: bytes, b: bytes) -> float:
    """Sum of minima over sum of maxima of the counts of the shingles of two word lists."""
    counts = []
    for x in (a, b):
        w = x.split(b" ")
        k, c = _size(len(w)), {}
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            c[s] = c.get(s, 0) + 1
        counts.append(c)
    both = sum(min(n, counts[1].get(s, 0)) for s, n in counts[0].items())
    return both / max(1, sum(counts[0].values()) + sum(counts[1].values()) - both)


def contaminated(docs: DataFrame, bench: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity (best) and at (its first word) of every text and item that it holds."""
    sc = docs.sparkSession.sparkContext
    items = checkpointed(item_rows(bench, similarity))
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # no more than the longest item's words
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = checkpointed(windows(rows, lengths, sc.broadcast(shingle_filter(items)), similarity))
    left = found.select("n", "wh", F.explode("keys").alias("key")).distinct()
    right = items.select("n", "item_id", F.explode("keys").alias("key"))
    near = left.join(right, ["n", "key"]).select("n", "wh", "item_id").distinct()
    pairs = found.join(near, ["n", "wh"]).join(items.select("item_id", "n", F.col("words").alias("item")).distinct(), ["item_id", "n"])

    def verify(batches):
        for b in batches:
            known: dict[tuple[bytes, bytes], float] = {}
            out = []
            for p in zip(b.column("words").to_pylist(), b.column("item").to_pylist(), strict=True):
                if p not in known:
                    known[p] = similarity_of(*p)
                out.append(known[p])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), b.column("at"), pa.array(out, pa.float64())], names=["doc_id", "item_id", "at", "similarity"])

    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {bench.schema['item_id'].dataType.simpleString()}"
    checked = pairs.select("doc_id", "item_id", "at", "words", "item").mapInArrow(verify, f"{kinds}, at int, similarity double").where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("at")).alias("at")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.at")).alias("at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
