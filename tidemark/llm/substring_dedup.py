"""Removal of long passages that an earlier document also has, by fixed-block anchors.

Blocks of `BLOCK` words do not overlap and start at every multiple of their length in each text. A window of
`WINDOW` words holds at least `full_blocks()` of them one after another, wherever they begin. Two places of one
window therefore each hold that many blocks of the other in a row:

1. the blocks of all texts are indexed by hash, in a filter of fixed size (two words of 64 bits per slot: one
   for all blocks, one for blocks met twice or more), whatever the size of the corpus;
2. every rolling window of a block's length probes it, a text's own blocks only the second part. What the
   filter lets through besides is no error, only work; nothing that repeats is missed;
3. hits in a row are extended to all windows of `WINDOW` words that hold them. Such a window is named by the hashes
   of its two halves (128 bits). Names are aggregated before the shuffle; the smallest id of each name that several ids
   have is written down. Those names make a second filter of fixed size;
4. the windows whose names pass it meet the smallest ids in a join, and the words of windows that have a smaller one
   elsewhere are removed. Touching windows make up the maximal repeats. The `HOT` names of most windows go to all tasks
   instead, which decide those windows where they are read, so no passage that many texts share is one group of the join.

Defined results: a null text has no words; rows of a null id are neither removed from nor decide; rows that
share an id don't count against each other; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, chunks, frequent, load, written

WINDOW, BLOCK = 50, 25
#: Names whose windows are decided where they are read; any other has at most one in HOT of all windows.
HOT = 1 << 17
#: Slots of the filter, as a power of two: 2 x 16 MB.
SLOT_BITS = 21


def full_blocks(window: int, block: int) -> int:
    """Blocks that any window holds whole."""
    return (window - block + 1) // block


def _split(texts: list[bytes | None]) -> list[list[bytes]]:
    return [(t or b"").split() for t in texts]


def block_hashes(df: DataFrame, block: int) -> DataFrame:
    """h of every full block of every text."""

    def run(batches):
        for b in chunks(batches):
            w = Words(_split(b.column("text").to_pylist()))
            at = w.runs(block)
            at = at[(at - w.first[w.doc[at]]) % block == 0]
            yield pa.RecordBatch.from_arrays([pa.array(w.hashes(at, block).view(np.int64))], names=["h"])

    return df.select("text").mapInArrow(run, "h long")


def filter_of(hashes: DataFrame, bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Filters of all hashes and of those met twice or more: 2^bits words each, whatever the number of hashes."""
    per = hashes.groupBy("h").count()
    words = per.select(_slot(bits), _mask().alias("m"), "count").groupBy("slot").agg(F.bit_or("m").alias("a"), F.bit_or(F.when(F.col("count") > 1, F.col("m"))).alias("b")).toArrow()
    return _filter(words, "a", bits), _filter(words, "b", bits)


def _slot(bits: int):
    return F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")


def _mask():
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", by).bitwiseAND(63).cast("int"))
    return one(0).bitwiseOR(one(6)).bitwiseOR(one(12)).bitwiseOR(one(18))


def _filter(words: pa.Table, column: str, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.uint64)
    out[words.column("slot").to_numpy()] = words.column(column).fill_null(0).to_numpy().view(np.uint64)
    return out


class Names:
    """What tasks know of the repeated names: a filter of all of them, and the smallest ids of those of very many windows."""

    def __init__(self, repeated: DataFrame, bits: int = SLOT_BITS):
        words = repeated.select(F.col("h1").alias("h")).select(_slot(bits), _mask().alias("m")).groupBy("slot").agg(F.bit_or("m").alias("m")).toArrow()
        self.filter = _filter(words, "m", bits)
        hot = frequent(repeated, "n", HOT).orderBy("h1", "h2").toArrow()
        self.h1, self.h2, self.least = hot.column("h1").to_numpy(), hot.column("h2").to_numpy(), hot.column("least").combine_chunks()

    def hot(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each name among the hot ones, -1 for none."""
        at = np.searchsorted(self.h1, h1)
        out = np.full(len(h1), -1)
        while len(self.h1):  # names may share the first half
            inside = (at < len(self.h1)) & (self.h1[np.minimum(at, len(self.h1) - 1)] == h1) & (out < 0)
            if not inside.any():
                break
            hit = inside & (self.h2[np.minimum(at, len(self.h1) - 1)] == h2)
            out[hit] = at[hit]
            at = np.where(inside & ~hit, at + 1, len(self.h1))
        return out


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(h), np.uint64)
    for by in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(by)) & np.uint64(63))
    bits = len(words).bit_length() - 1
    return (words[h >> np.uint64(64 - bits)] & mask) == mask


def candidate_windows(df: DataFrame, window: int, block: int, shared, names=None) -> DataFrame:
    """doc_id, th, at, h1, h2 of the windows that hold as many blocks of another text in a row as they must.

    With the repeated names, only windows that may have one. Those of hot names that have a smaller id elsewhere are given
    by text, as a list `all` without a name.
    """
    half, row = window // 2, full_blocks(window, block)

    def run(batches):
        every, twice = shared.value
        known = names.value if names else None
        for b in chunks(batches):
            w = Words(_split(b.column("text").to_pylist()))
            at = w.runs(block)
            h = w.hashes(at, block)
            hit = in_filter(every, h)
            own = np.flatnonzero(hit & ((at - w.first[w.doc[at]]) % block == 0))
            hit[own] = in_filter(twice, h[own])
            one = np.zeros(len(w.doc) + row * block, bool)
            one[at[hit]] = True
            every_one = one[: len(w.doc)].copy()
            for i in range(1, row):
                every_one &= one[i * block : i * block + len(w.doc)]
            before = np.concatenate([[0], np.cumsum(every_one)])
            s = w.runs(window)
            s = s[before[s + block] > before[s]]
            h1 = w.hashes(s, half)
            if known is not None:
                may = in_filter(known.filter, h1)
                s, h1 = s[may], h1[may]
            h1, h2 = h1.view(np.int64), w.hashes(s + (window - half), half).view(np.int64)
            doc = w.doc[s]
            at, take = (s - w.first[doc]).astype(np.int32), pa.array(doc)
            ids, th = b.column("doc_id").take(take), b.column("th").take(take)
            if known is None:
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(at), pa.array(h1), pa.array(h2)], names=["doc_id", "th", "at", "h1", "h2"])
                continue
            hot = known.hot(h1, h2)
            its = np.flatnonzero(hot >= 0)
            its = its[pc.greater(ids.take(pa.array(its)), known.least.take(pa.array(hot[its]))).to_numpy(zero_copy_only=False)]
            rest = np.flatnonzero(hot < 0)
            texts, n = np.unique(doc[its], return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(at[its]))
            which = pa.array(np.concatenate([texts, doc[rest]]))
            # what has no name gets one of its own, so that it is not all in one place
            h1, h2 = (np.concatenate([np.arange(len(texts)) * 7919 + int(h[0]) if len(h) else np.arange(len(texts)), h[rest]]) for h in (h1, h2))
            at = pa.array(np.concatenate([np.zeros(len(texts), np.int32), at[rest]]), mask=np.arange(len(which)) < len(texts))
            cols = [b.column("doc_id").take(which), b.column("th").take(which), at, pa.array(h1), pa.array(h2), pa.concat_arrays([lists, pa.nulls(len(rest), lists.type)])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "at", "h1", "h2", "all"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id {kind}, th long, at int, h1 long, h2 long{', all array<int>' if names else ''}")


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words are in a window that starts at one of `starts`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:n]) > 0


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, th, size, text of the rows, the texts compressed: they are most of what the last shuffle moves."""

    def run(batches):
        for b in chunks(batches):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            small = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(map(len, texts), pa.int64()), small], names=["doc_id", "th", "size", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, size long, text binary")


def deduplicated(df: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the words that stay, one space apart), n_words, n_removed of every row."""
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # rows that share an id are told apart by a hash of the text; where ids are unique that column is a constant
    shared_ids = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("th", F.xxhash64("text") if shared_ids else F.lit(0).cast("long"))
    shared = sc.broadcast(filter_of(block_hashes(docs, block)))
    # texts are read twice rather than all windows kept: those take more room than the second reading takes time
    found = candidate_windows(docs, window, block, shared)
    repeated = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1"), "repeated")
    again = candidate_windows(docs, window, block, shared, sc.broadcast(Names(repeated)))
    gone = again.join(repeated.drop("n"), ["h1", "h2"], "left").where("at IS NULL OR doc_id > least")
    gone = gone.groupBy("doc_id", "th").agg(F.concat(F.collect_list("at"), F.flatten(F.collect_list("all"))).alias("gone"))
    rows = packed(docs).join(gone.withColumnsRenamed({"doc_id": "id", "th": "t"}), (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("t")), "left")

    def run(batches):
        for b in chunks(batches):
            kept, n, removed = [], [], []
            for text, size, starts in zip(b.column("text").to_pylist(), b.column("size").to_pylist(), b.column("gone"), strict=True):
                words = pa.decompress(text, size, codec="zstd", asbytes=True).split()
                n.append(len(words))
                if starts.is_valid and words:
                    out = covered(starts.values.to_numpy(), window, len(words))
                    removed.append(int(out.sum()))
                    words = [x for x, o in zip(words, out.tolist(), strict=True) if not o]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                names=["doc_id", "kept", "n_words", "n_removed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "size", "gone").mapInArrow(run, f"doc_id {kind}, kept string, n_words long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, s + o AS i FROM (SELECT rid, s FROM win JOIN least USING (h) WHERE doc_id > m), range(50) AS t(o)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
