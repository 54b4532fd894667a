"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each text becomes one 64-bit fingerprint where it is read; texts are not shuffled for that. Distinct
fingerprints are then hashed into 2^(r+1) - 1 tables. Bit i has a label m(i) of r + 1 bits, and the mask of
table v keeps the bits whose label has odd parity with v. Any r differing bits have r labels, which leave a
non-zero v orthogonal to all of them, so every pair within radius r meets in some table: no pair is missed.

A bucket of up to `SMALL` fingerprints gives its pairs within the radius, each only in the first table where
it meets. A larger one gives a spanning forest of its links, which keeps every connection without all pairs.
Buckets of over `LARGE` are dealt out again by further masks, which keep the guarantee, before that; no task holds
one of those whole. What agrees under the masks of all levels differs in a few bits only, so the last buckets are small.
Components come from alternating large-star and small-star steps over distinct links, cut by checkpoints.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows of a null id
carry links but never name a component (null if all ids of a component are null); repeated rows share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Words, checkpointed, chunks, hot_keys, joined, load, small, spare, written

SHINGLE, RADIUS, SEED = 3, 3, 42
SMALL, LARGE, LEVELS = 32, 4096, 3


def masks(radius: int, level: int = 0) -> np.ndarray:
    """The masks of one covering family, as uint64; each level has other labels."""
    n = (1 << (radius + 1)) - 1
    labels = [(i * (1, 5, 11)[level % 3] + (level + 1) * (i // n)) % n + 1 for i in range(64)]
    return np.array([sum(1 << i for i in range(64) if (labels[i] & v).bit_count() & 1) for v in range(1, n + 1)], np.uint64)


def fold(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is 1 if set in over half of its group."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    first = (np.cumsum(sizes) - sizes)[some]
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_hashes(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts one after another, and their numbers."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    words = [(t or b"").lower().split() for t in texts]
    w = Words(words)
    size = np.minimum(shingle, np.maximum(w.n, 1))  # of a shingle of each text
    count = np.where(w.n > 0, w.n - size + 1, 0)
    at = np.repeat(w.first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    buffer = w.buffer
    ends = w.end[at + np.repeat(size, count) - 1]
    h = np.fromiter((digest(buffer[s:e]) for s, e in zip(w.start[at].tolist(), ends.tolist(), strict=True)), np.uint64, len(at))
    return h, count


def text_fingerprints(texts: list[bytes | None], shingle: int) -> np.ndarray:
    return fold(*text_hashes(texts, shingle))


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches):
        for b in chunks(batches):
            fp = text_fingerprints(b.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever of the fingerprints is connected within the radius."""
    rest, a, b = fp.copy(), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def split_forest(fp: np.ndarray, radius: int, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """forest() of a large bucket, by the buckets of further masks inside it."""
    if len(fp) <= LARGE or level > 8:
        return [forest(fp, radius)]
    out = []
    for m in masks(radius, level):
        key = fp & m
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(fp[order], cuts):
            if len(part) > 1:
                out += split_forest(part, radius, level + 1) if len(part) < len(fp) else [forest(part, radius)]
    return out


def _linker(radius: int, level: int, first: np.ndarray | None):
    """mapInArrow function over rows sorted by (g, t, key): links, and rows (a, null, g) of buckets to deal out again."""

    def group(cols, i):
        """The number of a bucket that is dealt out again."""
        return xxhash.xxh64_intdigest(f"{cols[0][i]},{cols[1][i]},{cols[2][i]}") >> 1

    def buckets(g, t, key, fp):
        """Links within complete buckets."""
        new = np.flatnonzero((np.diff(g) != 0) | (np.diff(t) != 0) | (np.diff(key) != 0)) + 1
        start = np.concatenate([[0], new, [len(fp)]])
        size = np.diff(start)
        links, again = [], []
        small = np.repeat((size <= SMALL) & (size > 1), size)
        if small.any():
            x, tt, run = fp[small], t[small], np.repeat(np.arange(len(size)), size)[small]
            for o in range(1, int(size[size <= SMALL].max())):
                hit = np.flatnonzero((run[o:] == run[:-o]) & (np.bitwise_count(x[o:] ^ x[:-o]) <= radius))
                a, b = x[hit], x[hit + o]
                if first is not None and len(a):  # a pair counts in the first table where it meets
                    met = (((a ^ b)[:, None] & first[None, :]) == 0).argmax(axis=1)
                    a, b = a[met == tt[hit]], b[met == tt[hit]]
                links.append((a, b))
        for i in np.flatnonzero(size > SMALL):
            part = fp[start[i] : start[i + 1]]
            if len(part) > LARGE and level < LEVELS - 1:
                again.append((part, group((g, t, key), start[i])))
            else:
                links += split_forest(part, radius, level + 1)
        return links, again

    def out(links, again):
        a = np.concatenate([x for x, _ in links] + [x for x, _ in again] or [np.empty(0, np.uint64)])
        b = np.concatenate([x for _, x in links] + [np.zeros(len(x), np.uint64) for x, _ in again] or [np.empty(0, np.uint64)])
        n = sum(len(x) for x, _ in links)
        group = np.concatenate([np.zeros(n, np.int64)] + [np.full(len(x), k, np.int64) for x, k in again])
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64), mask=np.arange(len(a)) >= n), pa.array(group)], names=["a", "b", "g"]
        )

    def run(batches):
        held: list[list[np.ndarray]] = []  # rows of the bucket that is not complete yet
        count, large = 0, False  # large: too many of its rows have come, they go on as they come
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "t", "key", "fp")]
            cols[3] = cols[3].view(np.uint64)
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            if not len(cols[3]):
                continue
            if held and any(h[-1] != c[0] for h, c in zip(held[-1][:3], cols[:3], strict=True)):
                new = np.concatenate([[0], new])
            if held and len(new):  # the bucket that was held is complete
                whole = [np.concatenate(x) for x in zip(*held, [c[: new[0]] for c in cols], strict=True)]
                yield out([], [(whole[3], group(whole, 0))]) if large else out(*buckets(*whole))
                cols, held, count, large = [c[new[0] :] for c in cols], [], 0, False
                new = new[1:] - new[0]
            if len(new):
                yield out(*buckets(*[c[: new[-1]] for c in cols]))
                cols = [c[new[-1] :] for c in cols]
            held.append(cols)
            count += len(cols[3])
            if count > LARGE and level < LEVELS - 1:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield out([], [(whole[3][:-1], group(whole, 0))])
                held, large = [[c[-1:] for c in whole]], True
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield out([], [(whole[3], group(whole, 0))]) if large else out(*buckets(*whole))

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a, b of the distinct fingerprints `fp` that connect all that is connected within the radius."""
    todo, found = fps.select(F.lit(0).cast("long").alias("g"), "fp"), []
    for level in range(LEVELS):
        own = masks(radius, level)
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("key")) for t, m in enumerate(own)])
        keyed = todo.select("g", "fp", F.inline(tables))
        dealt = keyed.repartition("g", "t", "key").sortWithinPartitions("g", "t", "key")
        out = checkpointed(dealt.mapInArrow(_linker(radius, level, own if level == 0 else None), "a long, b long, g long"))
        found.append(out.where("b IS NOT NULL").select("a", "b"))
        todo = out.where("b IS NULL").select("g", F.col("a").alias("fp"))
        if level < LEVELS - 1 and todo.isEmpty():
            break
    both = found[0]
    for x in found[1:]:
        both = both.union(x)
    return both.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node that has an edge a, b."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = checkpointed(e), None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        before = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(least).distinct())


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of rows of doc_id, fp."""
    fps = checkpointed(fps)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.where(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("least").alias("other"))
    heads = named.where(F.col("root") == F.col("fp")).join(least, "root", "left").select("root", F.least("least", "other").alias("component_id"))
    names = named.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **kw) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    return grouped(fingerprints(df, shingle, **kw), radius)


# --- groups of similar texts --------------------------------------------------------------------------

#: Bits of the parity sketch of a set of shingles, in words of 64.
SKETCH = 8
#: Rows of a shingle from which on its pairs are looked for in blocks.
BLOCK = 2000
#: Rows of a shingle among which each group looks for the likeliest other one.
NEAR = 512
#: Links that one task joins up at once.
LINKS = 100_000


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a list of words; one of fewer words has none."""
    w = Words([words])
    return np.unique(w.hashes(w.runs(size), size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, sorted by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(doc) != 0)]) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def _frequent(df: DataFrame, shingle: int, id_col: str, text_col: str, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and their counts in a sixteenth of the rows. They only set an order in which shingles are taken."""

    def run(batches):
        for b in chunks(batches):
            w = Words([_words(t) for t in b.column("text").to_pylist()])
            at = w.runs(shingle)
            yield pa.RecordBatch.from_arrays([pa.array(_distinct(w.doc[at], w.hashes(at, shingle))[1].view(np.int64))], names=["h"])

    some = df.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(16)) == 0).select(F.col(text_col).cast("binary").alias("text"))
    got = some.mapInArrow(run, "h long").groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _described(df: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, cls (digest of the words), num (its first 64 bits), fp (fingerprint of the set of words), size (number of
    different shingles), keys (the first of them, rare ones first), s0, s1, ... (their parity sketch) of every row.

    Two sets of the similarity s share a part s of either at least, so in any one order of all shingles they share
    one among the first (1 - s) of either and one more.
    """
    shared = df.sparkSession.sparkContext.broadcast(_frequent(df, shingle, id_col, text_col))

    def run(batches):
        known, counts = shared.value
        for b in chunks(batches):
            lists = [_words(t) for t in b.column("text").to_pylist()]
            n = len(lists)
            cls = [xxhash.xxh3_128_hexdigest(b" ".join(x)) for x in lists]
            num = np.array([int(c[:16], 16) for c in cls], np.uint64).view(np.int64)
            w = Words(lists)
            at = w.runs(1)
            doc, h = _distinct(w.doc, w.hashes(at, 1))
            fp = fold(h, np.bincount(doc, minlength=n))
            at = w.runs(shingle)
            doc, h = _distinct(w.doc[at], w.hashes(at, shingle))
            size = np.bincount(doc, minlength=n)
            bit = (h % np.uint64(64 * SKETCH)).astype(np.int64)
            sketch = np.zeros((n, 8 * SKETCH), np.uint8)
            np.bitwise_xor.at(sketch.reshape(-1), doc * (8 * SKETCH) + (bit >> 3), (128 >> (bit & 7)).astype(np.uint8))
            sketch = sketch.view(np.int64)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[i] == h, counts[i], 0)
            h = h[np.lexsort((h, rank, doc))]  # doc stays as it is
            first = np.arange(len(h)) - (np.cumsum(size) - size)[doc] <= (size - np.ceil(similarity * size - 1e-9))[doc]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=n))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[first].view(np.int64)))
            cols = [b.column("doc_id"), b.column("th"), pa.array(cls), pa.array(num), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32)), keys]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(x)) for x in sketch.T)], names=["doc_id", "th", "cls", "num", "fp", "size", "keys", *_SKETCH])

    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, cls string, num long, fp long, size int, keys array<bigint>, {', '.join(f'{c} long' for c in _SKETCH)}")


_SKETCH = tuple(f"s{i}" for i in range(SKETCH))


def _met(batches):
    """mapInArrow function over rows sorted by key: the rows of keys of several rows. One row is held at a time."""
    last = pending = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        same = key[1:] == key[:-1]
        before = np.concatenate([[key[0] == last], same])
        if before[0] and pending is not None:
            yield pending
        keep = before.copy()
        keep[:-1] |= same
        yield b.filter(pa.array(keep))
        last, pending = key[-1], None if keep[-1] else b.slice(b.num_rows - 1)


def _may_reach(similarity: float, size_a, pos_a, size_b, pos_b):
    """Whether sets of these sizes that first meet at these places may be similar; numpy arrays or columns alike."""
    total = size_a + size_b
    near = (size_a >= similarity * size_b - 1e-9) & (size_b >= similarity * size_a - 1e-9)
    need = similarity / (1 + similarity) * total - 1e-9
    return near & (size_a - pos_a >= need) & (size_b - pos_b >= need)


def _most_apart(similarity: float, size_a, size_b):
    """In how many shingles sets of these sizes may differ; numpy arrays or columns alike."""
    return (1 - similarity) / (1 + similarity) * (size_a + size_b) + 1e-9


def _cells(batches):
    """From rows sorted by key, ci, cj: complete cells as columns (num, label, size, pos, sketch, blk, and whether ci = cj), and the places where cells begin and the last ends."""
    names, held = ["key", "ci", "cj", "num", "label", "size", "pos", "blk"], None

    def cells(cols, cuts):
        key, ci, cj, num, label, size, pos, blk, sketch = cols
        return (num, label, size.astype(np.int64), pos, sketch, blk, ci == cj), cuts

    for b in batches:
        cols = [b.column(c).to_numpy() for c in names]
        cols.append(np.stack([b.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        if len(cuts):
            yield cells([c[: cuts[-1]] for c in cols], np.concatenate([[0], cuts]))
        held = [c[cuts[-1] :] for c in cols] if len(cuts) else cols
    if held is not None and len(held[0]):
        yield cells(held, np.array([0, len(held[0])]))


def _room(similarity: float, size, pos, sketch, i, j):
    """By how many shingles rows i, j are nearer, as their sketches say, than the similarity asks for; below 0: they can't reach it."""
    differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=-1, dtype=np.int64)
    return np.where(_may_reach(similarity, size[i], pos[i], size[j], pos[j]), _most_apart(similarity, size[i], size[j]) - differ, -1.0)


def _by_distance(cuts: np.ndarray):
    """Rows i, j of all cells of up to SMALL rows, by their distance in the table."""
    run, n = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.diff(cuts)
    few = np.flatnonzero(np.repeat(n <= SMALL, n))
    for o in range(1, SMALL):
        i, j = few[:-o], few[o:]
        same = run[i] == run[j]
        if not same.any():
            break
        yield i[same], j[same]


def _pairs_out(found):
    """mapInArrow rows of pairs (one array each), those of some 500,000 at a time without repeats."""

    def out(some):
        a, b = (np.concatenate(x) for x in zip(*some, strict=True))
        both = np.unique(np.rec.fromarrays([np.minimum(a, b), np.maximum(a, b)]))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[f])) for f in ("f0", "f1")], names=["na", "nb"])

    some, total = [], 0
    for pair in found:
        some.append(pair)
        total += len(pair[0])
        if total > 500_000:
            yield out(some)
            some, total = [], 0
    if some:
        yield out(some)


def _nearest_pairs(similarity: float):
    """mapInArrow function over rows sorted by key, ci, cj: of each label in a cell, the pair with another label that is likeliest to be similar.

    So a cell gives a row for a label at the most, however many of its rows are alike.
    """

    def pairs_of(cols, cuts):
        num, label, size, pos, sketch, *_ = cols
        room, other = np.full(len(num), -1.0), np.zeros(len(num), np.int64)

        def better(i, j, r):
            """Row i takes j where that is nearer; no row is twice in i."""
            up = r > room[i]
            room[i[up]], other[i[up]] = r[up], j[up]

        for i, j in _by_distance(cuts):
            i, j = i[label[i] != label[j]], j[label[i] != label[j]]
            r = _room(similarity, size, pos, sketch, i, j)
            better(i, j, r)
            better(j, i, r)
        for k in np.flatnonzero(np.diff(cuts) > SMALL):
            every = np.arange(cuts[k], cuts[k + 1])
            for at in range(cuts[k], cuts[k + 1], 64):
                i = np.arange(at, min(at + 64, cuts[k + 1]))
                r = np.where(label[i][:, None] != label[every], _room(similarity, size, pos, sketch, i[:, None], every), -1.0)
                most = r.argmax(axis=1)
                better(i, every[most], r[np.arange(len(i)), most])
        i = np.flatnonzero(room >= 0)
        run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[i]
        i = i[np.lexsort((-room[i], label[i], run))]
        run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[i]
        first = np.concatenate([[True], (np.diff(run) != 0) | (np.diff(label[i]) != 0)]) if len(i) else np.zeros(0, bool)
        i = i[first]
        if len(i):
            yield num[i], num[other[i]]

    def run(batches):
        yield from _pairs_out(pair for cols, cuts in _cells(batches) for pair in pairs_of(cols, cuts))

    return run


def _block_pairs(similarity: float):
    """mapInArrow function over rows sorted by key, ci, cj: pairs of different labels that may reach the similarity, within each cell.

    A cell holds the rows of two blocks of a key, or of one; of two, only pairs across are its own. Sketches decide here
    already, so unlike texts that share a rare shingle are compared but give no row.
    """

    def of_small(cols, cuts):
        num, label, size, pos, sketch, blk, one = cols
        for i, j in _by_distance(cuts):
            own = (label[i] != label[j]) & ((blk[i] != blk[j]) | one[i])
            i, j = i[own], j[own]
            ok = _room(similarity, size, pos, sketch, i, j) >= 0
            if ok.any():
                yield num[i[ok]], num[j[ok]]

    def of_large(cols):
        num, label, size, pos, sketch, blk, one = cols
        kinds, inverse, n = np.unique(label, return_inverse=True, return_counts=True)
        most, every = inverse == n.argmax(), np.arange(len(num))
        for i in np.flatnonzero(~most) if len(kinds) > 1 else ():
            j = every[(inverse != inverse[i]) & (most | (every > i)) & ((blk != blk[i]) | one[0])]
            j = j[_room(similarity, size, pos, sketch, i, j) >= 0]
            if len(j):
                yield np.full(len(j), num[i]), num[j]

    def pairs_of(cols, cuts):
        yield from of_small(cols, cuts)
        for k in np.flatnonzero(np.diff(cuts) > SMALL):
            yield from of_large([c[cuts[k] : cuts[k + 1]] for c in cols])

    def run(batches):
        yield from _pairs_out(pair for cols, cuts in _cells(batches) for pair in pairs_of(cols, cuts))

    return run


def _tied(batches):
    """mapInArrow function over links a, b: what LINKS of them connect, each with the least of it (the least one too)."""

    def out(some):
        a, b = (np.concatenate(x) for x in zip(*some, strict=True))
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(code[: len(a)].tolist(), code[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["a", "b"])

    some, total = [], 0
    for batch in batches:
        some.append([batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"])
        total += batch.num_rows
        if total >= LINKS:
            yield out(some)
            some, total = [], 0
    if total:
        yield out(some)


def merged(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """node, root of all that has a link: labels (None: none yet), joined up by more links a, b.

    Links are taken between roots, and tasks join up LINKS at a time, so that rounds over all of them remain only where there are more.
    """
    if labels is not None:
        for x in "ab":
            more = more.join(small(labels).toDF(x, "root"), x, "left").withColumn(x, F.coalesce("root", x)).drop("root")
    more = written(more.where("a <> b").select("a", "b").distinct(), "edges")
    tasks = max(1, -(-more.count() // LINKS))
    kind = more.schema["a"].dataType.simpleString()
    up = more.coalesce(tasks).mapInArrow(_tied, f"a {kind}, b {kind}")
    up = written(up.toDF("node", "root") if tasks == 1 else components(up), "up")
    if labels is None:
        return up
    moved = labels.join(small(up).toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.union(up.join(small(labels.select("node")), "node", "left_anti").select("node", "root")), "labels")


def representatives(rows: DataFrame, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """doc_id, th (xxhash64 of the text) of the row that stands for each group of similar texts.

    rows: as `_described` gives them; texts: doc_id, th, text. Texts of the same words are one class.

    1. Classes whose word sets have fingerprints within the radius are candidates, found as above. That links most of
       what is alike, however large the group.
    2. Two sets of the similarity share one of their first shingles, so classes also meet on those: first each group so far,
       with the likeliest class of another group among NEAR of a shingle, which joins up large groups by about as many pairs
       as they have rows; then all classes that are in no common group by then. No pair of the similarity is missed, whatever
       the fingerprints say.
    3. A candidate goes on if sizes, places of the shared shingle and parity sketches allow the similarity: sketches that
       differ in d bits mean that d shingles at least are in one set only. The Jaccard similarity of the sets decides.

    A group is a component of the links that pass; its smallest id stands for it, a null id only where there is
    no other.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    some = [F.first(c).alias(c) for c in ("num", "fp", "size", "keys", *_SKETCH)]
    classes = written(rows.groupBy("cls").agg(first, *some), "classes")
    features = classes.select("cls", "size", *_SKETCH)

    def possible(pairs: DataFrame) -> DataFrame:
        """cls_a < cls_b of the candidates whose sketches allow the similarity."""
        pairs = written(pairs.select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b")).where("cls_a <> cls_b").distinct(), "pairs")
        for x in "ab":
            own = features.withColumnsRenamed({c: f"{c}_{x}" for c in features.columns})
            pairs = joined(pairs, own, f"cls_{x}", hot_keys(pairs.select(f"cls_{x}"), f"cls_{x}"))
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
        near = _may_reach(similarity, F.col("size_a"), F.lit(0), F.col("size_b"), F.lit(0))
        return written(pairs.where(near & (differ <= _most_apart(similarity, F.col("size_a"), F.col("size_b")))).select("cls_a", "cls_b"), "possible")

    def packed(batches):
        for b in chunks(batches):
            whole = [b" ".join(_words(t)) for t in b.column("text").to_pylist()]
            z = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(map(len, whole), pa.int64()), z], names=["cls", "n", "z"])

    def verify(batches):
        known: dict[str, np.ndarray] = {}
        held = 0
        for b in batches:
            ok = []
            columns = [b.column(c).to_pylist() for c in ("cls_a", "n_a", "z_a", "cls_b", "n_b", "z_b")]
            for a, na, za, c, nc, zc in zip(*columns, strict=True):
                for cls, n, z in ((a, na, za), (c, nc, zc)):
                    if cls not in known:
                        if held > 2_000_000:
                            known, held = {k: known[k] for k in (a, c) if k in known}, 0
                        known[cls] = shingle_set(pa.decompress(z, n, codec="zstd", asbytes=True).split(), shingle)
                        held += len(known[cls])
                ok.append(jaccard(known[a], known[c]) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("cls_a"), b.column("cls_b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b of the candidates that reach the similarity."""
        pairs = possible(pairs)
        wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct().join(classes, "cls").select("cls", F.col("first.doc_id").alias("of"), F.col("first.th").alias("t"))
        own = texts.join(small(written(wanted, "wanted")), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("t"))).select("cls", "text")
        own = written(own.mapInArrow(packed, "cls string, n long, z binary").dropDuplicates(["cls"]), "texts")
        hot = {x: hot_keys(pairs.select(f"cls_{x}"), f"cls_{x}") for x in "ab"}
        for x in "ab":
            pairs = joined(pairs, own.withColumnsRenamed({c: f"{c}_{x}" for c in own.columns}), f"cls_{x}", hot[x])
        return written(pairs.select("cls_a", "n_a", "z_a", "cls_b", "n_b", "z_b").mapInArrow(verify, "a string, b string"), "links")

    heads = classes.groupBy("fp").agg(F.min("cls").alias("head"))
    named = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"cls_{c}"))
    found = links(heads.select("fp"), radius).join(named("a"), "a").join(named("b"), "b").select("cls_a", "cls_b")
    same = classes.join(heads, "fp").where("cls <> head").select(F.col("head").alias("cls_a"), F.col("cls").alias("cls_b"))
    linked = verified(found.union(same))

    met = classes.where("size > 0").select("num", "size", F.posexplode("keys").alias("pos", "key")).select("key", "num", "size", "pos")
    met = written(met.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key long, num long, size int, pos int"), "met")
    cls_of = lambda c: classes.select(F.col("num").alias(f"n{c}"), F.col("cls").alias(f"cls_{c}"))

    def met_again(labels: DataFrame, most: int) -> DataFrame:
        """The rows of shingles that are met in several groups, with the groups' labels, sketches and `blocks` of up to about `most` rows."""
        own = labels.join(classes.select(F.col("cls").alias("node"), "num"), "node").groupBy("num").agg(F.min(F.xxhash64("root")).alias("label"))
        rows_of = written(met.join(small(own), "num", "left").select("key", "num", F.coalesce("label", "num").alias("label"), "size", "pos"), "labelled")
        per = rows_of.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("low <> high")
        return rows_of.join(per.select("key", "blocks"), "key").join(classes.select("num", *_SKETCH), "num")

    def linked_in(cells: DataFrame, pairs) -> DataFrame:
        """a, b of the pairs of a function over cells that reach the similarity."""
        cells = cells.select("key", "ci", "cj", "blk", "num", "label", "size", "pos", *_SKETCH)
        found = cells.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "num").mapInArrow(pairs, "na long, nb long").distinct()
        return verified(found.join(cls_of("a"), "na").join(cls_of("b"), "nb"))

    labels = merged(None, linked)
    near = met_again(labels, NEAR).withColumn("blk", F.pmod(F.xxhash64("num", "key"), F.col("blocks")).cast("int"))
    labels = merged(labels, linked_in(near.withColumn("ci", F.col("blk")).withColumn("cj", F.col("blk")), _nearest_pairs(similarity)))
    rest = met_again(labels, BLOCK).withColumn("blk", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("ci", F.least("blk", "other")).withColumn("cj", F.greatest("blk", "other"))
    labels = merged(labels, linked_in(rest, _block_pairs(similarity)))

    groups = classes.select("cls", "first").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    return groups.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.th")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, **kw) -> DataFrame:
    """The rows that stand for their groups, one of repeated rows; all columns kept.

    An id that several rows share stands with the text of the least hash; which of rows that repeat id and text stays is
    open where their other columns differ.
    """
    rows = written(_described(df, similarity, shingle, id_col, text_col), "described")
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    stay = written(representatives(rows, texts, similarity, shingle, **kw), "stay")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    keys = rows.select("doc_id", "th")
    gone = written(keys.join(stay, same(keys, stay), "left_anti").distinct(), "gone")
    own, th = spare(df, "of"), spare(df, "th")
    kept = df.join(small(gone).toDF(own, th), F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(th)), "left_anti")
    repeated = keys.groupBy("doc_id", "th").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
