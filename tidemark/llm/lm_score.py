"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its UTF-8 bytes, then one end mark; marks also stand before its first byte. Each byte is eight binary
choices, and each choice has a node in the tree of every context of 0 to `DEPTH` bytes. From the counts of
the training texts alone, a node's block probability is Krichevsky-Trofimov's estimate, weighted half and half
with the product of its children's; so the counts can be summed in any order by Spark. The tree then stays
fixed: the probability of a choice mixes the estimates of all depths with the weights that the tree has learnt.
code length per byte = -log2(probability) / bytes.

How it runs: tasks count grams (context and byte) and words of their texts; Spark sums them; the deep part
of the tree is made in partitions that hold whole contexts of `TOP` bytes, the top of it by grouping upwards.
Every gram then has its log probability. The `GRAMS` and `WORDS` most frequent ones of all texts, learnt from or not, go
to the tasks that score (a bounded table); the others are looked up by joins with the full tables, so no count is dropped
and no key of those joins has more than a small part of the rows.

Defined results: a null text counts as empty and is scored as its end mark; a null id counts as the empty
text for the split; repeated rows each count; without training texts every choice has probability 1/2 and
every token 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, chunks, frequent, held_out, load, text_or_empty

DEPTH, TOP = 5, 3
#: Bounds of the tables that go to every task.
GRAMS, WORDS = 1 << 20, 1 << 18
_MARK, _HALF, _LOG10 = 0xFF, float(np.log(0.5)), float(np.log(10))


# --- grams and words of texts ---------------------------------------------------------------------


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts, the latest context byte highest and the coded byte lowest, and their numbers by text."""
    mark = bytes([_MARK])
    buffer = np.frombuffer(b"".join(mark * depth + t + mark for t in texts), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    g = buffer[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        g |= buffer[depth - k : len(buffer) - k].astype(np.int64) << (8 * (depth - k + 1))
    last = np.cumsum(n + depth)
    keep = np.ones(len(buffer), bool)
    for k in range(depth):
        keep[last - n - depth + k] = False
    return g[keep[depth:]], n


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *[np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts])


def counted_grams(rows: DataFrame, depth: int) -> DataFrame:
    """g, n (in all texts), n_train of every gram."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            g, n, t = summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return g, n, t

        def batch(g, n, t):
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(t)], names=["g", "n", "n_train"])

        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            train = b.column("train").to_numpy(zero_copy_only=False)
            for part in (True, False):
                g, _ = grams_of([x for x, y in zip(texts, train, strict=True) if y == part], depth)
                if len(g):
                    u, n = np.unique(g, return_counts=True)
                    held.append((u, n, n if part else np.zeros_like(n)))
                    size += len(u)
            if size > 1_000_000:
                held.append(flush())
                size = len(held[0][0])
                if size > 600_000:
                    yield batch(*held.pop())
                    size = 0
        if held:
            yield batch(*flush())

    return rows.select("text", "train").mapInArrow(run, "g long, n long, n_train long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def counted_words(rows: DataFrame) -> DataFrame:
    """w, n (in all texts), c (in the training texts) of every word, in lower case."""

    def run(batches):
        held: dict[bool, Counter[bytes]] = {True: Counter(), False: Counter()}

        def batch(train):
            keys, n = pa.array(list(held[train].keys()), pa.binary()), pa.array(list(held[train].values()), pa.int64())
            held[train].clear()
            return pa.RecordBatch.from_arrays([keys, n, n if train else pa.array(np.zeros(len(n), np.int64))], names=["w", "n", "c"])

        for b in batches:
            for t, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
                held[train].update(t.lower().split())
                if len(held[train]) > 200_000:
                    yield batch(train)
        yield batch(True)
        yield batch(False)

    return rows.select("text", "train").mapInArrow(run, "w binary, n long, c long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


# --- the tree --------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by Stirling's series after six steps up."""
    z, product = x.copy(), np.ones_like(x)
    for _ in range(6):
        product *= z
        z += 1
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def deep_tree(g: np.ndarray, n: np.ndarray, depth: int, top: int):
    """For each of the eight choices: names, n0, n1, ln weighted probability of the nodes at depth `top`, for each
    gram its node there, its bit, and the probability of the bit as the tree from `top` down has it."""
    x = g & 255
    contexts = {d: (g >> (8 * (depth - d + 1))) << 8 for d in range(top, depth + 1)}
    for j in range(8):
        node, bit = (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1
        below = below_of = weighted = None
        levels = []
        for d in range(depth, top - 1, -1):
            names, of = np.unique(contexts[d] | node, return_inverse=True)
            n1 = np.bincount(of, weights=n * bit, minlength=len(names))
            n0 = np.bincount(of, weights=n, minlength=len(names)) - n1
            own = log_kt(n0, n1)
            if weighted is None:
                share, weighted = np.ones(len(names)), own
            else:
                one = np.zeros(len(below), np.int64)  # a gram of each child
                one[below_of] = np.arange(len(g))
                both = np.logaddexp(_HALF + own, _HALF + np.bincount(of[one], weights=weighted, minlength=len(names)))
                share, weighted = np.exp(_HALF + own - both), both
            levels.append((of, share, n0, n1))
            below, below_of = names, of
        p = np.zeros(len(g))
        for of, share, n0, n1 in levels:  # from the deepest up
            kt = (np.where(bit == 1, n1[of], n0[of]) + 0.5) / (n0 + n1 + 1.0)[of]
            p = share[of] * kt + (1 - share[of]) * p
        yield below, levels[-1][2], levels[-1][3], weighted, below_of, bit, p


def _whole_contexts(batches, depth: int, top: int, rows: int = 200_000):
    """Arrays g, n, n_train of batches sorted by g, cut where the context of `top` bytes changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "n", "n_train")])
        if sum(len(x[0]) for x in held) >= rows:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            context = cols[0] >> (8 * (depth - top + 1))
            cut = int(np.searchsorted(context, context[-1]))
            held = [[c[cut:] for c in cols]]
            if cut:
                yield [c[:cut] for c in cols]
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def gram_scores(grams: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """g, n, lp (log10 of the probability of the gram's byte after its context) of every gram."""
    sc = grams.sparkSession.sparkContext
    context = F.shiftright("g", 8 * (depth - top + 1))
    dealt = grams.repartition(context).sortWithinPartitions("g")

    def up(batches):
        for g, _, n in _whole_contexts(batches, depth, top):
            for names, n0, n1, lw, *_ in deep_tree(g, n, depth, top):
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n0), pa.array(n1), pa.array(lw)], names=["name", "n0", "n1", "lw"])

    def weigh(batches):
        """own and weighted probability of nodes from their counts and the sums of their children's."""
        for b in batches:
            n0, n1, below = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n0", "n1", "lw"))
            own = log_kt(n0, n1)
            both = np.logaddexp(_HALF + own, _HALF + below)
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("n0"), b.column("n1"), pa.array(both), pa.array(np.exp(_HALF + own - both))], names=["name", "n0", "n1", "lw", "share"])

    # a name is the context, latest byte highest, then the node; going up drops the context's lowest byte
    parent = F.shiftright("name", 16) * 256 + F.col("name").bitwiseAND(255)
    nodes = dealt.mapInArrow(up, "name long, n0 double, n1 double, lw double")
    levels = []
    for _ in range(top):
        sums = nodes.groupBy(parent.alias("name")).agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "lw")])
        nodes = checkpointed(sums.mapInArrow(weigh, "name long, n0 double, n1 double, lw double, share double"))
        levels.append(nodes)
    # p = a0 or a1 (for bit 0 or 1) + rest * (what the tree from `top` down says)
    table = None
    for d, level in enumerate(reversed(levels)):  # from the root down
        kt = lambda c: F.col("share") * (F.col(c) + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        row = level.select("name", kt("n0").alias("k0"), kt("n1").alias("k1"), (1 - F.col("share")).alias("r"))
        if table is None:
            table = row.select("name", F.col("k0").alias("a0"), F.col("k1").alias("a1"), F.col("r").alias("rest"))
        else:
            above = table.withColumnRenamed("name", "above")
            table = row.withColumn("above", parent).join(above, "above").select("name", (F.col("a0") + F.col("rest") * F.col("k0")).alias("a0"), (F.col("a1") + F.col("rest") * F.col("k1")).alias("a1"), (F.col("rest") * F.col("r")).alias("rest"))
    # at most 256^(top - 1) contexts of 255 nodes, however long the texts are
    got = table.orderBy("name").toArrow()
    upper = sc.broadcast([got.column(c).to_numpy() for c in ("name", "a0", "a1", "rest")])

    def down(batches):
        name, a0, a1, rest = upper.value
        for g, n, t in _whole_contexts(batches, depth, top):
            lp = np.zeros(len(g))
            for names, _, _, _, of, bit, p in deep_tree(g, t, depth, top):
                at = np.searchsorted(name, ((names >> 16) << 8) | (names & 255))[of]
                lp += np.log(np.where(bit == 1, a1[at], a0[at]) + rest[at] * p)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(lp / _LOG10)], names=["g", "n", "lp"])

    return dealt.mapInArrow(down, "g long, n long, lp double")


# --- bounded tables of the frequent ones -------------------------------------------------------------


class Table:
    """int64 -> double by open addressing in numpy; what finds no place is left out."""

    PROBES = 12

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        for i in range(self.PROBES):
            slot = self._slot(keys, i)
            _, first = np.unique(slot, return_index=True)
            won = first[self.keys[slot[first]] == -1]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            stay = np.ones(len(keys), bool)
            stay[won] = False
            keys, values = keys[stay], values[stay]

    def _slot(self, keys: np.ndarray, i: int) -> np.ndarray:
        h = (keys.view(np.uint64) + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where absent) and the places of the absent."""
        out = np.zeros(len(keys))
        todo, absent = np.arange(len(keys)), []
        for i in range(self.PROBES):
            if not len(todo):
                break
            k = keys[todo]
            slot = self._slot(k, i)
            at = self.keys[slot]
            hit = at == k
            out[todo[hit]] = self.values[slot[hit]]
            absent.append(todo[at == -1])
            todo = todo[~hit & (at != -1)]
        return out, np.concatenate([*absent, todo]) if absent else todo


# --- scores -------------------------------------------------------------------------------------------


def _lists(kind: pa.DataType, doc: np.ndarray, keys, k: np.ndarray, n: int) -> pa.Array:
    """Per text the list of (key, count); rows are sorted by text."""
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys, kind), pa.array(k.astype(np.int64))], names=["x", "k"]))


def scored(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score of every row; `train` tells the training rows."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), train.alias("train"))
    words = checkpointed(counted_words(rows))
    grams = checkpointed(gram_scores(checkpointed(counted_grams(rows, depth)), depth))
    ends = rows.where("train").count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    z = float(total + distinct + 1)
    got = frequent(words, "n", WORDS).toArrow()
    known = sc.broadcast(dict(zip(got.column("w").to_pylist(), got.column("c").to_pylist(), strict=True)))
    got = frequent(grams, "n", GRAMS).toArrow()
    table = sc.broadcast(Table(got.column("g").to_numpy(), got.column("lp").to_numpy()))
    end_score = float(np.log10((ends + 1) / z))

    def run(batches):
        count, of = known.value.get, table.value.get
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            m = len(texts)
            g, n = grams_of(texts, depth)
            lp, absent = of(g)
            score = np.add.reduceat(lp, np.cumsum(n) - n)
            gdoc = np.repeat(np.arange(m), n)[absent]
            order = np.lexsort((g[absent], gdoc))
            gd, gk = gdoc[order], g[absent][order]
            new = np.flatnonzero(np.concatenate([[True], (gd[1:] != gd[:-1]) | (gk[1:] != gk[:-1])])) if len(gd) else np.empty(0, np.int64)
            rare_g = _lists(pa.int64(), gd[new], gk[new], np.diff(np.concatenate([new, [len(gd)]])), m)
            tokens, base, seen, wdoc, ww, wk = np.ones(m, np.int64), np.full(m, end_score), np.full(m, int(ends > 0)), [], [], []
            for i, t in enumerate(texts):
                w = t.lower().split()
                tokens[i] += len(w)
                c = [count(x) for x in w]
                rare = Counter(x for x, y in zip(w, c, strict=True) if y is None)
                have = np.array([y for y in c if y is not None], np.float64)
                base[i] += float(np.log10((have + 1) / z).sum())
                seen[i] += int(np.count_nonzero(have))
                wdoc += [i] * len(rare)
                ww += rare.keys()
                wk += rare.values()
            rare_w = _lists(pa.binary(), np.array(wdoc, np.int64), ww, np.array(wk, np.int64), m)
            cols = [b.column("doc_id"), b.column("train"), pa.array(n - 1), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(score), rare_w, rare_g]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "train", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rare_w", "rare_g"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    part = rows.mapInArrow(run, f"doc_id {kind}, train boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, rare_w array<struct<x:binary,k:long>>, rare_g array<struct<x:long,k:long>>")
    part = checkpointed(part).withColumn("rid", F.monotonically_increasing_id())
    rare_w = part.select("rid", F.inline("rare_w")).join(words.withColumnRenamed("w", "x"), "x", "left")
    c = F.coalesce("c", F.lit(0))
    rare_w = rare_w.groupBy("rid").agg(F.sum(F.col("k") * F.log10((c + 1) / F.lit(z))).alias("more_base"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"))
    rare_g = part.select("rid", F.inline("rare_g")).join(grams.withColumnRenamed("g", "x"), "x").groupBy("rid").agg(F.sum(F.col("k") * F.col("lp")).alias("more_score"))
    out = part.drop("rare_w", "rare_g").join(rare_w, "rid", "left").join(rare_g, "rid", "left")
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select("doc_id", "train", "n_bytes", "n_tokens", add("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), add("base_score", "more_base"), add("score", "more_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(load(spark, sf_dir, "documents"), ~held_out(7, 2))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
