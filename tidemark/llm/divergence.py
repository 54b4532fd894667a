"""Source divergence audit: how far the word use of each source of a language is from the others' and the language's.

1. Duplicate-text collapse. Texts meet by (lang, SHA-256), after a first collapse in each task; each different text is
   split into terms once, and its counts are added once per source, times its copies there.
2. Counts per (lang, source, term) are summed; terms in at least LEAST documents of a language are kept.
3. Sparse pair evaluation. With z a source's share of an absent term, the distance of sources g and h is
   V|zg-zh| + sum over g's terms of (|pg-zh|-|zg-zh|) + the same of h + sum over common terms of
   (|pg-ph| - |pg-zh| - |zg-ph| + |zg-zh|), so that only terms that occur are visited. Terms go to tasks by hash; a
   task holds a block of at most TILE x TILE pairs of sources, whatever their number, and gives one partial sum a pair.

All arithmetic is in whole numbers. The result has a row for each ordered pair of sources of a language: that is its
size, and nothing of that size is held in one task.

Defined results: null text, lang or source count as empty; a source without terms and a language without kept terms
have rows of pairs (0 without kept terms); repeated rows count as often as they stand; ties rank by the item's bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, chunks, load, partitions, scratch, small, text_or_empty, written

LEAST, TOP, ONE, MORE = 30, 50, 1_000_000_000, 5
#: Sources in a side of a block of pairs.
TILE = 512
#: Digests that a task remembers, and entries of its table of counts.
REMEMBERED, ENTRIES = 100_000, 300_000
#: Bytes of a text that are split at once, and entries whose pairs are formed at once.
SLICE, BLOCK = 1 << 20, 1 << 16
#: A term's bytes are kept, A-Z in lower case; other bytes separate.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Counter:
    """Term -> occurrences in a text."""
    if len(text) <= SLICE:
        return Counter(text.translate(_LOWER).split())
    out: Counter = Counter()
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        to = text.find(b" ", at + SLICE)
        to = len(text) if to < 0 else to
        out.update(text[at:to].split())
        at = to
    return out


def _collapsed(df: DataFrame) -> DataFrame:
    """lang, digest, source, n, size, z: copies in a task are one row a source; the text, compressed, is null but for the first."""
    rows = df.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    names = ["lang", "digest", "source", "n", "size", "z"]

    def run(batches):
        seen: set = set()
        more: Counter = Counter()

        def copies():
            keys = list(more)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))), pa.array(list(more.values()), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary())], names=names)
            seen.clear()
            more.clear()

        for b in chunks(batches):
            lang, source, digest = (b.column(n).to_pylist() for n in ("lang", "source", "digest"))
            new = []
            for i, key in enumerate(zip(lang, digest)):
                if key in seen:
                    more[(*key, source[i])] += 1
                else:
                    seen.add(key)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            texts = b.column("text").to_pylist()
            z = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("digest"), b.column("source"), pa.array(np.ones(len(new), np.int64)), pa.array(map(len, texts), pa.int64()), z], names=names)
            if len(seen) + len(more) > REMEMBERED:
                yield from copies()
        yield from copies()

    return rows.mapInArrow(run, "lang string, digest binary, source string, n long, size long, z binary")


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, df, count over all rows; and a row with a null term for each lang and source."""
    rows = _collapsed(df).repartition("lang", "digest").withColumn("copy", F.col("z").isNull()).sortWithinPartitions("lang", "digest", "copy")

    def run(batches):
        tables: dict[tuple[str, str], dict] = {}
        size = 0

        def given():
            nonlocal size
            for (lang, source), table in tables.items():
                n = len(table) + 1
                both = list(table.values())
                cols = [pa.array([None, *table], pa.binary()), pa.array([0, *(x >> 64 for x in both)], pa.int64()), pa.array([0, *(x & (1 << 64) - 1 for x in both)], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), *cols], names=["lang", "source", "term", "df", "count"])
            tables.clear()
            size = 0

        def add(lang, found, copies):
            nonlocal size
            for source, n in copies.items():
                table = tables.setdefault((lang, source), {})
                size -= len(table)
                get = table.get
                for term, k in found.items():
                    table[term] = get(term, 0) + (n << 64) + n * k  # documents above, occurrences below
                size += len(table) + 1
            copies.clear()

        last, found, copies = None, Counter(), Counter()
        for b in batches:
            texts = b.column("z")
            for i, (lang, digest, source, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "digest", "source", "n")))):
                if (lang, digest) != last:
                    if last:
                        add(last[0], found, copies)
                        if size > ENTRIES:
                            yield from given()
                    last, found = (lang, digest), terms(pa.decompress(texts[i].as_py(), b.column("size")[i].as_py(), codec="zstd", asbytes=True))
                copies[source] += n
                if len(copies) > 1_000:
                    add(lang, found, copies)
                    if size > ENTRIES:
                        yield from given()
        if last:
            add(last[0], found, copies)
        yield from given()

    out = rows.mapInArrow(run, "lang string, source string, term binary, df long, count long")
    return out.groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("count").alias("count")).withColumn("term", F.col("term").cast("string"))


def share(count: Column | int, total: str, kept: str) -> Column:
    """1 + floor(ONE (count + MORE) / (total + MORE kept)) in whole numbers; null without kept terms."""
    big = lambda c: c.cast("decimal(20,0)")
    count = F.lit(count) if isinstance(count, int) else count
    above, below = F.lit(ONE).cast("decimal(10,0)") * (big(count) + F.lit(MORE)), big(F.col(total)) + big(F.col(kept) * MORE)
    return F.when(F.col(kept) > 0, F.lit(1).cast("long") + F.call_function("div", above, below))


class Pairs:
    """Sums over terms for all pairs of a block of sources; the sources' numbers are those of one or two tiles."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        n = TILE if a == b else 2 * TILE
        self.z, self.there = np.zeros(n, np.int64), np.zeros(n, bool)
        self.one, self.both = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        self.term, self.s, self.p = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def local(self, source: np.ndarray) -> np.ndarray:
        return source % TILE + np.where(source // TILE == self.a, 0, TILE)

    def heads(self, source: np.ndarray, z: np.ndarray) -> None:
        at = self.local(source)
        self.z[at], self.there[at] = z, True

    def entries(self, term: pa.Array, source: np.ndarray, p: np.ndarray) -> None:
        """The next entries, by term and source; the last term's wait for more."""
        self.term, self.s, self.p = pa.concat_arrays([self.term, term]), np.concatenate([self.s, self.local(source)]), np.concatenate([self.p, p])
        if len(self.s) > BLOCK:
            new = np.flatnonzero(pc.not_equal(self.term[1:], self.term[:-1]).to_numpy(zero_copy_only=False))
            if len(new):
                self._sum(int(new[-1]) + 1)

    def _sum(self, n: int) -> None:
        term, s, p, z = self.term[:n], self.s[:n], self.p[:n], self.z
        self.term, self.s, self.p = self.term[n:], self.s[n:], self.p[n:]
        if not n:
            return
        code = np.concatenate([[0], np.cumsum(pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))])
        by = np.lexsort((p, s))
        ends = np.flatnonzero(np.diff(s[by], append=-1)) + 1
        for first, end in zip([0, *ends[:-1]], ends):
            g, own = s[by[first]], p[by[first:end]]
            total = np.concatenate([[0], np.cumsum(own)])
            k = np.searchsorted(own, z)
            self.one[g] += total[-1] - 2 * total[k] + z * (2 * k - len(own)) - len(own) * np.abs(z[g] - z)
        for o in range(1, n):
            same = np.flatnonzero(code[o:] == code[:-o])
            if not len(same):
                break
            i, j = s[same], s[same + o]
            pi, pj, zi, zj = p[same], p[same + o], z[i], z[j]
            np.add.at(self.both, (i, j), np.abs(pi - pj) - np.abs(pi - zj) - np.abs(zi - pj) + np.abs(zi - zj))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both numbers of each pair, the smaller first, and its sum."""
        self._sum(len(self.s))
        total = self.one + self.one.T + self.both + self.both.T
        if self.a == self.b:
            i, j = np.nonzero(np.triu(np.outer(self.there, self.there), 1))
            return i + self.a * TILE, j + self.a * TILE, total[i, j]
        i, j = np.nonzero(np.outer(self.there[:TILE], self.there[TILE:]))
        return i + self.a * TILE, j + self.b * TILE, total[i, j + TILE]


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block, bucket, term (null: a source's z in p) and source -> lang, i, j, part."""
    pairs, key = None, None

    def given():
        i, j, v = pairs.sums()
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.string()), len(i)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.int64())], names=["lang", "i", "j", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, a, b = batch.column("lang"), batch.column("a").to_numpy(), batch.column("b").to_numpy()
        source, p = batch.column("idx").to_numpy(), batch.column("p").to_numpy()
        new = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
        for first, end in zip(cuts[:-1], cuts[1:]):
            now = (lang[int(first)].as_py(), int(a[first]), int(b[first]))
            if now != key:
                if pairs:
                    yield from given()
                pairs, key = Pairs(*now[1:]), now
            term = batch.column("term").slice(first, end - first)
            head = pc.is_null(term).to_numpy(zero_copy_only=False)
            pairs.heads(source[first:end][head], p[first:end][head])
            pairs.entries(pc.drop_null(term), source[first:end][~head], p[first:end][~head])
    if pairs:
        yield from given()


def divergence(df: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of documents with lang, source and text."""
    spark = df.sparkSession
    with scratch(spark):
        counts = written(term_counts(df.select("lang", "source", "text")), "counts")
        of_term = Window.partitionBy("lang", "term")
        kept = counts.where("term IS NOT NULL").select("*", F.sum("df").over(of_term).alias("docs"), F.sum("count").over(of_term).alias("all"))
        kept = written(kept.where(F.col("docs") >= least).select("lang", "source", "term", "count", "all"), "kept")
        langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
        sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(small(langs), "lang", "left").na.fill(0, ["n", "v", "lang_n"])
        groups = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        groups = checkpointed(groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang"))).withColumn("z", F.coalesce(share(0, "n", "v"), F.lit(0))))

        rows = kept.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("count"), "n", "v"))
        out = checkpointed(_term_part(rows, top).unionByName(_pair_part(rows, groups)))
    return out


def _ranked(df: DataFrame, top: int | None = None) -> DataFrame:
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return (df if top is None else df.where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _term_part(rows: DataFrame, top: int) -> DataFrame:
    value = F.col("p") - share(F.col("all"), "lang_n", "v")
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0"), top)


def _pair_part(rows: DataFrame, groups: DataFrame) -> DataFrame:
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    own, buckets = F.floor(F.col("idx") / TILE).cast("int"), F.greatest(F.lit(1), F.floor(4 * partitions(rows.sparkSession) / (tiles * (tiles + 1) / 2)).cast("int"))
    block = lambda df: df.withColumn("to", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumns({"a": F.least(own, "to"), "b": F.greatest(own, "to")})
    columns = ("lang", "a", "b", "bucket", "term", "idx", "p")
    entries = block(rows).withColumn("bucket", F.pmod(F.hash("term"), buckets)).select(*columns)
    heads = block(groups).withColumns({"bucket": F.explode(F.sequence(F.lit(0), buckets - 1)), "term": F.lit(None).cast("string"), "p": F.col("z")}).select(*columns)
    dealt = entries.unionByName(heads).repartition("lang", "a", "b", "bucket").sortWithinPartitions("lang", "a", "b", "bucket", "term", "idx")
    sums = dealt.mapInArrow(_pair_sums, "lang string, i int, j int, part long").groupBy("lang", "i", "j").agg(F.sum("part").alias("part"))
    side = lambda i: small(groups.select("lang", F.col("idx").alias(i), F.col("source").alias(f"source_{i}"), F.col("z").alias(f"z_{i}"), *([F.col("v")] if i == "i" else [])))
    pairs = sums.join(side("i"), ["lang", "i"]).join(side("j"), ["lang", "j"])
    value = F.col("part") + F.col("v") * F.abs(F.col("z_i") - F.col("z_j"))
    both = F.explode(F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item"))))
    return _ranked(pairs.select("lang", value.alias("value"), both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(df) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS total_n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT lang, source, sum(n) AS group_n FROM cells GROUP BY ALL),
shares AS (SELECT c.lang, c.source, c.term, c.n, 1 + ({ONE}::HUGEINT * (c.n + {MORE})) // (s.group_n + {MORE} * l.v) AS p,
    1 + ({ONE}::HUGEINT * (c.total + {MORE})) // (l.total_n + {MORE} * l.v) AS q
    FROM cells c JOIN sizes s ON s.lang = c.lang AND s.source = c.source JOIN langs l ON l.lang = c.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
