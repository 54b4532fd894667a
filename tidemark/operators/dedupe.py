"""Exact and fuzzy duplicates of dated records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.operators import title_cells
from tidemark.sources.folders import written

#: Thresholds of the fuzzy match.
TITLE_ALONE, VENUE, TITLE_WITH_VENUE = 0.6, 0.5, 0.35
#: Copies that one entry stands for; bytes of words in a part of a block; parts that smaller blocks have so that all tasks get some, and their bytes.
ENTRY_ROWS, PART_BYTES, EVEN_PARTS, EVEN_BYTES = 1000, 1 << 24, 8, 1 << 19


def identity_hash(title: Column, day: Column, venue: Column, **kw) -> Column:
    """SHA-1 of the normalised title, local day and normalised venue; a null venue is an empty one."""
    return F.sha1(F.concat_ws("|", tx.key_text(title, **kw), F.coalesce(day, F.lit("")), tx.key_text(venue, **kw)).cast("binary"))


def record_id(title: Column, day: Column) -> Column:
    """12 hex digits of the SHA-1 of title key and day."""
    return F.substring(F.sha1(F.concat_ws("|", tx.title_key(title), F.coalesce(day, F.lit(""))).cast("binary")), 1, 12)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. One aggregation with map-side combine instead of a sort of whole groups."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def new_rows(batch: DataFrame, history: DataFrame, key: str, order: list) -> DataFrame:
    """First of each key in the batch, without keys that history has."""
    return first_wins(batch, [key], order).join(history.select(key), key, "left_anti")


def _words(df: DataFrame, block: list[str], id_col: str, order: str, title: str, venue: str) -> DataFrame:
    """Block (__0, __1, ...), id, ord, t and v (words of title and venue, sorted) of every row that can be in a pair: null blocks and places are in none."""
    words = lambda c: F.array_join(F.array_sort(tx.word_set(F.col(c))), " ")
    rows = df.where(reduce(and_, [F.col(c).isNotNull() for c in [*block, order]]))
    rows = rows.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(block)], F.col(id_col).alias("id"), F.col(order).alias("ord"), words(title).alias("t"), words(venue).alias("v"))
    return written(rows, "words").where("t <> ''")  # written first, so that the words are worked out once


def _entries(words: DataFrame, keys: list[str]) -> DataFrame:
    """A row for the rows of one block and the same words, with their (ord, id): copies are compared once. Of many copies, one for each thousand or so."""
    same = F.xxhash64("t", "v").alias("__same")
    many = words.groupBy(*keys, same).agg(F.ceil(F.count("*") / ENTRY_ROWS).alias("__many")).where("__many > 1")
    rows = words.select("*", same).join(many, [*keys, "__same"], "left")
    salt = F.coalesce(F.pmod(F.xxhash64("id", "ord"), "__many"), F.lit(0))
    return rows.groupBy(*keys, "t", "v", salt.alias("no")).agg(F.collect_list(F.struct("ord", "id")).alias("members"))


def _firsts(words: DataFrame, keys: list[str]) -> DataFrame:
    """A row for the rows of one block and the same words, with a number and the first (ord, id)."""
    rows = words.groupBy(*keys, "t", "v").agg(F.min(F.struct("ord", "id")).alias("members"))
    return written(rows.select("*", F.monotonically_increasing_id().alias("no")), "firsts")


def _in_cells(words: list[DataFrame], entries: list[DataFrame], keys: list[str], compare: Callable, schema: T.StructType) -> DataFrame:
    """What `compare` makes of each cell. A block's entries are dealt into parts, and each two parts meet in one cell, so every pair of
    entries is judged in one place: neither candidates nor pairs are shuffled, only the entries, as often as their block has parts."""
    weight = F.sum(F.length("t") + F.length("v") + 16)
    sizes = reduce(DataFrame.unionByName, [w.select(*keys, "t", "v") for w in words]).groupBy(*keys).agg(weight.alias("__w"))
    few = F.least(F.lit(EVEN_PARTS), F.ceil(F.col("__w") / EVEN_BYTES))
    parts = sizes.select(*keys, F.greatest(F.ceil(F.col("__w") / PART_BYTES), few).cast("int").alias("__parts"))
    own = len(entries) == 1
    each, sides = F.sequence(F.lit(0), F.col("__parts") - 1), []
    for number, side in enumerate(entries):
        part = F.pmod(F.xxhash64("t", "v", "no"), "__parts").cast("int")
        if own:
            cell = lambda p: lambda x: F.struct(F.least(x, p).alias("i"), F.greatest(x, p).alias("j"), (x < p).cast("int").alias("side"))
        else:
            cell = lambda p, n=number: lambda x: F.struct((x if n else p).alias("i"), (p if n else x).alias("j"), F.lit(n).alias("side"))
        rows = side.join(parts, keys).withColumn("__part", part)
        sides.append(rows.select(*keys, "t", "v", "no", "members", F.inline(F.transform(each, cell(F.col("__part"))))))
    cells = reduce(DataFrame.unionByName, sides)
    spark = cells.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    needs = title_cells.Needs(TITLE_ALONE, VENUE, TITLE_WITH_VENUE)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(pa.Table.from_batches(batches), own, own and key[-2] == key[-1], needs)

    return cells.repartition(tasks, *keys, "i", "j").groupBy(*keys, "i", "j").applyInArrow(run, schema)


def _prefixes(side: DataFrame, block: list[str], need: float, keys: list[str]) -> DataFrame:
    """A row for each first word of a title, with keys for each first word of its venue too. Only numbers go with each: a title may have thousands."""
    cut = lambda c, part: F.slice(c, F.lit(1), F.size(c) - F.ceil(F.size(c) * part - 1e-9).cast("int") + 1)
    rows = side.where(F.size("t") > 0)
    if keys:
        rows = rows.where(F.size("v") > 0).select("*", F.explode(cut("v", VENUE)).alias("__v"))
    return rows.select(*block, *keys, "__no", F.size("t").alias("size"), F.size("v").alias("v"), F.posexplode(cut("t", need)).alias("at", "__w"))


def _compared(new: DataFrame, old: DataFrame, block: list[str], id_col: str, order: str, title: str, venue: str, entries: Callable, compare: Callable, schema: Callable) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Words and entries of the new rows, and what `compare` makes of all cells."""
    keys = [f"__{i}" for i in range(len(block))]
    words = [_words(df, block, id_col, order, title, venue) for df in ([new] if old is new else [new, old])]
    made = [entries(w, keys) for w in words]
    kinds = {f.name: f.dataType for f in words[-1].schema}
    return words[0], made[0], _in_cells(words, made, keys, compare, schema(kinds)), keys


def fuzzy_pairs(new: DataFrame, old: DataFrame, block: list[str], id_col: str, order: str, title: str = "title", venue: str = "venue", digits: int | None = None) -> DataFrame:
    """Pairs of a new and an earlier row of one block (such as the local day) that look alike, with their score: as many rows as there are pairs.

    Scores are worked out, and rounded to digits, once for a row and all copies that it is like; those become rows last."""
    member = lambda kinds: T.ArrayType(T.StructType([T.StructField("ord", kinds["ord"]), T.StructField("id", kinds["id"])]))
    schema = lambda kinds: T.StructType([T.StructField("id", kinds["id"]), T.StructField("title_score", T.DoubleType()), T.StructField("venue_score", T.DoubleType()), T.StructField("others", member(kinds))])
    _, _, out, _ = _compared(new, old, block, id_col, order, title, venue, _entries, title_cells.links, schema)
    score = F.greatest("title_score", (F.col("title_score") + F.col("venue_score")) / 2)
    reason = F.format_string("same day, title~%.2f venue~%.2f", "title_score", "venue_score")
    shown = lambda c: c if digits is None else F.round(c, digits)
    out = out.select("id", "others", *[shown(F.col(c)).alias(c) for c in ("title_score", "venue_score")], shown(score).alias("score"), reason.alias("reason"))
    return out.select("*", F.explode("others").alias("__other")).select("id", F.col("__other.id").alias("other_id"), F.col("__other.ord").alias("other_ord"), "title_score", "venue_score", "score", "reason")


def duplicate_of(new: DataFrame, old: DataFrame, block: list[str], id_col: str, order: str, title: str = "title", venue: str = "venue") -> DataFrame:
    """id, duplicate_of: the first earlier row that looks like it. Copies are never paired: the first row of each class stands for it."""
    schema = lambda kinds: T.StructType([T.StructField("no", T.LongType()), T.StructField("ord", kinds["ord"]), T.StructField("id", kinds["id"])])
    words, entries, out, keys = _compared(new, old, block, id_col, order, title, venue, _firsts, title_cells.firsts, schema)
    best = out.groupBy("no").agg(F.min(F.struct("ord", "id")).alias("__best"))
    named = entries.join(best, "no", "left")
    first = F.least("__best", "members") if old is new else F.col("__best")  # a null one is left out
    rows = words.join(named.select(*keys, "t", "v", first.alias("first")), [*keys, "t", "v"])
    return rows.where(F.col("first.ord") < F.col("ord")).select("id", F.col("first.id").alias("duplicate_of"))


def ordered_rejects(df: DataFrame, reasons: list[tuple[str, Column]], keys: list[str] | None = None, order: list | None = None, duplicate: str = "dupe") -> DataFrame:
    """All rows with the first reason that rejects them (null: kept); duplicates are judged among survivors only."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    out = df.withColumn("reject_reason", reason)
    if keys:
        alive = F.col("reject_reason").isNull()
        w = Window.partitionBy(alive, *keys).orderBy(*order)
        out = out.withColumn("__pos", F.row_number().over(w)).withColumn("reject_reason", F.when(alive & (F.col("__pos") > 1), duplicate).otherwise(F.col("reject_reason"))).drop("__pos")
    return out


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
