r"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

`RULES` lists (name, metric, lowest, highest); a text is kept if every metric is in its range. The metrics
are length, symbol, stop-word and line ratios, made from the text by built-in functions only, so a row is
judged where it is read: no shuffle, no Python.

Defined results: a null or empty text has no words, so all counts are 0, base_failed is true and kept is
false. Repeated rows are judged alike; ids may be null; other columns are ignored. Windows of three words
are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, text_or_empty

#: White space that separates words, and the symbols that the contract counts.
BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from at or an a "
    "der die und das den von mit ist für nicht ein eine auf des im dem sich als "
    "de la le les et un une que qui dans pour pas sur au aux avec ce du en par "
    "el los las del se por con una su lo no al como"
).split()
#: (name, metric, lowest, highest).
RULES = (
    ("enough words", "n_words", 50, None),
    ("not too many words", "n_words", None, 1_000_000),
    ("word length", "mean_word_chars", 2.0, 14.0),
    ("symbols to words", "symbol_ratio", None, 0.1),
    ("marks to words", "mark_ratio", None, 0.25),
    ("stop words", "stop_ratio", 0.02, None),
    ("repeated lines", "dup_line_ratio", None, 0.4),
    ("repeated windows", "repeat_ratio", None, 0.5),
)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts and the ratios of every row. Each array is made once, in a projection of its own."""
    text = F.col("__t")
    a = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__t"))
    a = a.withColumn("__w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    a = a.withColumn("__n", F.size("__w"))
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    a = a.withColumn("__h", F.when(F.col("__n") >= 3, F.transform(F.sequence(F.lit(0), F.col("__n") - 3), window)).otherwise(F.array().cast("array<long>")))
    a = a.withColumn("__k", F.size(F.array_distinct("__h")))
    # only where a window repeats: windows by hash and place, then the places of those with an equal neighbour
    by_hash = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("__s", F.when(F.col("__k") < F.size("__h"), by_hash))
    same = lambda x, i: (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"])
    places = F.array_sort(F.transform(F.filter("__s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    a = a.withColumn("__p", places)
    step = lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - F.get("__p", i), F.lit(3)))
    repeat = F.aggregate(F.transform("__p", step), F.lit(0), lambda x, y: x + y)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    a = a.withColumn("__l", lines)
    length, mark = F.length(text), lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    stop = F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS)))
    counts = a.select(
        "doc_id",
        F.col("__n").cast("long").alias("n_words"),
        (length - mark(BLANK)).cast("long").alias("word_chars"),
        mark(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").alias("n_lines"),
        mark("!").alias("n_marks"),
        stop.alias("n_stop"),
    )
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return counts.select(
        "*",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_marks", "n_words").alias("mark_ratio"),
        per("n_stop", "n_words").alias("stop_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """One boolean column: all rules hold."""
    keep = F.lit(True)
    for _, metric, low, high in rules:
        if low is not None:
            keep = keep & (F.col(metric) >= low)
        if high is not None:
            keep = keep & (F.col(metric) <= high)
    return keep


def judged(docs: DataFrame, rules=RULES, **kw) -> DataFrame:
    """The metrics and `passes` of every row."""
    return metrics(docs, **kw).withColumn("passes", compiled(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = judged(load(spark, sf_dir, "documents")).withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("passes")).alias("kept"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        length(text) - length(replace(text, '!', '')) AS n_marks, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
      FROM a LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.25
  AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""
