r"""Personal data: base patterns, and terms of the context that disclose what they find. Built-in functions only.

Base spans (email, ip, card, phone) are found in the text by regular expressions; their places follow from the
lengths of the matches and of what is between them. A match that fails its check is dropped, not retried.

The method then asks which terms give a protected entity (a kind and value) away. Over the N different texts of the
corpus, n(e) with the entity, n(t) with the term, n(t, e) with both, anywhere in the text but not touching a base span:

    disclosure(t, e) = ln(N n(t, e) / (n(t) n(e))) / ln(N / n(e))

the pointwise mutual information as a share of the entity's information content, 1 for a term that is only
met together with the entity. Pairs met in fewer than `SUPPORT` texts say nothing, as any rare word would count. In a text
that holds the entity, terms from `GENERALISE` on are replaced by [TERM] wherever they stand, from `REMOVE` on they are
removed. A term of the disclosure d has n(t) <= n(e) (N / n(e))^(1 - d), so frequent words never meet the entities.

Defined results: a null text counts as empty and stays null when sanitised; spans of different kinds may
overlap, and sanitising then takes the first, the longer of two that start together; equal texts count as one,
whatever their ids, and get equal spans; null ids are kept; an empty table gives an empty result;
other columns are kept by `sanitised`, whatever their names, and ignored by `spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, joined, load, small, spare, text_or_empty, written

#: The kinds, in the order that breaks ties, and the patterns of the base spans. A run is
#: entered at its start, or where the last match ended, so long runs are read once.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: What a text must hold for a kind to be looked for.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
_SPAN = "struct<start:int,k:int,end:int,value:string>"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def in_blocks(items: Column) -> Column:
    """The items in blocks of about the square root of their number, so that work within a block and over blocks stays small."""

    def dealt(x):
        k = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / k).cast("int")), lambda b: F.slice(x, b * k + 1, k))).otherwise(F.array(x))

    return let(items, dealt)


def running(numbers: Column) -> Column:
    """Running sums of an array of int."""
    none = F.array().cast("array<int>")
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))
    sums = lambda a: F.aggregate(a, none, add)
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))

    def raised(blocks):
        before = F.concat(F.array(F.lit(0)), sums(F.transform(blocks, last)))
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda a, i: F.transform(a, lambda x: x + F.get(at, i)))))

    return let(F.transform(in_blocks(numbers), sums), raised)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the matches of a pattern, in order."""
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(p):
        widths = F.zip_with(F.slice(p["between"], 1, F.size(p["found"])), p["found"], lambda b, m: F.length(b) + F.length(m))
        span = lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("k"), e.alias("end"), m.alias("value"))
        return F.zip_with(running(widths), p["found"], span)

    return let(parts, placed)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    checks = {
        "email": None,
        "ip": lambda x: x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda x: F.length(digits(x["value"])).between(14, 19) & F.call_function("luhn_check", digits(x["value"])),
        "phone": lambda x: F.length(digits(x["value"])).between(10, 15),
    }
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False)):
        found = matches(text, pattern, k)
        found = F.filter(found, checks[kind]) if checks[kind] else found
        gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
        parts.append(F.when(gate, found).otherwise(none))
    return F.array_sort(F.concat(*parts))


#: Stands for the letters of base spans while terms are looked for.
_MASK = "\ue000"


def masked(text: Column, base: Column) -> Column:
    """The text with every letter of a base span masked; no place moves."""
    own = F.transform(base, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), F.repeat(F.lit(_MASK), x["end"] - x["start"]).alias("to")))
    return let(outer(F.array_sort(own)), lambda kept: replaced(text, kept))


def words_outside(text: Column) -> Column:
    """start, end, term of the terms of a masked text that touch no base span."""
    runs = F.filter(matches(text, TERM.replace(r"\p{L}", rf"[\p{{L}}{_MASK}]"), 4), lambda w: ~F.contains(w["value"], F.lit(_MASK)))
    return F.transform(runs, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("term")))


def found_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), base, words (the terms of texts that hold an entity) of every row, cut from the texts."""
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    words = F.when(F.size("base") > 0, let(masked(F.col("text"), F.col("base")), words_outside))
    return written(rows.select("doc_id", F.xxhash64("text").alias("th"), "base", words.alias("words")), "found")


def _entities(texts: DataFrame) -> DataFrame:
    """th, kind, entity of the entities of each different text."""
    return texts.select("th", F.explode("base").alias("b")).select("th", F.col("b.k").alias("kind"), F.lower("b.value").alias("entity")).distinct()


def disclosing(df: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """kind, entity, term, disclosure of the pairs from the threshold on."""
    n = float(max(found.select("th").distinct().count(), 2))
    own = _entities(found.where("size(base) > 0"))
    often = own.groupBy("kind", "entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    # the most texts that a term may be in to disclose the entity
    often = often.withColumn("most", F.col("n_e") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - least)) * (1 + 1e-6))
    own = written(own.join(small(written(often, "often")), ["kind", "entity"]), "entities")
    texts = own.groupBy("th").agg(F.max("most").alias("most"))
    terms = found.where("size(base) > 0").join(small(texts), "th").select("th", "most", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    terms = written(terms.distinct(), "terms")
    wanted = terms.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most")).where(F.col("n") >= support)
    wanted = small(written(wanted.select("term", "most"), "wanted"))
    # each of equal texts counts as a part of one
    copies = found.groupBy("th").count().where("count > 1").select(F.col("th").alias("copy"), F.col("count").alias("copies"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(TERM), F.lit(0)))
    rows = df.select(F.xxhash64(text_or_empty(text_col)).alias("th"), words.alias("words"))
    rows = rows.join(small(written(copies, "copies")), F.col("th") == F.col("copy"), "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode("words").alias("term"))
    n_t = rows.join(wanted, "term").groupBy("term", "most").agg(F.round(F.sum(F.lit(1.0) / F.col("copies"))).alias("n_t")).where(F.col("n_t") <= F.col("most"))
    rare = terms.select("th", "term").join(small(written(n_t.select("term", "n_t"), "rare")), "term")
    pairs = own.select("th", "kind", "entity", "n_e", "most").join(rare, "th").where(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("kind", "entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    pmi = F.log(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    info = F.log(F.lit(n) / F.col("n_e"))
    share = F.when(info > 0, F.least(F.lit(1.0), pmi / info)).otherwise(0.0)
    return pairs.select("kind", "entity", "term", F.round(share, 9).alias("disclosure")).where(F.col("disclosure") >= least)


def term_spans(df: DataFrame, found: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """th, terms (spans, with their highest disclosure) of the different texts that have any."""
    bad = written(disclosing(df, found, text_col, **kw), "disclosing")
    texts = found.where("size(base) > 0")
    own = _entities(texts).join(bad, ["kind", "entity"]).groupBy("th", "term").agg(F.max("disclosure").alias("d"))
    words = texts.select("th", F.explode("words").alias("w")).select("th", "w.*").distinct()
    span = F.struct("start", F.lit(4).alias("k"), "end", "d")
    return words.join(own, ["th", "term"]).groupBy("th").agg(F.array_sort(F.collect_list(span)).alias("terms"))


_TERMS = "array<struct<start:int,k:int,end:int,d:double>>"


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, base and terms (arrays of spans) of every row."""
    found = found_rows(df, id_col, text_col)
    rows = joined(found.select("doc_id", "th", "base"), term_spans(df, found, text_col, **kw), "th", hot_keys(found, "th"), "left")
    return rows.select("doc_id", "base", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **kw) -> DataFrame:
    """The rows with their texts sanitised; all columns kept."""
    found = found_rows(df, id_col, text_col)
    th, own = spare(df, "th"), spare(df, "terms")
    terms = term_spans(df, found, text_col, **kw).toDF(th, own)
    text = F.col(text_col)
    rows = joined(df.withColumn(th, F.xxhash64(text_or_empty(text_col))), terms, th, hot_keys(found.select(F.col("th").alias(th)), th), "left")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform(base_spans(text_or_empty(text_col)), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), F.get(label, x["k"]).alias("to")))
    more = F.transform(F.col(own), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("e"), F.when(x["d"] >= remove, F.lit("")).otherwise(F.get(label, x["k"])).alias("to")))
    none = F.array().cast("array<struct<start:int,e:int,to:string>>")
    rows = rows.withColumn(own, F.array_sort(F.concat(base, F.coalesce(more, none))))
    done = let(outer(F.col(own)), lambda kept: replaced(text, kept))
    return rows.withColumn(text_col, F.when(F.size(own) > 0, done).otherwise(text)).select(*df.columns)


def outer(spans_: Column) -> Column:
    """start, end, to, prev (end of the span before) of the spans that don't begin in an earlier one; sorted by start, the longest first."""
    kind = "array<struct<start:int,end:int,to:string,prev:int>>"

    def add(acc, x):
        row = F.struct(x["start"].alias("start"), (-x["e"]).alias("end"), x["to"].alias("to"), acc["at"].alias("prev"))
        # rows of a block first, so that long lists are not copied for every span
        full = F.size(acc["block"]) >= 64
        more = F.struct((-x["e"]).alias("at"), F.when(full, F.array(row)).otherwise(F.concat(acc["block"], F.array(row))).alias("block"), F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"))
        return F.when(x["start"] >= acc["at"], more).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("blocks"))
    return F.aggregate(spans_, zero, add, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))))


def replaced(text: Column, kept: Column) -> Column:
    """The text with spans replaced; a block of spans is cut from the text first, then the pieces from that."""
    last = lambda block: F.get(block, F.size(block) - 1)

    def pieces(block):
        base = F.get(block, 0)["prev"]
        part = F.substring(text, base + 1, last(block)["start"] - base)
        own = lambda p: F.array_join(F.transform(block, lambda x: F.concat(F.substring(p, x["prev"] - base + 1, x["start"] - x["prev"]), x["to"])), "")
        return let(part, own)

    return F.concat(F.array_join(F.transform(in_blocks(kept), pieces), ""), F.substring(text, last(kept)["end"] + 1, F.length(text)))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(load(spark, sf_dir, "documents"))
    place = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform("base", place), F.transform("terms", place)))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(both).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def _oracle() -> str:
    """query() as DuckDB SQL, with the patterns as they stand in their plain form."""
    plain = {
        0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        1: r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        2: r"[0-9](?:[\x20-]?[0-9])+",
        3: r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def placed(source: str, keep: str, pattern: str, kind: int, offset: str) -> str:
        found = f"SELECT {keep}, {offset} AS o, regexp_extract_all(t, '{pattern}') AS m, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS b FROM {source}"
        each = f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found}) WHERE len(m) > 0"
        return f"SELECT {keep}, {kind} AS k, (o + list_sum(b[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, m[i] AS v FROM ({each})"

    base = " UNION ALL ".join(placed("rows_", "rid", p, k, "0") for k, p in plain.items())
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (substr(reverse({digits}), i, 1)::INTEGER * (1 + (i - 1) % 2)) // 10 + (substr(reverse({digits}), i, 1)::INTEGER * (1 + (i - 1) % 2)) % 10)) % 10 = 0"
    return rf"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cand AS ({base}),
base AS (SELECT rid, k, s, s + length(v) AS e, v FROM cand WHERE CASE k WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
  WHEN 2 THEN length({digits}) BETWEEN 14 AND 19 AND {luhn} ELSE length({digits}) BETWEEN 10 AND 15 END),
texts AS (SELECT t, min(rid) AS rid FROM rows_ GROUP BY t),
ents AS (SELECT DISTINCT rid, k AS kind, lower(v) AS entity FROM base),
own AS (SELECT kind, entity, rid FROM ents JOIN texts USING (rid)),
n_e AS (SELECT kind, entity, count(*) AS n_e FROM own GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{TERM}'))) AS term FROM texts) GROUP BY 1),
near AS (SELECT rid, s, s + length(v) AS e, lower(v) AS term FROM ({placed("(SELECT rid, t FROM rows_ WHERE rid IN (SELECT rid FROM base))", "rid", TERM, 4, "0")}) AS w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s <= w.s + length(w.v) AND w.s <= b.e)),
n_te AS (SELECT kind, entity, term, count(*) AS n_te FROM own JOIN n_e USING (kind, entity) JOIN (SELECT DISTINCT rid, term FROM near) USING (rid) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT greatest(count(*), 2)::DOUBLE AS n FROM texts),
bad AS (SELECT kind, entity, term FROM n_te JOIN n_e USING (kind, entity) JOIN n_t USING (term), n
  WHERE n > n_e AND round(least(1e0, ln(n * n_te / (n_t * n_e)) / ln(n / n_e)), 9) >= {GENERALISE}),
in_text AS (SELECT DISTINCT rid, term FROM ents JOIN bad USING (kind, entity)),
terms AS (SELECT DISTINCT rid, s, 4 AS k, e FROM near JOIN in_text USING (rid, term)),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(KINDS))}) AS x(k, name)),
every AS (SELECT rid, s, k, e FROM base UNION ALL SELECT rid, s, k, e FROM terms),
lists AS (SELECT rid, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans, string_agg(CASE WHEN k < 4 THEN name || ':' || s || ':' || e END, ',' ORDER BY s, k, e) AS own,
  {", ".join(f"count_if(k = {i}) AS c{i}" for i in range(5))} FROM every JOIN names USING (k) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(c{i}, 0)::BIGINT AS n_{KINDS[i]}" for i in range(5))}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows_ LEFT JOIN lists USING (rid)
"""


ORACLE = _oracle()
