"""Search, document and page queries. A document's title is its first line; English documents play the home town."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import dedupe, documents, extract, listing, normalize, search
from tidemark.plans.registry import query
from tidemark.sources import load

QUERY = "tion ering the whea"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _tokens(e: str) -> str:
    """Search terms of an expression, in DuckDB."""
    cut = "CASE WHEN length(t) > 4 AND ends_with(t, 'ies') THEN substr(t, 1, length(t) - 3) || 'y' WHEN length(t) > 4 AND ends_with(t, 'ing') THEN substr(t, 1, length(t) - 3) WHEN length(t) > 3 AND ends_with(t, 'es') THEN substr(t, 1, length(t) - 2) WHEN length(t) > 3 AND ends_with(t, 's') THEN substr(t, 1, length(t) - 1) ELSE t END"
    parts = rf"string_split_regex(regexp_replace(strip_accents(lower({e})), '[''’]s\b', '', 'g'), '[^a-z0-9]+')"
    return f"list_transform(list_filter({parts}, lambda t: length(t) > 1 AND t NOT IN ({_STOP})), lambda t: {cut})"


_BASE = f"""
d AS (SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title FROM documents),
tt AS (SELECT *, {_tokens("title")} AS a, {_tokens("concat_ws(' ', nullif(source, ''), nullif(text, ''))")} AS b FROM d),
tok AS (SELECT doc_id, list_concat(list_concat(a, a), list_concat(a, b)) AS toks FROM tt),
lens AS (SELECT doc_id, len(toks) AS len FROM tok),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
st AS (SELECT count(*) AS n, sum(len) / count(*) AS al FROM lens)"""


def _scored(queries: str) -> str:
    return f"""WITH qs AS ({queries}), {_BASE},
qt AS (SELECT query_id, len(t) AS nt, unnest(t) AS term FROM (SELECT query_id, list_distinct({_tokens("query")}) AS t FROM qs)),
ex AS (SELECT query_id, nt, qt.term, v.term AS v, df FROM qt JOIN terms v ON v.term = qt.term OR (length(qt.term) >= 4 AND starts_with(v.term, qt.term)) QUALIFY row_number() OVER (PARTITION BY query_id, qt.term ORDER BY v.term) <= 25),
s1 AS (SELECT query_id, nt, p.doc_id, ex.term, sum(CASE WHEN v = ex.term THEN 1e0 ELSE 6e-1 END * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 24e-1 / (tf + 14e-1 * (4e-1 + 6e-1 * len / al))) AS s FROM ex JOIN p ON p.term = ex.v JOIN lens USING (doc_id), st GROUP BY ALL),
s2 AS (SELECT query_id, doc_id, sum(s) * CASE WHEN nt > 1 THEN 1 + count(*) / nt ELSE 1e0 END AS s, count(*) AS matched FROM s1 GROUP BY query_id, nt, doc_id),
hits AS (SELECT query_id, s2.doc_id, matched, lang, title, round(s * CASE WHEN length(trim(query)) >= 4 AND contains(lower(title), lower(trim(query))) THEN 2e0 ELSE 1e0 END * CASE WHEN lang = 'en' THEN 115e-2 ELSE 1e0 END, 6) AS score FROM s2 JOIN d USING (doc_id) JOIN qs USING (query_id))"""


def docs_of(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    title = F.get(F.split("text", "\n"), F.lit(0))
    return d.select("doc_id", "lang", "source", "text", title.alias("title"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("date"), F.col("doc_id").alias("ord"))


def index_of(docs):
    return search.kept_index(docs, search.document_tokens(F.col("title"), F.col("source"), F.col("text")), "doc_id")


def one_query(spark, text=QUERY):
    return spark.range(1).select(F.lit("q").alias("query_id"), F.lit(text).alias("query"))


@query("term_frequency", f"WITH {_BASE.strip()} SELECT doc_id, term, tf FROM p")
def term_frequency(spark, sf_dir):
    return index_of(docs_of(spark, sf_dir)).postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query("doc_frequency", f"WITH {_BASE.strip()} SELECT term, df FROM terms")
def doc_frequency(spark, sf_dir):
    return index_of(docs_of(spark, sf_dir)).terms


@query("corpus_stats", f"WITH {_BASE.strip()} SELECT n, round(al, 6) AS avg_len FROM st")
def corpus_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    lengths = docs.select(F.size(search.document_tokens(F.col("title"), F.col("source"), F.col("text"))).alias("len"))
    return search.corpus_stats(lengths).select("n", F.round("avg_len", 6).alias("avg_len"))


@query("prefix_expand", f"WITH {_BASE.strip()}, q AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM benchmark) SELECT q.term, v.term AS variant, CASE WHEN v.term = q.term THEN 1e0 ELSE 6e-1 END AS weight FROM q JOIN terms v ON v.term = q.term OR (length(q.term) >= 4 AND starts_with(v.term, q.term)) QUALIFY row_number() OVER (PARTITION BY q.term ORDER BY v.term) <= 25")
def prefix_expand(spark, sf_dir):
    q = load(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    q = q.select(F.lit("all").alias("query_id"), F.lit(1).alias("n_terms"), "term")
    return search.expanded(q, index_of(docs_of(spark, sf_dir)).terms).select("term", "variant", "weight")


@query("bm25_search", _scored(f"SELECT 'q' AS query_id, '{QUERY}' AS query") + " SELECT doc_id, score, matched FROM hits")
def bm25_search(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return search.matches(index_of(docs), docs, one_query(spark), local=F.col("lang") == "en", id_col="doc_id").select("doc_id", "score", "matched")


@query("bm25_filtered", _scored(f"SELECT 'q' AS query_id, '{QUERY}' AS query") + " SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS pos FROM hits WHERE lang = 'fr' QUALIFY pos <= 20")
def bm25_filtered(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    hits = search.best(index_of(docs), docs, one_query(spark), 20, keep=F.col("lang") == "fr", local=F.col("lang") == "en", id_col="doc_id")
    return hits.select("doc_id", "score", "pos")


_BATCH = "SELECT item_id AS query_id, text AS query FROM benchmark"


@query("batch_search", _scored(_BATCH) + " SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS pos FROM hits QUALIFY pos <= 8")
def batch_search(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.best(index_of(docs), docs, queries, 8, local=F.col("lang") == "en", id_col="doc_id")
    return hits.select("query_id", "doc_id", "score", "pos")


@query("search_facets", _scored(f"SELECT 'q' AS query_id, '{QUERY}' AS query") + " SELECT source AS day, count(*) AS n, count_if(hits.lang = 'en') AS in_town FROM hits JOIN documents USING (doc_id) GROUP BY 1")
def search_facets(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    hits = search.matches(index_of(docs), docs.withColumn("date", F.col("source")), one_query(spark), local=F.col("lang") == "en", id_col="doc_id")
    return search.facets(hits, F.col("lang") == "en").select("day", "n", "in_town")


@query("browse_rank", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1 END, strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id LIMIT 40")
def browse_rank(spark, sf_dir):
    ev = load(spark, sf_dir, "events").where("event_type = 'view'")
    rows = ev.withColumns({"date": F.date_format("ts", "yyyy-MM-dd"), "start_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")})
    return search.browsed(rows, F.col("user_id") % 4 == 0, ord_col="event_id").select("event_id")


@query("corpus_counts", "SELECT count(DISTINCT lang) AS documents, count_if(n_chars >= 500) AS event_chunks, count_if(n_chars < 500) AS page_chunks FROM documents")
def corpus_counts(spark, sf_dir):
    kind = F.when(F.col("n_chars") >= 500, "event").otherwise("page")
    return documents.corpus_counts(load(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), kind.alias("kind")))


@query("slugs", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, substr(regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'), 1, 60) AS title_key FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)")
def slugs(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", tx.slug(F.col("title")).alias("slug"), tx.title_key(F.col("title")).alias("title_key"))


@query(
    "summaries",
    r"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents), h AS (SELECT *, substr(c, 1, 400) AS h FROM c) SELECT doc_id, CASE WHEN length(c) <= 400 THEN c ELSE substr(h, 1, greatest(CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') ELSE -1 END, 360)::INTEGER) || '…' END AS summary FROM h",
)
def summaries(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.summary(F.col("text")).alias("summary"))


# accents go first: engines differ in whether an accented letter ends a word
_PLAIN = "replace(strip_accents(lower(text)), 'ß', 'ss')"
_CASES = " ".join(f"WHEN regexp_matches({_PLAIN}, '{p}') THEN '{c}'" for c, p in normalize.CATEGORY_RULES)


@query("categories", f"SELECT doc_id, CASE {_CASES} ELSE 'other' END AS category, regexp_matches(text, '(?i)free|no charge|complimentary') AS free, regexp_matches(text, '(?i)kid|child|family|all ages|toddler|storytime') AS family FROM documents")
def categories(spark, sf_dir):
    text, plain = F.col("text"), F.replace(tx.strip_accents(F.lower("text")), F.lit("ß"), F.lit("ss"))
    return load(spark, sf_dir, "documents").select("doc_id", tx.classify(plain, normalize.CATEGORY_RULES).alias("category"), text.rlike(tx.FREE_ANYWHERE).alias("free"), text.rlike(tx.FAMILY).alias("family"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '(?m)^\s*[-*_]{{3,}}\s*$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("clean_markdown", f"SELECT page_id, {_CLEAN.format('html')} AS words FROM pages")
def clean_markdown(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", documents.clean_markdown(F.col("html")).alias("words"))


@query(
    "page_slices",
    rf"WITH c AS (SELECT doc_id, lang, {_CLEAN.format('text')} AS c FROM documents), k AS (SELECT *, greatest(ceil((length(c) - 2100) / 1400), 0)::INTEGER AS k FROM c), s AS (SELECT doc_id, k, unnest(range(0, k + 1)) AS i, c FROM k), t AS (SELECT doc_id, k, i, CASE WHEN i < k THEN substr(c, i * 1400 + 1, 1400) ELSE substr(c, k * 1400 + 1) END AS text FROM s), f AS (SELECT doc_id, k, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t WHERE text <> '' AND length(regexp_replace(text, '\W', '', 'g')) > 40) SELECT doc_id || '#' || n AS id, CASE WHEN k > 0 THEN 'd' || doc_id || ' (part ' || n || ')' ELSE 'd' || doc_id END AS title, length(text) AS n_chars, md5(text) AS digest FROM f",
)
def page_slices(spark, sf_dir):
    chunks = documents.page_chunks(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return chunks.select("id", "title", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("mined_dates", "SELECT event_id, array_to_string(list_sort(list_distinct([strftime(ts, '%Y-%m-%d'), CASE WHEN day(ts) < 10 THEN '2025' ELSE '2024' END || '-01-' || strftime(ts, '%d'), '2024-03-07'])), ',') AS dates FROM events")
def mined_dates(spark, sf_dir):
    said = F.concat(F.lit("Held "), F.date_format("ts", "yyyy-MM-dd"), F.lit(", or Jan. "), F.dayofmonth("ts").cast("string"), F.lit("th, and 3/7/2024; not Febr 40"))
    return load(spark, sf_dir, "events").select("event_id", F.array_join(documents.dates_in(said, F.lit("2024-01-10").cast("date")), ",").alias("dates"))


def _entities(e: str) -> str:
    for a, b in tx.ENTITIES:
        e = f"replace({e}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return e


def _cleaned(e: str) -> str:
    return f"nullif(trim(regexp_replace({_entities(f'regexp_replace({e}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '[\\s ]+', ' ', 'g')), '')"


_WITHOUT = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"


@query("html_title_text", f"SELECT page_id, {_cleaned(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')} AS title, {_cleaned(_WITHOUT)} AS words FROM pages")
def html_title_text(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", extract.page_title(html).alias("title"), extract.page_text(html).alias("words"))


@query("html_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=["'']([^"'']+)["'']', 1)))::INTEGER AS n_links FROM pages""")
def html_links(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.size(extract.page_links(F.col("html"))).alias("n_links"))


@query("heuristic_extract")
def heuristic_extract(spark, sf_dir):
    """Records of the extraction cascade, with articles as entries; tests hold it against planted pages."""
    adapters = spark.range(1).select(F.lit("all").alias("source"), F.lit("community").alias("default_category"), F.lit(None).cast("string").alias("forced_category"), F.lit(None).cast("boolean").alias("family"), F.lit("article").alias("tag"))
    pages = load(spark, sf_dir, "pages").withColumn("source", F.lit("all"))
    return extract.extracted(pages, adapters).select("page_id", "strategy", "pos", "title", "date", "source_url", "category")


_KEYWORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(lower({}), '([MARKED])', '\\1 ', 'g')), '[^a-z0-9\\s]', ' ', 'g'), '\\b(the|a|an|at|in|on|of|and|with|to|for)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))".replace("MARKED", tx.MARKED)
_PAIRS = f"""WITH d AS (SELECT doc_id, lang, {_KEYWORDS.format("split_part(text, chr(10), 1)")} AS t, {_KEYWORDS.format("source")} AS v FROM documents),
s AS (SELECT a.doc_id AS id, b.doc_id AS other_id, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS t, CASE WHEN len(a.v) = 0 OR len(b.v) = 0 THEN 0 ELSE len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) END AS v
      FROM d a JOIN d b ON a.lang = b.lang AND b.doc_id < a.doc_id),
p AS (SELECT id, other_id, round(t, 6) AS title_score, round(greatest(t, (t + v) / 2), 6) AS score FROM s WHERE t >= 6e-1 OR (v >= 5e-1 AND t >= 35e-2))"""


def _titled(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", "lang", "title", F.col("source").alias("venue"), "ord")


@query("fuzzy_duplicates", f"{_PAIRS} SELECT * FROM p")
def fuzzy_duplicates(spark, sf_dir):
    d = _titled(spark, sf_dir)
    return dedupe.fuzzy_pairs(d, d, ["lang"], "doc_id", "ord", digits=6).select("id", "other_id", "title_score", "score")


@query("duplicate_of", f"{_PAIRS} SELECT id, min(other_id) AS duplicate_of FROM p GROUP BY 1")
def duplicate_of(spark, sf_dir):
    d = _titled(spark, sf_dir)
    return dedupe.duplicate_of(d, d, ["lang"], "doc_id", "ord")


@query("unique_titles", "SELECT doc_id, sha1(substr(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '', 'g'), 1, 60) || '|' || lang) AS id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '', 'g'), 1, 60), lang ORDER BY doc_id) = 1")
def unique_titles(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", "lang", tx.title_key(F.col("title")).alias("key"))
    return dedupe.first_wins(rows, ["key", "lang"], ["doc_id"]).select("doc_id", F.sha1(F.concat_ws("|", "key", "lang").cast("binary")).alias("id"))


@query("title_rail", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS pos, greatest(count(*) OVER (PARTITION BY source) - 3, 0) AS more FROM documents QUALIFY pos <= 3")
def title_rail(spark, sf_dir):
    return listing.top_per_group(load(spark, sf_dir, "documents"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("doc_id", "source", "pos", "more")
