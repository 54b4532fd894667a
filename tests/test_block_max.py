import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import block_max, search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    common, rare = [f"word{c}" for c in "abcdefgh"], [f"rare{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = []
    for i in range(600):
        words = rng.choices(common, k=rng.randint(3, 30)) + rng.choices(rare, k=rng.choice([0, 0, 1]))
        rows.append((i, " ".join(words[:2]), " ".join(words), rng.choice(["a", "b"]), i))
    docs = spark.createDataFrame(rows, "id long, title string, text string, town string, ord long").withColumns({"venue": F.lit(None).cast("string"), "date": F.lit(None).cast("string")})
    docs = docs.checkpoint()
    index = search.build_index(docs, search.document_tokens(F.col("title"), F.col("text")))
    index = search.Index(index.postings.checkpoint(), index.lengths.checkpoint(), index.terms.checkpoint(), index.n, index.avg_len)
    return docs, index


def rows_of(df):
    return sorted((r.query_id, r.pos, r.id, r.score) for r in df.select("query_id", "pos", "id", "score").collect())


QUERIES = [("one", "rareai"), ("two", "wordc rarebj"), ("all", "worda wordb wordc"), ("start", "rare"), ("none", "nothing here"), ("stop", "the of"), ("phrase", "worda wordb")]


@pytest.mark.parametrize("limit", [1, 5, 700])
@pytest.mark.parametrize("kept", [None, "town = 'a' AND id < 150"])
def test_same_hits_as_scoring_all(spark, corpus, limit, kept):
    docs, index = corpus
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    keep, local = F.expr(kept) if kept else None, F.col("town") == "b"
    want = rows_of(search.ranked(search.matches(index, docs, queries, keep, local), limit, more=False))
    b = block_max.blocked(index, 8)
    assert rows_of(block_max.top(b, docs, queries, limit, keep, local, first=4)) == want and want


def test_fewer_postings_are_read(spark, corpus, tmp_path):
    docs, index = corpus
    queries = spark.createDataFrame([("q", "wordc rarebj raredk")], "query_id string, query string")
    block_max.save(block_max.blocked(index, 8), str(tmp_path / "i"))
    b = block_max.read(spark, str(tmp_path / "i"))
    first, hits, rest = block_max.to_read(b, docs, queries, 3, first=4)
    hit = search.weighted(b.index, queries)
    n = {k: search.read_postings(b.index, hit, only).count() for k, only in (("all", None), ("first", first), ("rest", rest))}
    assert hits.count() == 3 and n["first"] + n["rest"] < 0.5 * n["all"]
    assert rows_of(block_max.top(b, docs, queries, 3, first=4)) == rows_of(search.ranked(search.matches(index, docs, queries), 3, more=False))


def test_bounds_hold(spark, corpus):
    docs, index = corpus
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    b = block_max.blocked(index, 8)
    real = search.scores(b.index, queries).join(b.index.postings.select("id", "block").distinct(), "id")
    over = real.join(block_max.bounded(b, queries, 1.0), ["query_id", "block"], "left").where("bound IS NULL OR score > bound + 1e-9")
    assert over.count() == 0


def test_empty(spark, corpus):
    docs, index = corpus
    none = search.build_index(docs.limit(0), search.document_tokens(F.col("title"), F.col("text")))
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert block_max.top(block_max.blocked(none), docs.limit(0), queries).collect() == []
