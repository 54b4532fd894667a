"""Fuzzy pairs meet on few words, and none is missed."""

import random

from pyspark.sql import functions as F

from tidemark.operators import dedupe


def _rows(spark, seed, first, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(first + i, r.choice(["x", "y", None]), " ".join(r.sample(words, r.randint(0, 6))), " ".join(r.sample(["hall", "park", "town"], r.randint(0, 3)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, day string, title string, venue string").withColumn("ord", F.col("id"))


def _all_pairs(new, old):
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    out = set()
    for i, day, title, venue in new:
        for j, other, t, v in old:
            x, y = share(set(title.split()), set(t.split())), share(set(venue.split()), set(v.split()))
            if j < i and day is not None and day == other and (x >= 0.6 or (y >= 0.5 and x >= 0.35)):
                out.add((i, j))
    return out


def test_no_pair_is_missed(spark):
    rows, df = _rows(spark, 1, 0)
    later, new = _rows(spark, 2, 100)
    pairs = lambda a, b: [(p.id, p.other_id) for p in dedupe.fuzzy_pairs(a, b, ["day"], "id", "ord").collect()]
    for got, want in ((pairs(df, df), _all_pairs(rows, rows)), (pairs(new, df), _all_pairs(later, rows))):
        assert len(got) == len(set(got)) and set(got) == want
    firsts = {p.id: p.duplicate_of for p in dedupe.duplicate_of(df, df, ["day"], "id", "ord").collect()}
    assert firsts == {i: min(b for a, b in _all_pairs(rows, rows) if a == i) for i, _ in _all_pairs(rows, rows)}


def test_titles_of_other_venues_meet_on_their_rarest_words_only(spark):
    rows = spark.createDataFrame([("x", 1, ["a", "b", "c", "d", "e"], ["hall"])], "day string, __no long, t array<string>, v array<string>")
    words = lambda need, keys: [r["__w"] for r in dedupe._prefixes(rows, ["day"], need, keys).orderBy("at").collect()]
    assert words(dedupe.TITLE_ALONE, []) == ["a", "b", "c"]
    assert words(dedupe.TITLE_WITH_VENUE, ["__v"]) == ["a", "b", "c", "d"]
