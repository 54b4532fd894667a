"""Fuzzy pairs are found in cells: all of them, whatever the parts, and without rows of pairs in a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_class_pairs import _all_pairs
from tidemark.operators import dedupe, title_cells


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_pair_is_shuffled(spark):
    """300 titles that differ by a word are 44,850 pairs; rows in shuffles grow with the titles."""
    rows = [(i, "x", " ".join([f"w{k}" for k in range(12)] + [f"own{i}"]), "hall") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, day string, title string, venue string").withColumn("ord", F.col("id")).checkpoint()
    for result, count in ((dedupe.fuzzy_pairs, 44850), (dedupe.duplicate_of, 299)):
        before = _shuffled(spark)
        assert len(result(df, df, ["day"], "id", "ord").select("id").collect()) == count
        assert _shuffled(spark) - before < 300 * 12


def _rows(spark, seed, first, n=150):
    r = random.Random(seed)
    words, places = [f"w{i}" for i in range(14)], ["hall", "park", "town"]
    rows = [(first + i, r.choice(["x", "x", "y", None]), " ".join(r.sample(words, r.choice([0, 1, 2, 3, 5, 8, 14]))), " ".join(r.sample(places, r.randint(0, 3)))) for i in range(n)]
    rows += [(first + n + i, "x", r.choice(["w1 w2 w3", "w3 w2 w1"]), "hall") for i in range(60)]  # copies
    return rows, spark.createDataFrame(rows, "id long, day string, title string, venue string").withColumn("ord", F.col("id"))


@pytest.mark.parametrize("part, entry", [(1 << 24, 1000), (1000, 7)])
def test_all_pairs_in_any_parts(spark, monkeypatch, part, entry):
    monkeypatch.setattr(dedupe, "PART_BYTES", part)
    monkeypatch.setattr(dedupe, "ENTRY_ROWS", entry)
    rows, df = _rows(spark, 1, 0)
    later, new = _rows(spark, 2, 1000)
    for (a, a_rows), (b, b_rows) in (((df, rows), (df, rows)), ((new, later), (df, rows))):
        want = _all_pairs(a_rows, b_rows)
        got = [(p.id, p.other_id) for p in dedupe.fuzzy_pairs(a, b, ["day"], "id", "ord").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {p.id: p.duplicate_of for p in dedupe.duplicate_of(a, b, ["day"], "id", "ord").collect()} == {i: min(y for x, y in want if x == i) for i, _ in want}


def test_small_chunks_lose_nothing(monkeypatch):
    import pyarrow as pa

    r = random.Random(3)
    words = [f"w{i}" for i in range(10)]
    t = [" ".join(sorted(r.sample(words, r.randint(1, 8)))) for _ in range(80)]
    v = [" ".join(sorted(r.sample(["a", "b", "c"], r.randint(0, 3)))) for _ in t]
    table = pa.table({"t": t, "v": v, "side": [i % 2 for i in range(80)]})
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    ok = lambda x, y: (lambda p, q: p >= 0.6 or (q >= 0.5 and p >= 0.35))(share(set(t[x].split()), set(t[y].split())), share(set(v[x].split()), set(v[y].split())))
    for chunk in (1 << 20, 5):
        monkeypatch.setattr(title_cells, "CHUNK", chunk)
        for within in (True, False):
            got = [(int(x), int(y)) for found in title_cells.alike(table, within, title_cells.Needs(0.6, 0.5, 0.35)) for x, y in zip(*found[:2])]
            pairs = [(x, y) for x in range(80) for y in range(80) if (x < y if within else x % 2 == 0 and y % 2 == 1)]
            assert len(got) == len(set(got)) and {tuple(sorted(p)) if within else p for p in got} == {p for p in pairs if ok(*p)}


def test_rows_without_a_place_in_the_order_are_in_no_pair(spark):
    rows = [(1, None, "jazz night"), (2, 2, "jazz night"), (3, 3, "night jazz")]
    df = spark.createDataFrame(rows, "id int, ord int, title string").withColumns({"day": F.lit("x"), "venue": F.lit(None).cast("string")})
    assert [tuple(r) for r in dedupe.duplicate_of(df, df, ["day"], "id", "ord").collect()] == [(3, 2)]
    assert [(r.id, r.other_id, r.title_score, r.venue_score) for r in dedupe.fuzzy_pairs(df, df, ["day"], "id", "ord").collect()] == [(3, 2, 1.0, 0.0)]
