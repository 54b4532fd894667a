import os
import random

from pyspark.sql import functions as F

from tidemark.operators import grouped_rows as gr


def test_places_of_a_hot_group_over_many_parts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None, *"abcdefgh"]) if i % 3 else "hot", rng.choice([None, *range(400)]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "day string, at int, id int")
    got = gr.positioned(df, ["day"], ["at", "id"], parts=12)
    by = {}
    for r in got.collect():
        by.setdefault(r.day, []).append((r.pos, r.at is not None, r.at or 0, r.id, r.size))
    assert sum(map(len, by.values())) == len(rows)
    for day, own in by.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and {x[4] for x in own} == {len(own)}
        assert [x[1:4] for x in own] == sorted(x[1:4] for x in own)
    parts = got.where("day = 'hot'").select(gr.PART).distinct().count()
    assert parts >= 5 and got.groupBy(gr.PART).count().agg(F.max("count")).first()[0] < 600


def test_lines_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i % 4}", i) for i in range(200)], "source string, id int")
    rows = gr.positioned(df, ["source"], ["id"], parts=7)
    texts = gr.lines(rows, F.concat(F.lit("# "), "source", F.lit(" "), F.col("size").cast("string")), F.concat(F.lit("- "), F.col("id").cast("string")))
    gr.write_lines(texts, str(tmp_path / "out"), parts=5)
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    text = "".join((tmp_path / "out" / f).read_text() for f in files)
    assert text.splitlines() == [x for s in range(4) for x in (f"# s{s} 50", *(f"- {i}" for i in range(s, 200, 4)))] and len(files) > 1


def test_equal_rows_several_groups_and_none(spark):
    df = spark.createDataFrame([("a", 1, 5)] * 6 + [("a", 2, 5), (None, None, None)], "x string, y int, pos_ int")
    got = sorted((r.x or "", r.y or 0, r.pos, r.size) for r in gr.positioned(df, ["x", "y"], ["pos_"], parts=3).collect())
    assert got == [("", 0, 1, 1), *(("a", 1, i, 6) for i in range(1, 7)), ("a", 2, 1, 1)]
    assert gr.positioned(df.limit(0), ["x"], ["y"]).collect() == []
