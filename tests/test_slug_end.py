"""The start with a slug is found by one trial."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as tx


def test_slug_end_is_the_first_of_all_starts(spark):
    r = random.Random(3)
    rows = [("".join(r.choice("aB1- .éİ\n") for _ in range(r.randint(0, 12))), r.choice(["a", "ab", "b1-a", "", "a-b", "-a", "a--b", "A", "(", None])) for _ in range(3000)]
    rows += [(x, s) for x in ("Wine walk Hall", "ab", "abc  d", "Wine-walkers") for s in ("wine-walk", "wine", "ab", "abc", "wine-walk-hall", None)]
    df = spark.createDataFrame(rows, "x string, s string")
    every = F.get(F.filter(F.sequence(F.lit(4), F.greatest(F.length("x"), F.lit(4))), lambda i: tx.slug(F.substring("x", F.lit(1), i), None) == F.col("s")), F.lit(0))
    out = df.select("x", "s", tx.slug_end(F.col("x"), F.col("s")).alias("got"), every.alias("want")).collect()
    assert [(o.x, o.s, o.got) for o in out] == [(o.x, o.s, o.want) for o in out]
    assert any(o.got for o in out)
