import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.normalize import CATEGORY_RULES


def test_one_pattern_for_all_rules():
    whole = tx.any_of([p for _, p in CATEGORY_RULES])
    words = re.findall("[a-z0-9]+", " ".join(p for _, p in CATEGORY_RULES)) + ["21+", "fest", "clean-up", "farmers' market", "theatre", "sip", "sink", "artful", "fun"]
    rnd = random.Random(1)
    for _ in range(3000):
        t = rnd.choice(["", " "]).join(rnd.choice(words)[: rnd.choice([3, 20])] for _ in range(rnd.choice([1, 2, 3])))
        assert bool(re.search(whole, t)) == any(re.search(p, t) for _, p in CATEGORY_RULES), t


def test_patterns_of_other_forms_have_no_one_pattern():
    assert tx.any_of([r"\b(a|b)\b", "c"]) is None
    assert tx.any_of([r"\b(a)\b|\b(b)\b"]) is None
    assert tx.any_of([r"\b(a?b)\b"]) is None and tx.any_of([r"\b([ab]c)\b"]) is None and tx.any_of([]) is None


def test_classes_are_of_the_first_rule_that_matches(spark):
    texts = ["Live MUSIC", "a craft fair", "craft", "theater", "theatre!", "nothing", "", None, "the 21+ hour", "fest", "festive", "party", "after dark", "clean up"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.classify(F.col("t"), CATEGORY_RULES)).collect()]
    want = [next((n for n, p in CATEGORY_RULES if re.search(p, (t or "").lower())), "other") for t in texts]
    assert got == want
    other = (("x", r"^one"), ("y", r"\b(two)\b"))
    got = [r[0] for r in spark.createDataFrame([("one two",), ("two",), ("three",)], "t string").select(tx.classify(F.col("t"), other)).collect()]
    assert got == ["x", "y", "other"]
