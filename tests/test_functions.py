import datetime as dt
import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import times as tm


def values(spark, column, rows, schema="x string"):
    """Values of a column over rows, in order."""
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def plain_tokens(s):
    t = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not "̀" <= c <= "ͯ")
    out = []
    for w in re.split("[^a-z0-9]+", re.sub(r"['’]s\b", "", t, flags=re.A)):
        if len(w) > 1 and w not in tx.STOP_WORDS:
            if len(w) > 4 and w.endswith("ies"):
                w = w[:-3] + "y"
            elif len(w) > 4 and w.endswith("ing"):
                w = w[:-3]
            elif len(w) > 3 and w.endswith("es"):
                w = w[:-2]
            elif len(w) > 3 and w.endswith("s"):
                w = w[:-1]
            out.append(w)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abcdeinst'’ éüñßA0-.\n", max_size=40), min_size=1, max_size=40))
def test_tokens(spark, texts):
    assert values(spark, tx.tokens(F.col("x")), texts) == [plain_tokens(t) for t in texts]


def test_tokens_by_hand(spark):
    got = values(spark, tx.tokens(F.col("x")), ["The Kids' stories: Anna’s résumé, dancing buses in 2026", None, "ring wines"])
    assert got == [["kid", "story", "anna", "resume", "danc", "bus", "2026"], [], ["ring", "win"]]


def test_two_ways_to_decompose(spark):
    assert values(spark, tx.strip_accents_any(F.col("x")), ["résumé", None]) == ["resume", None]
    assert values(spark, tx.key_text(F.col("x")), ["résumé of the Ｆair", "Việt phở ﬁt ½ ⑴", None]) == ["re sume fair", "vie t pho fit 1 2 1", ""]
    assert values(spark, tx.key_text(F.col("x")), ["The Wine & Cheese  Fair!", None]) == ["wine cheese fair", ""]


def test_slug_keeps_a_hyphen_at_the_cut(spark):
    assert values(spark, tx.slug(F.col("x"), 6), ["  Hello, World! ", "a--b", "ab cde-fg"]) == ["hello-", "a-b", "ab-cde"]
    assert values(spark, tx.title_key(F.col("x"), 5), ["A b-C! def", None]) == ["abcde", ""]


def test_clean_and_summary(spark):
    assert values(spark, tx.clean_html(F.col("x")), ["<b>A &amp; B</b>\n c", " <i></i> ", "&lt;x&gt; &#39;q&#39;"]) == ["A & B c", None, "<x> 'q'"]
    long = "word " * 100 + "x" * 60
    got = values(spark, tx.summary(F.col("x"), 100), ["short  text", long, "y" * 200, None])
    assert got[0] == "short text" and got[1] == ("word " * 20).strip() + "…" and got[2] == "y" * 60 + "…" and got[3] == ""


def test_classify_first_rule_wins(spark):
    rules = (("a", r"\bwine\b"), ("b", r"\b(wine|art)\b"))
    assert values(spark, tx.classify(F.col("x"), rules), ["Wine and art", "ART", "party", None]) == ["a", "b", "other", "other"]


def test_free_variants(spark):
    free = tx.is_free(F.col("x"), F.col("y"))
    assert values(spark, free, [("$5", "Free show"), (None, "Free show"), ("no charge", "x"), (None, "Freedom"), (None, None)], "x string, y string") == [False, True, True, False, False]
    loose = tx.is_free_loose(F.col("x"), F.col("y"))
    assert values(spark, loose, [(None, "gluten-free"), ("$1", None)], "x string, y string") == [True, False]
    fam = tx.is_family(F.col("x").cast("boolean"), F.col("y"), F.lit(""))
    assert values(spark, fam, [("false", "kids"), (None, "kids"), (None, "adults")], "x string, y string") == [False, True, False]


def test_hash_mod(spark):
    rows = ["a", "b", "", "é"]
    assert values(spark, tx.hash_mod(F.col("x"), 7), rows) == [int(hashlib.sha1(r.encode()).hexdigest(), 16) % 7 for r in rows]


def test_jaccard_and_links(spark):
    got = values(spark, tx.jaccard(F.split("x", ","), F.split("y", ",")), [("a,b", "b,c"), ("a", "a")], "x string, y string")
    assert got == pytest.approx([1 / 3, 1.0])
    assert values(spark, tx.jaccard(F.array().cast("array<string>"), F.split("x", ",")), ["a"]) == [0.0]
    assert values(spark, tx.markdown_links(F.col("x"), "/events/"), ["[a](/events/1) [b](/x) [c](/events/2-b)"]) == [["/events/1", "/events/2-b"]]
    assert values(spark, tx.query_string(q=F.col("x"), day=F.col("y")), [("a b", None), ("é", "1")], "x string, y string") == ["q=a+b", "q=%C3%A9&day=1"]


SATURDAY, SUNDAY, WEDNESDAY = (dt.datetime(2026, 9, d, 20) for d in (5, 6, 2))


def test_weekends():
    assert tm.weekend_listing(WEDNESDAY) == ["2026-09-04", "2026-09-05", "2026-09-06"]
    assert tm.weekend_listing(SATURDAY) == ["2026-09-05", "2026-09-06", "2026-09-11"]
    assert tm.weekend_listing(SUNDAY) == ["2026-09-06", "2026-09-11", "2026-09-12"]
    assert tm.weekend_range(WEDNESDAY) == ("2026-09-04", "2026-09-06")
    assert tm.weekend_range(SATURDAY) == ("2026-09-05", "2026-09-06")
    assert tm.weekend_range(SUNDAY) == ("2026-09-06", "2026-09-06")


def test_local_days_and_labels(spark):
    rows = [(dt.datetime(2026, 7, 1, 6, 59), None), (dt.datetime(2026, 1, 1, 8), dt.datetime(2026, 1, 1, 10, 30))]
    schema = "x timestamp_ntz, y timestamp_ntz"
    assert values(spark, tm.local_day(F.col("x")), rows, schema) == ["2026-06-30", "2026-01-01"]
    assert values(spark, tm.local_weekday(F.col("x")), rows, schema) == [2, 4]
    label = tm.when_label(F.col("x"), F.col("y"), F.lit(False))
    assert values(spark, label, rows, schema) == ["Tuesday, June 30, 2026, 11:59 PM", "Thursday, January 1, 2026, 12:00 AM – 2:30 AM"]
    assert values(spark, tm.when_label(F.col("x"), F.col("y"), F.lit(True)), rows[:1], schema) == ["Tuesday, June 30, 2026 (time not listed)"]
    assert values(spark, tm.relative_label(F.col("x"), dt.datetime(2026, 6, 30, 1)), rows[:1], schema) == ["Tomorrow"]


def test_clock_and_dates(spark):
    assert values(spark, tm.clock(F.col("x")), ["7 pm", "12:30am", "11:05 P.M.", "noon", None]) == ["19:00", "00:30", "23:05", None, None]
    dates = ["2026-09-05T10:00", "Sat, Sept. 5", "October 3rd, 2027", "9/7/2026", "Feb 30 2026", "nothing", None, "Jan 2-4, 2027"]
    got = values(spark, tm.parse_date(F.col("x"), 2026), dates)
    assert [d and d.isoformat() for d in got] == ["2026-09-05", "2026-09-05", "2027-10-03", "2026-09-07", None, None, None, "2027-01-02"]


def test_iso_start_and_offsets(spark):
    rows = [("2026-12-05 19:30", None), ("Dec 5, 2026", "7:30 pm"), ("2026-12-05", None), ("2026-12-05", "from 9:15"), (None, "7 pm")]
    for policy, off in (("fixed", "-07:00"), ("month", "-08:00"), ("zone", "-08:00")):
        got = values(spark, tm.iso_start(F.col("x"), F.col("y"), 2026, policy), rows, "x string, y string")
        assert [g and (g.iso, g.had_time) for g in got] == [(f"2026-12-05T19:30:00{off}", True)] * 2 + [(f"2026-12-05T12:00:00{off}", False), (f"2026-12-05T09:15:00{off}", True), None]


def test_month_days(spark):
    got = values(spark, tm.month_days(F.col("x")), [dt.date(2026, 2, 14), dt.date(2026, 8, 1)], "x date")
    assert len(got[0]) == 28 and got[0][0] == dt.date(2026, 2, 1)
    assert len(got[1]) == 42 and got[1][:6] == [None] * 6 and got[1][6] == dt.date(2026, 8, 1) and got[1][-5:] == [None] * 5
