import numpy as np

from tidemark.llm import quality_classifier
from tidemark.llm.common import load


def test_held_out_accuracy(spark, sf_dir):
    rows = quality_classifier.query(spark, sf_dir)
    assert rows.count() == load(spark, sf_dir, "documents").count()
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert held and np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.collect())


def test_odd_rows_and_labels(spark, docs_of):
    good, bad = "the text of a good page and more of it", "buy### now$$$ | cheap*** | ALL CAPS!!"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(90, None), (91, ""), (None, good), (92, "x" * 300_000), (1, good)]
    docs = docs_of(rows, "5 as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (90, 1), (5, 0)], "doc_id long, quality int")
    got = quality_classifier.scored(docs, quality_classifier.trained(docs, labels))
    assert got.columns == [*docs.columns, "quality_score"]
    out = [(r.doc_id, r.quality_score) for r in got.collect()]
    assert len(out) == len(rows) and all(0 <= s <= 1 for _, s in out)
    score = dict(out)
    assert score[7] > 0.5 > score[8] and score[None] == score[7] and score[90] == score[91]
    one = quality_classifier.trained(docs, labels.where("quality = 1"))
    assert {r.quality_score for r in quality_classifier.scored(docs, one).collect()} == {1.0}
    none = quality_classifier.trained(docs, labels.limit(0))
    assert {r.quality_score for r in quality_classifier.scored(docs, none).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality_classifier.scored(empty, quality_classifier.trained(empty, labels)).collect() == []


def test_few_of_many_labels_are_used(spark, docs_of):
    docs = docs_of([(i, "word " * (i % 7)) for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality_classifier.trained(docs, labels, most=3)[1].constant is not None


def test_all_units_of_a_long_word_count():
    units = quality_classifier.Units()
    (long, n), (parts, _) = units.of([b"-".join(b"w%d" % i for i in range(500))]), units.of([b" ".join(b"w%d" % i for i in range(500))])
    assert n[0] == 999 and long[::2].tolist() == parts.tolist() and all(len(w) <= quality_classifier.LONG for w in units)


def test_the_end_of_a_text_without_spaces_changes_its_score(spark, docs_of):
    good, bad = "the text of a good page and more of it", "buy### now$$$ | cheap*** | ALL CAPS!!"
    start = "same_start_" * 30
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(90, start + good.replace(" ", "_") * 20), (91, start + bad.replace(" ", "_") * 20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = docs_of(rows)
    score = {r.doc_id: r.quality_score for r in quality_classifier.scored(docs, quality_classifier.trained(docs, labels)).collect()}
    assert score[90] != score[91]
