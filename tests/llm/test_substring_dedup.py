import hashlib
import random

from tidemark.llm import substring_dedup
from tidemark.llm.common import load


def brute(rows, window=50):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = b" ".join(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[b" ".join(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256)").collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    got = sorted((tuple(r) for r in substring_dedup.query(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_planted_passages_at_any_offset(spark, docs_of):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 74, 75, 130)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [word() for _ in range(rnd.randint(0, 40))] + rnd.choice(passages)
        rows.append((rnd.randint(0, 50), " ".join(w)))
    rows += [rows[5], (None, " ".join(passages[4])), (7, None), (8, ""), (9, " \n ")]
    assert result(substring_dedup.deduplicated(docs_of(rows, "1 as th"))) == brute(rows)


def test_passages_of_very_many_texts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 40)
    test_planted_passages_at_any_offset(spark, docs_of)
    rows = [(f"id{i % 17:02d}", " ".join([f"x{i}"] * (i % 5) + [f"w{j}" for j in range(70)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert result(substring_dedup.deduplicated(df)) == brute(rows)


def test_long_text_and_empty_table(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, "x " + long), (3, "x" * 100_000)]
    df = docs_of(rows)
    assert result(substring_dedup.deduplicated(df)) == brute(rows)
    assert substring_dedup.deduplicated(df.limit(0)).collect() == []
