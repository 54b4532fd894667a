import random

from tidemark.llm import decontaminate
from tidemark.llm.common import load


def brute(docs, bench, similarity=0.8):
    """Every window as long as an item against the item, if they share a shingle of five words."""
    items = [(i, decontaminate.words_of(t)) for i, t in bench]
    out = {}
    for d, t in docs:
        w = decontaminate.words_of(t)
        for i, x in items:
            k = min(5, len(x))
            if not x or len(w) < len(x):
                continue
            known = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
            near = {j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in known}
            for s in {j - o for j in near for o in range(len(x))}:
                if 0 <= s <= len(w) - len(x):
                    v = decontaminate.similarity_of(b" ".join(w[s : s + len(x)]), b" ".join(x))
                    if v >= similarity:
                        out[d, i] = max(out.get((d, i), 0), v)
    return out


def found(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    bench = [(r.item_id, r.text) for r in load(spark, sf_dir, "benchmark").collect()]
    want = brute(rows, bench)
    assert want and found(decontaminate.query(spark, sf_dir)) == want


def test_edges(spark, docs_of):
    item = "The quick brown fox jumps over the lazy dog and then it sleeps under a very old oak tree all day"
    bench = spark.createDataFrame([(1, item), (2, "Solo words"), (3, None), (4, " .. ")], "item_id long, text string")
    rows = [(1, f"Intro,%%% {item.upper()}!! outro"), (2, "quick brown fox jumps over"), (3, None), (4, ""), (None, item), (5, "well solo, words here"), (5, "again"), (6, f"{item} {item}")]
    got = found(decontaminate.contaminated(docs_of(rows, "1 as n"), bench))
    assert set(got) == {(1, 1), (None, 1), (5, 2), (6, 1)} and set(got.values()) == {1.0}
    assert found(decontaminate.contaminated(docs_of(rows), bench.limit(0))) == {}
    assert found(decontaminate.contaminated(docs_of([]), bench)) == {}


def test_no_edited_passage_is_missed(spark, docs_of):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [(i, [word() for _ in range(rnd.choice([49, 60, 100, 200]))]) for i in range(60)]
    docs = []
    for i, x in items:
        for edits in (1, 2, 4):
            v = list(x)
            for at in rnd.sample(range(len(v)), edits):
                v[at] = word()
            docs.append((len(docs), " ".join([word() for _ in range(20)] + v + [word() for _ in range(20)])))
    docs.append((len(docs), "one two three " * 60))
    bench = [(i, " ".join(x)) for i, x in items] + [(900, "one two three " * 20 + "four")]
    want = brute(docs, bench)
    assert sum(v < 0.95 for v in want.values()) > 80
    assert found(decontaminate.contaminated(docs_of(docs), spark.createDataFrame(bench, "item_id long, text string"))) == want
