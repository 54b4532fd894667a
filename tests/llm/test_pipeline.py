import random
import zlib

import corpus_pipeline
from tidemark.llm import common, decontaminate, mixing, pii, simhash
from tidemark.llm.common import load


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return (a or "").lower().split() == (b or "").lower().split() or len(x & y) >= 0.8 * len(x | y) > 0


def test_similar_groups_against_all_pairs(spark, docs_of):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rnd.choice([60, 120, 300]))] for _ in range(25)]
    rows = []
    for w in base:
        for _ in range(rnd.choice([1, 1, 2, 5])):
            v = list(w)
            if rnd.random() < 0.7:
                v[rnd.randrange(len(v))] = word()
            rows.append((len(rows) + 10, " ".join(v)))
        rows.append((len(rows) + 10, " ".join(w[: len(w) // 2] + [word() for _ in w])))  # half the same: no duplicate
    rows += [(3, None), (4, ""), (5, " "), (None, rows[0][1]), (None, "only this"), (900, rows[2][1]), (900, rows[2][1]), (901, "UPPER of " + rows[4][1])]
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs_of(rows, "1 as th")).collect()), key=str)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    want = {min(((d is None, d or 0) for d, _ in g)) for g in groups.values()}
    assert [(d is None, d or 0) for d, _ in got] == [(d is None, d or 0) for d, _ in got] and len(got) == len(groups)
    assert {(d is None, d or 0) for d, _ in got} == want


def groups_of(rows):
    """Smallest ids of the components of all alike pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_scattered_edits_in_long_texts_are_found(spark, docs_of):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(60):
        n = rnd.choice([100, 200, 400])
        w = [word() for _ in range(n)]
        v = list(w)
        for at in rnd.sample(range(n), n // 48):
            v[at] = word()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    want = groups_of(rows)
    assert len(want) < 75
    assert {r.doc_id for r in simhash.deduplicated(docs_of(rows)).collect()} == want


def test_large_families_are_grouped_by_all_pairs(spark, docs_of):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(100)]
    rows = []
    for _ in range(60):  # of a common frame: not alike, but each has a copy that is
        w = frame[:92] + [word() for _ in range(14)]
        v = list(w)
        v[rnd.randrange(20, 90)] = word()
        v[rnd.randrange(20, 90)] = word()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    rnd.shuffle(rows)
    want = groups_of(rows)
    assert 40 < len(want) < 110
    assert {r.doc_id for r in simhash.deduplicated(docs_of(rows)).collect()} == want


def test_orders_of_the_same_words_do_not_hide_a_pair(spark, docs_of):
    rnd = random.Random(10)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(rnd.sample(words, 300))) for i in range(20)]
    pair = rnd.sample(words, 300)
    rows += [(101, " ".join(pair)), (102, " ".join(pair[:150] + ["other"] + pair[151:]))]
    assert {r.doc_id for r in simhash.deduplicated(docs_of(rows)).collect()} == {*range(20), 101}


def test_large_buckets_and_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "LARGE", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    test_large_families_are_grouped_by_all_pairs(spark, docs_of)


def test_long_texts_and_clashing_columns(spark, docs_of):
    rnd = random.Random(11)
    w = [f"w{rnd.randrange(10**5)}" for _ in range(200_000)]
    v = list(w)
    for at in rnd.sample(range(len(v)), 1000):
        v[at] = "new"
    df = docs_of([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(w[:100_000])), (4, None)], "5 AS th").selectExpr("*", "6 AS of", "7 AS cls", "8 AS num", "9 AS __id", "10 AS root")
    got = {r.doc_id: (r.th, r.of, r.cls, r.num, r["__id"], r.root) for r in simhash.deduplicated(df).collect()}
    assert got == {d: (5, 6, 7, 8, 9, 10) for d in (1, 3, 4)}


def test_run_on_other_tables(spark, sf_dir, tmp_path):
    docs = load(spark, sf_dir, "documents")
    for t in ("labels", "benchmark"):
        load(spark, sf_dir, t).write.parquet(f"{tmp_path}/{t}.parquet")
    more = docs.limit(60).selectExpr("*", *(f"doc_id AS `{c}`" for c in ("id", "y", "quality_score", "copy_no", "__rate", "__id", "th", "bad", "terms", "part")))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert set(rows.columns) == {*corpus_pipeline.COLUMNS, "copy_no"} and rows.count()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        load(spark, sf_dir, t).limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_stages_on_the_table(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    inputs, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, inputs, sf_dir), "test")
        kept.append((inputs, out))
        inputs = out
    assert all(set(o.columns) == set(docs.columns) for _, o in kept[:-1])
    # classifier: labelled documents mostly as labelled
    labels = {r.doc_id: r.quality for r in load(spark, sf_dir, "labels").collect()}
    stay = {r.doc_id for r in kept[0][1].collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in stay for d in good) >= 0.97 * len(good)
    # near-duplicates: nothing alike is left over, nothing else went
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept[1])
    gone = before.keys() - after.keys()
    assert all(any(alike(before[g], before[k]) for k in before if k != g) for g in gone)
    left = list(after.items())
    bad = [(a, b) for i, (a, s) in enumerate(left) for b, t in left[:i] if abs(len(s) - len(t)) < 0.4 * len(s) and alike(s, t)]
    assert not bad
    # decontamination
    before, after = ({r.doc_id for r in x.collect()} for x in kept[2])
    bad = {r.doc_id for r in decontaminate.contaminated(kept[2][0], load(spark, sf_dir, "benchmark")).collect()}
    assert after == before - bad
    # personal data: no base span is left, clean texts are as they were
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept[3])
    assert before.keys() == after.keys()
    again = {r.doc_id: (len(r.base), len(r.terms)) for r in pii.spans(kept[3][0]).collect()}
    assert all((before[d] == after[d]) == (again[d] == (0, 0)) for d in before)
    # mixing
    rates = {r.doc_id: r.copies for r in mixing.rates(kept[4][0]).collect()}
    got = {}
    for r in kept[4][1].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in rates.items() if n}


def test_run_is_all_stages_and_repeats(spark, sf_dir):
    key = lambda: sorted((r.doc_id, r.copy_no, zlib.crc32(r.text.encode())) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert key() == key() != []
