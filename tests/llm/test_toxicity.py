import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity as tx


def naive(s, at=0):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(s[i:j]), -i, -(j - i)) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[1] - best[2]
    return naive(s[:i], at) + [(at + i, at + j, best[0])] + naive(s[j:], at + j)


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_definition(seed):
    rng = np.random.default_rng(seed)
    s = np.round(rng.normal(-0.2, 1, 40), 6)
    got = tx.segments(s)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in naive(s.tolist())]
    assert np.allclose([v for _, _, v in got], [s[a:b].sum() for a, b, _ in got])


def test_segments_are_linear_and_take_edges():
    import time

    assert tx.segments(np.zeros(0)) == [] and tx.segments(np.full(5, -1.0)) == [] and tx.segments(np.zeros(3)) == []
    assert tx.segments(np.array([2.0])) == [(0, 1, 2.0)]
    rising = np.tile([1.0, -0.5], 200_000)
    start = time.perf_counter()
    assert tx.segments(rising)[0][:2] == (0, 399_999)
    falling = np.tile([0.5, -1.0], 200_000)
    assert len(tx.segments(falling)) == 200_000
    assert time.perf_counter() - start < 20


def test_law_is_found_again():
    rng = np.random.default_rng(5)
    n = rng.integers(50, 2_000, 4_000)
    x = (np.log(0.3 * n) - np.log(-np.log(rng.random(4_000)))) / 1.7
    scale, size = tx.law(x, n)
    assert abs(scale - 1.7) < 0.08 and abs(math.log(size / 0.3)) < 0.35
    assert tx.law(np.zeros(4), np.ones(4)) == (1.0, 1.0) and tx.law(np.zeros(0), np.ones(0)) == (1.0, 1.0)


def test_isotonic_rises_and_fits():
    rng = np.random.default_rng(6)
    x = rng.random(300)
    y = (rng.random(300) < x).astype(float)
    knots, values = tx.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()
    assert np.interp(0.05, knots, values) < 0.3 and np.interp(0.95, knots, values) > 0.7


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioustrnl", k=rng.randint(3, 8))) for _ in range(400)]
    nasty = ["grobian", "grobiana", "grobianus", "wretch", "wretched", "louse"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([20, 80, 300]))
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(nasty, k=4)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_rows_and_passages(spark, docs_of):
    docs, labels = corpus(900)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    lab = spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, toxic int")
    df = docs_of(docs).selectExpr("*", "1 AS score", "'x' AS toxicity", "2 AS y", "3 AS back")
    model = tx.trained(df, lab)
    rows = {r["doc_id"]: r for r in tx.scored(df, model).collect()}
    assert rows[0]["score"] == 1 and rows[0]["y"] == 2
    right = sum((rows[i]["toxicity"]["score"] >= 0.5) == bool(t) for i, t in labels if i in held)
    assert right >= 0.97 * len(held)
    for i, t in labels:
        if t and i in held:
            nasty = [k for k, u in enumerate(tx.units(rows[i]["text"])) if u[:4] in (b"grob", b"wret", b"lous")]
            marked = {k for p in rows[i]["toxicity"]["passages"] for k in range(p["first"], p["end"])}
            assert len(marked.intersection(nasty)) >= 2 and len(marked) < 40


def chain_of(unit):
    """Buckets of a unit's beginnings and its own, and its hash, one unit at a time."""
    h, levels = tx.Units([[unit]]).levels()
    return [int(at[0]) for has, at in levels if has[0]], int(h[0])


def plain_scores(model, text):
    base, out, met = model.n_toxic / (model.n_toxic + model.n_clean), [], {}
    for u in tx.units(text):
        chain, _ = chain_of(u)
        share = base
        for b, longer in zip(chain, [*chain[1:], None]):
            t, c = float(model.toxic[b]), float(model.clean[b])
            if longer is not None:
                t, c = max(t - float(model.toxic[longer]), 0), max(c - float(model.clean[longer]), 0)
            share = (t + tx.STRENGTH * share) / (t + c + tx.STRENGTH)
        s = math.log(share / (1 - share)) - math.log(base / (1 - base)) - tx.DRIFT
        if s > 0:
            met[u] = met.get(u, 0) + 1
            s /= met[u]
        out.append(s)
    return out


def test_scored_equals_plain_model(spark, docs_of):
    """The job's counts and scores against a plain version over the same rows."""
    docs, labels = corpus(300, seed=4)
    docs += [(1000, None), (1001, ""), (1002, "?! ..."), (1003, docs[0][1]), (1004, "Ünder “grobian” wretch! wretch, WRETCH grob" + "a" * 30)]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (1001, 0)], "doc_id long, toxic int")
    model = tx.trained(docs_of(docs), lab)
    back = {r[0] for r in spark.createDataFrame(docs, "id long, t string").selectExpr("id", f"pmod(xxhash64(id), {tx.FOLDS}) = 0 AS b").collect() if r[1]}
    text, y = dict(docs), dict([*labels, (1001, 0)])
    count = [dict(), dict()]
    for i, t in y.items():
        if i not in back:
            for b in {b for u in tx.units(text[i] or "") for b in chain_of(u)[0]}:
                count[t][b] = count[t].get(b, 0) + 1
    for t, got in ((0, model.clean), (1, model.toxic)):
        assert {int(b): int(got[b]) for b in np.flatnonzero(got)} == count[t]
    assert model.n_clean + model.n_toxic == len([i for i in y if i not in back])
    rows = {r["doc_id"]: r["toxicity"]["score"] for r in tx.scored(docs_of(docs), model).collect()}
    for i, t in docs:
        s = plain_scores(model, t or "")
        evidence = tx._evidence(np.array([v for _, _, v in naive_fast(s)]), max(len(s), 1), model.scale, model.size)[0]
        assert abs(rows[i] - tx._score(model, evidence)) < 1e-6
    assert rows[1000] == rows[1001] == rows[1002] and rows[1003] == rows[0]


def test_parts_and_units(monkeypatch):
    model = tx.Model(np.zeros(tx.BUCKETS, np.float32), np.zeros(tx.BUCKETS, np.float32), 9, 1)
    model.toxic[chain_of(b"wretch")[0]] = 5
    texts = ["", "wretch and " * 30, "x", "louse wretch"]
    whole = tx.scores(model, texts)
    monkeypatch.setattr(tx, "PART", 16)
    assert all(np.allclose(a, b) for a, b in zip(whole, tx.scores(model, texts), strict=True))
    assert tx.scores(model, []) == [] and [len(s) for s in whole] == [0, 60, 1, 2]
    assert tx.units("“Idiot” don't x_y 漢字。") == [b"idiot", b"don", b"t", b"x", b"y", "漢字".encode()]
    assert tx.units("漢" * 25) == ["漢漢".encode()] * 24


def naive_fast(s):
    """Maximal segments from prefix sums, quadratic."""
    c = np.concatenate([[0.0], np.cumsum(s)])

    def go(a, b):
        if a >= b:
            return []
        low = np.minimum.accumulate(c[a:b])
        gain = c[a + 1 : b + 1] - low
        j = int(gain.argmax())
        if gain[j] <= 1e-12:
            return []
        i = int(np.argmin(c[a : a + j + 1]))
        return go(a, a + i) + [(a + i, a + j + 1, float(gain[j]))] + go(a + j + 1, b)

    return go(0, len(s))


def test_classes_missing_and_empty_tables(spark, docs_of):
    docs, labels = corpus(40)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["toxicity"]["score"] for r in tx.scored(docs_of(docs), tx.trained(docs_of(docs), none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, toxic int")
    assert {r["toxicity"]["score"] for r in tx.scored(docs_of(docs), tx.trained(docs_of(docs), one)).collect()} == {1.0}
    empty = docs_of([])
    assert tx.scored(empty, tx.trained(empty, none)).collect() == []


def test_very_long_texts(spark, docs_of):
    docs, labels = corpus(300, seed=3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.trained(docs_of(docs), lab)
    words = " ".join(docs[0][1].split()[:20] * 50_000)
    rows = [(1, words), (2, words + " grobian wretch louse grobiana wretched"), (3, "x" * 3_000_000), (4, "字" * 300_000)]
    got = {r["doc_id"]: r["toxicity"] for r in tx.scored(docs_of(rows), model).collect()}
    assert got[2]["score"] > got[1]["score"]
