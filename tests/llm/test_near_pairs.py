import random

import numpy as np
import pyarrow as pa

from tests.llm.test_pipeline import groups_of
from tidemark.llm import simhash


def family(n, seed=12):
    """Copies of one frame with two to five of its 400 words changed: of their pairs many are alike, many nearly."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(400)]
    rows = []
    for i in range(n):
        v = list(frame)
        for at in rnd.sample(range(400), rnd.choice([2, 5])):
            v[at] = word()
        rows.append((i, " ".join(v)))
    return rows


def test_pairs_of_a_family_do_not_grow_with_its_square(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda fps, radius: fps.selectExpr("fp AS a", "fp AS b").limit(0))  # the shingles alone
    made, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, folder=None: (out := write(df, name, folder), made.append(out.count() if name == "pairs" else 0))[0])
    rows = family(200)
    assert {r.doc_id for r in simhash.deduplicated(docs_of(rows)).collect()} == groups_of(rows)
    assert sum(made) < 10 * len(rows)


def test_a_cell_gives_each_label_its_nearest(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(3)
    sizes = [1, 3, 4, 9, 150]  # of cells, by distance and by blocks
    key = np.repeat(np.arange(len(sizes)), sizes)
    n = len(key)
    base = rng.integers(0, 1 << 62, (len(sizes), simhash.SKETCH)).astype(np.int64)[key]
    sketch = base ^ (np.int64(1) << rng.integers(0, 62, (n, simhash.SKETCH)))
    label = rng.integers(0, 40, n)
    cols = {"key": key, "ci": key * 0, "cj": key * 0, "blk": key * 0, "num": np.arange(n), "label": label, "size": np.full(n, 100), "pos": key * 0} | dict(zip(simhash._SKETCH, sketch.T.copy(), strict=True))
    batches = [pa.RecordBatch.from_pydict(cols).slice(i, 50) for i in range(0, n, 50)]
    got = {tuple(sorted(p.values())) for b in simhash._nearest_pairs(0.8)(batches) for p in b.to_pylist()}
    apart = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(axis=-1)
    may = (key[:, None] == key) & (label[:, None] != label)
    for k in range(len(sizes)):
        for own in set(label[key == k]):
            mine = np.where(may & ((key == k) & (label == own))[:, None] & (apart <= 22), apart, 99)
            pairs = [(i, j) for i, j in got if key[i] == k and own in (label[i], label[j])]
            assert bool(pairs) == (mine.min() < 99) and (not pairs or min(apart[i, j] for i, j in pairs) == mine.min())
    assert len(got) <= sum(len(set(label[key == k])) for k in range(len(sizes)))


def test_links_are_joined_up_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    old, new = ([tuple(f"n{x:03d}" for x in rng.integers(0, 300, 2)) for _ in range(n)] for n in (90, 120))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in old + new:
        parent[find(a)] = find(b)
    for most in (25, 1000):
        monkeypatch.setattr(simhash, "LINKS", most)
        got = simhash.merged(None, spark.createDataFrame(old, "a string, b string"))
        rows = simhash.merged(got, spark.createDataFrame(new, "a string, b string")).collect()
        roots = {r.node: r.root for r in rows}
        assert len(roots) == len(rows) and roots.keys() == {x for p in old + new if p[0] != p[1] for x in p}
        assert {(find(x), r) for x, r in roots.items()} == {(find(r), r) for r in set(roots.values())}
        assert len({find(x) for x in roots}) == len(set(roots.values()))
