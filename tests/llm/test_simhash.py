import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import load


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    """rows: (doc_id, fp); smallest reachable doc_id of each."""
    fps = list({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in load(spark, sf_dir, "documents").collect()]
    got = sorted((tuple(r) for r in simhash.query(spark, sf_dir).collect()), key=str)
    assert got == brute_components(rows)


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_masks_cover_every_pair(radius):
    rng = np.random.default_rng(1)
    for level in range(3):
        m = simhash.masks(radius, level)
        for _ in range(500):
            diff = np.uint64(sum(1 << int(i) for i in rng.choice(64, radius, replace=False)))
            assert ((m & diff) == 0).any()


def test_large_buckets_keep_all_connections(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "LARGE", 16)
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    rows = []
    for i in range(300):
        f = base[i % 3]
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            f ^= 1 << int(b)
        rows.append((i, f))
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.grouped(df).collect()), key=str)
    assert got == brute_components(rows)


def test_nulls_ties_and_empty(spark, docs_of):
    df = docs_of([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, None), (3, ""), (9, " \n "), (8, "A B c  d"), (None, "zz")], "1 as fp")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 5), (None, 5), (8, 5), (7, 3), (3, 3), (9, 3), (None, None)}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
