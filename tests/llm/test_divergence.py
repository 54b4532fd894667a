import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"
COLS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top=50):
    """The contract, source by source and term by term."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}],
                "term": [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def rows_of(seed, n, sources=7):
    rng = random.Random(seed)
    words = ["the", "The", "café", "x-ray", "a1b", "漢字", "Ünder", "stop.", "don't", "_", "42", "tie", "tied"] + [f"w{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([0, 3, 10, 40])))
        rows.append((i, rng.choice([text, text, text, None, "the same text everywhere"]), rng.choice(["en", "en", "de", None, ""]), rng.choice([*(f"s{k}" for k in range(sources)), None])))
    return rows + rows[: n // 5]


def result(df, **kw):
    return sorted(tuple(r) for r in dv.divergence(df, **kw).select(COLS).collect())


def test_against_brute_force(spark):
    rows = rows_of(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS digest", "3 AS value", "4 AS n")
    want = brute(rows, 5)
    assert {r[2] for r in want} == {"pair", "term"}
    assert result(df, least=5) == want
    assert result(df, least=5, top=3) == brute(rows, 5, 3)


def test_nothing_kept_and_empty(spark):
    rows = rows_of(2, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, least=10_000) == brute(rows, 10_000)
    assert result(df.limit(0)) == []
    one = [(1, "only one source here", "en", "s")] * 40
    assert result(spark.createDataFrame(one, SCHEMA)) == brute(one, 30)


def test_very_long_text(spark):
    rows = [(1, "alpha beta " * 400_000, "en", "a"), (2, "beta gamma", "en", "b"), (3, "z" * 3_000_000, "en", "c")]
    assert result(spark.createDataFrame(rows, SCHEMA), least=1) == brute(rows, 1)


def test_blocks_of_pairs_with_several_tiles(monkeypatch):
    """Distances by blocks of two tiles and by the plain sum over all terms are equal, exactly."""
    monkeypatch.setattr(dv, "TILE", 4)
    monkeypatch.setattr(dv, "BLOCK", 50)
    rng = np.random.default_rng(3)
    s, v = 10, 60
    z = rng.integers(1, 1_000, s)
    p = np.where(rng.random((v, s)) < 0.3, rng.integers(1, 1_000_000_000, (v, s)), 0)
    p[:, 3] = 0  # a source without terms
    names = [f"t{i:03}" for i in range(v)]
    full = np.where(p > 0, p, z)
    want = np.abs(full[:, :, None] - full[:, None, :]).sum(axis=0)
    for a in range(3):
        for b in range(a, 3):
            rows = [(None, i, z[i]) for i in range(s) if i // 4 in (a, b)]
            rows += [(names[t], i, p[t, i]) for t in range(v) for i in range(s) if p[t, i] and i // 4 in (a, b)]
            batches = [
                pa.RecordBatch.from_arrays(
                    [pa.array(["x"] * len(part)), pa.array([a] * len(part), pa.int32()), pa.array([b] * len(part), pa.int32()), pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int32()), pa.array([int(r[2]) for r in part], pa.int64())],
                    names=["lang", "a", "b", "term", "idx", "p"],
                )
                for part in (rows[at : at + 17] for at in range(0, len(rows), 17))
            ]
            (out,) = dv._pair_sums(iter(batches))
            for i, j, part in zip(*(out.column(c).to_pylist() for c in ("i", "j", "part"))):
                assert part + v * abs(int(z[i]) - int(z[j])) == want[i, j]
            assert out.num_rows == (len([i for i in range(s) if i // 4 == a]) * len([i for i in range(s) if i // 4 == b]) if a != b else (lambda n: n * (n - 1) // 2)(len([i for i in range(s) if i // 4 == a])))


def test_terms_of_a_sliced_text(monkeypatch):
    text = ("Ab-cd é " * 500 + "tail").encode()
    whole = dv.terms(text)
    monkeypatch.setattr(dv, "SLICE", 64)
    assert dv.terms(text) == whole == Counter({b"ab": 500, b"cd": 500, "é".encode(): 500, b"tail": 1})
