import math
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import lm_score
from tidemark.llm.common import held_out, load

DEPTH = 5


def brute_tree(train):
    """Counts and weighted block probabilities of every node, by recursion over contexts."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in train:
        s = b"\xff" * DEPTH + t + b"\xff"
        for i in range(DEPTH, len(s)):
            for j in range(8):
                node, bit = (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1
                for d in range(DEPTH + 1):
                    counts[s[i - d : i], node][bit] += 1
                    if d < DEPTH:
                        children[s[i - d : i], node].add(s[i - d - 1 : i])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}

    def lw(ctx, node):
        if (ctx, node) not in weighted:
            own = kt(*counts[ctx, node])
            if len(ctx) == DEPTH:
                weighted[ctx, node] = own
            else:
                below = sum(lw(c, node) for c in children[ctx, node])
                hi = max(own, below)
                weighted[ctx, node] = hi + math.log(0.5 * math.exp(own - hi) + 0.5 * math.exp(below - hi))
        return weighted[ctx, node]

    def prob(ctx, node, bit, d=0):
        c = ctx[len(ctx) - d :]
        a, b = counts[c, node] if (c, node) in counts else (0, 0)
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == DEPTH:
            return own
        share = 0.5 * math.exp(kt(a, b) - lw(c, node)) if (c, node) in counts else 0.5
        return share * own + (1 - share) * prob(ctx, node, bit, d + 1)

    return prob


def brute(rows, is_train):
    train = [(t or "").encode() for d, t in rows if is_train(d)]
    words = Counter(w for t in train for w in t.lower().split())
    ends = len(train)
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    prob = brute_tree(train)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        w = b.lower().split()
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        s, score = b"\xff" * DEPTH + b + b"\xff", 0.0
        for i in range(DEPTH, len(s)):
            for j in range(8):
                score += math.log10(prob(s[i - DEPTH : i], (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1))
        out.append((d, len(w) + 1, sum(x in words for x in w) + (ends > 0), n, base, score))
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def split(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 7 != 2


def result(df):
    cols = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return [tuple(r) for r in lm_score.scored(df, ~held_out(7, 2)).select(*cols).collect()]


@pytest.mark.parametrize("few", [False, True])
def test_against_recursion(spark, docs_of, sf_dir, monkeypatch, few):
    if few:  # nearly everything is looked up by joins
        monkeypatch.setattr(lm_score, "GRAMS", 40)
        monkeypatch.setattr(lm_score, "WORDS", 5)
    rows = [(r.doc_id, r.text[:400]) for r in load(spark, sf_dir, "documents").limit(25).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "The end"), (rows[3]), (1003, "日本語 \x00 É"), (1004, "THE of the")]
    same(result(docs_of(rows, "1 as score")), brute(rows, split))


def test_no_training_rows_and_empty(spark, docs_of):
    rows = [(d, "some words here") for d in range(200) if not split(d)][:3]
    same(result(docs_of(rows)), brute(rows, split))
    assert result(docs_of([])) == []


def test_held_out_texts_are_worse_but_near(spark, sf_dir):
    rows = lm_score.query(spark, sf_dir).collect()
    bits = {h: sum(-r.score for r in rows if r.held_out == h) / sum(r.bits_per_byte is not None and -r.score / (r.bits_per_byte or 1) or 0 for r in rows if r.held_out == h) for h in (False, True)}
    assert bits[False] < bits[True] < 4.5
