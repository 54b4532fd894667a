"""Quality rules, mixing and token counts on odd rows."""

import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, quality_rules, token_count

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three"), (4, "a b c a b c"), (5, "#" * 9), (6, "x" * 300_000), (4, "a b c a b c"), (7, "l1\nl1\n \nl1")]


def test_rules_on_odd_texts(spark, docs_of):
    got = {r.doc_id: r for r in quality_rules.judged(docs_of(ODD, "1 as n_words")).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and not got[1].passes
    assert (got[4].n_words, got[4].n_repeat_words) == (6, 6) and got[5].n_symbols == 9 and got[6].word_chars == 300_000
    assert got[7].n_dup_lines == 2 and got[None].n_repeat_words == 0
    assert quality_rules.judged(docs_of([])).collect() == []


def test_repeated_windows_against_a_loop(spark, docs_of):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))) for i in range(300)]

    def brute(t):
        w = t.split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + o for i, x in enumerate(tri) if tri.count(x) > 1 for o in range(3)})

    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judged(docs_of(rows)).collect()}
    assert got == {d: brute(t) for d, t in rows}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_targets_against_resharing(spark):
    rnd = random.Random(9)
    for _ in range(12):
        sizes = {s: rnd.choice([0, 1, 5, 50, 1000]) for s in rnd.sample(["a", "b", "é", "z", "B", None, "zz", "0"], rnd.randint(1, 8))}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix_is_near_targets_and_repeats(spark, docs_of):
    rows = [(i, "w " * (i % 40), None, None if i % 7 == 0 else f"s{i % 5}") for i in range(3000)] + [(None, "a b", None, "s0"), (1, None, None, "s1")]
    docs = docs_of(rows, "1 as target")
    r = mixing.rates(docs).collect()
    assert len(r) == len(rows) and r == mixing.rates(docs).collect() and all(x.copies <= 2 for x in r)
    for s in {x.source for x in r}:
        own = [x for x in r if x.source == s]
        assert sum(x.size * x.copies for x in own) == pytest.approx(own[0].target, rel=0.1)
    out = mixing.mixed(docs).collect()
    assert len(out) == sum(x.copies for x in r) and {x.copy_no for x in out} <= {1, 2} and out[0].target == 1
    assert mixing.rates(docs_of([])).collect() == [] and mixing.mixed(docs_of([])).collect() == []


def test_token_counts_as_the_library(spark, docs_of):
    rnd = random.Random(10)
    alphabet = "ab 'stT\n\t\r\x0b\x0c\x1c\x85 　é日5½²!?<|endoftext|>😀́_-"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|>x<|endoftext|>"), (None, "don't we'll"), (1003, "a" * 50_000), (1003, "a" * 50_000)]
    ref = Tokenizer.from_file(token_count.tokenizer_path())
    want = sorted(((d, len((t or "").encode()), len(ref.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in token_count.count_tokens(docs_of(rows, "1 as n_tokens")).collect()), key=str) == want
    assert token_count.count_tokens(docs_of([])).collect() == []
