import itertools
import random

import numpy as np

from tidemark.llm import language_id
from tidemark.llm.common import load


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 6, 30)
    scores = rng.normal(0, 3, (int(n.sum()), 3))
    got = language_id.viterbi(scores, n, 2.0)
    at = 0
    for k in n.tolist():
        s = scores[at : at + k]
        value = lambda y: sum(s[i, c] for i, c in enumerate(y)) - 2.0 * sum(a != b for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
        if k:
            best = max(value(y) for y in itertools.product(range(3), repeat=k))
            assert np.isclose(value(got[at : at + k].tolist()), best)
        at += k


def test_held_out_accuracy(spark, sf_dir):
    rows = language_id.query(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == load(spark, sf_dir, "documents").count()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_scripts_and_odd_texts(spark, docs_of):
    rnd = random.Random(2)
    vocabulary = {"en": "the cat with hat this that think where", "es": "niño está mañana señor según corazón", "ru": "привет мир как дела хорошо очень"}
    say = lambda lang, k: " ".join(rnd.choice(vocabulary[lang].split()) for _ in range(k))
    train = docs_of([(i, say(lang, 60), lang, "s") for i, lang in enumerate(["en", "es", "ru"] * 8)] + [(99, "x", None, None), (98, None, "en", None)])
    model = language_id.trained(train)
    en, es, ru = say("en", 20), say("es", 25), say("ru", 15)
    rows = [(1, f"{en} 123 {es}. {ru}!"), (2, None), (3, " 12 ½ ² !!"), (4, ""), (None, ru), (5, "z" * 50_000), (6, es), (6, es)]
    got = {r.doc_id: r for r in language_id.identified(docs_of(rows, "1 as score"), model).collect()}
    assert [(s.lang, rows[0][1][s.start : s.end]) for s in got[1].spans] == [("en", en), ("es", es), ("ru", ru)]
    assert got[1].lang_pred == "es" and got[None].lang_pred == "ru" and got[6].lang_pred == "es" and got[6].score == 1.0
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (2, 3, 4)] == [("und", 0.0, [])] * 3
    nothing = language_id.trained(train.limit(0))
    assert {r.lang_pred for r in language_id.identified(docs_of(rows), nothing).collect()} == {"und"}
    assert language_id.identified(docs_of([]), model).collect() == []
