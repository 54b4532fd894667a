r"""Languages of texts and of the spans of mixed ones.

Words are runs of letters. A word's score for a language is the log likelihood of its letter trigrams, hashed
into `BUCKETS`, under counts from all training texts of that language. The script of a word, by ranges of
code points, narrows its candidates to languages whose training texts use that script; if none does, all stay.
Viterbi then finds the labelling of the word sequence with the highest sum of scores less `SWITCH` for every
change of language; runs of one label are spans. A text's language is the one with most letters.

The model is languages x BUCKETS numbers, whatever the size of the corpus. Texts are scored where they are read.

Defined results: null texts and texts without a letter are `und` with score 0; rows of a null language are
not learnt from; a null id counts as the empty text for the split; without training rows all is `und`; of
languages with equally many letters the first in code-point order wins; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, held_out, load

BUCKETS, SWITCH, SMOOTH = 1 << 16, 6.0, 0.5
#: Share of a language's letters from which on it is said to use a script.
USES = 0.01
REMEMBERED = 300_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code point of ranges, and the script of each; what lies between is "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
NAMES = ("other", *dict.fromkeys(s for *_, s in SCRIPTS))


def script_of(code: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, 0 for other."""
    low = np.array([s[0] for s in SCRIPTS])
    at = np.searchsorted(low, code, "right") - 1
    inside = (at >= 0) & (code <= np.array([s[1] for s in SCRIPTS])[at])
    return np.where(inside, np.array([NAMES.index(s[2]) for s in SCRIPTS])[at], 0)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, the first of each word, and the words' scripts."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32)
    if not len(words):
        return np.empty(0, np.int64), n, n
    start = np.cumsum(n + 2) - (n + 2)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    c = code.astype(np.uint64)
    h = (c[at] * np.uint64(0x9E3779B97F4A7C15) + c[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 2]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(48)).astype(np.int64), np.cumsum(n) - n, script_of(code[start + 1].astype(np.int64))


def trained(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log likelihoods (language x bucket) and scripts used (language x script) from all rows of a language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in chunks(batches):
            words: dict[str, Counter] = {}
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(t.lower()))
            for lang, count in words.items():
                keys, times = list(count), np.fromiter(count.values(), np.int64, len(count))
                bucket, first, script = word_features(keys)
                n = np.fromiter(map(len, keys), np.int64, len(keys))
                s = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                s[:BUCKETS] += np.bincount(bucket, np.repeat(times, n), BUCKETS).astype(np.int64)
                s[BUCKETS:] += np.bincount(script, times * n, len(NAMES)).astype(np.int64)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "at", "n"])

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = rows.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[[langs.index(x) for x in names] if langs else [], got.column("at").to_numpy()] = got.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS] + SMOOTH, counts[:, BUCKETS:]
    uses = scripts >= USES * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return langs, np.log(grams / grams.sum(axis=1, keepdims=True)), uses


def viterbi(scores: np.ndarray, n: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the words of many texts (n words each, one after another), all texts a step at a time."""
    order = np.argsort(-n, kind="stable")
    first, n = (np.cumsum(n) - n)[order], n[order]
    k = scores.shape[1]
    active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), "right")  # texts with over t words
    best = np.zeros((len(n), k))
    jump = np.zeros(len(scores), np.int16)  # label before a change
    stay = np.zeros((len(scores), k), bool)
    for t, m in enumerate(active.tolist()):
        at = first[:m] + t
        b = best[:m]
        if t:
            top = b.argmax(axis=1)
            high = b[np.arange(m), top] - switch
            jump[at], keep = top, b >= high[:, None]
            stay[at] = keep
            b = np.where(keep, b, high[:, None])
        best[:m] = b + scores[at]
    label = best.argmax(axis=1) if len(n) else np.empty(0, np.int64)
    out = np.zeros(len(scores), np.int64)
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        at = first[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(stay[at, label[:m]], label[:m], jump[at])
    return out


class WordScores:
    """Word -> row of its scores by language, for the words met of late."""

    def __init__(self, likelihood: np.ndarray, uses: np.ndarray):
        self.table, self.uses = np.ascontiguousarray(likelihood.T), uses
        self.row: dict[str, int] = {}
        self.rows = np.empty((0, likelihood.shape[0]))

    def __call__(self, words: list[str]) -> np.ndarray:
        """Scores of each of the words."""
        if len(self.row) > REMEMBERED:
            self.row, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            bucket, first, script = word_features(new)
            s = np.add.reduceat(self.table[bucket], first, axis=0)
            can = self.uses.T[script]
            s[~can & can.any(axis=1, keepdims=True)] = -1e6
            self.row.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, s])
        return self.rows[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


def identified(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (start and end in code points, language) of every row."""
    langs, likelihood, uses = model
    shared = df.sparkSession.sparkContext.broadcast((likelihood, uses))

    def run(batches):
        scores = WordScores(*shared.value)
        for b in chunks(batches, limit=8 << 20):
            texts = b.column("text").to_pylist()
            found = [list(_WORD.finditer(t or "")) for t in texts] if with_spans else None
            words = [[m[0].lower() for m in x] for x in found] if with_spans else [_WORD.findall((t or "").lower()) for t in texts]
            flat = [w for x in words for w in x]
            n = np.fromiter(map(len, words), np.int64, len(words))
            pred, share, spans = ["und"] * len(n), np.zeros(len(n)), [[] for _ in n]
            if flat and langs:
                label = viterbi(scores(flat), n, switch)
                letters = np.fromiter(map(len, flat), np.int64, len(flat))
                doc = np.repeat(np.arange(len(n)), n)
                by = np.bincount(doc * len(langs) + label, letters, len(n) * len(langs)).reshape(len(n), -1)
                top, total = by.argmax(axis=1), by.sum(axis=1)
                share = np.where(total > 0, by[np.arange(len(n)), top] / np.maximum(total, 1), 0.0)
                pred = [langs[i] if x else "und" for i, x in zip(top, total, strict=True)]
                if with_spans:
                    at = 0
                    for i, x in enumerate(found):
                        own = label[at : at + len(x)]
                        at += len(x)
                        cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(x)]
                        spans[i] = [{"start": x[p].start(), "end": x[q - 1].end(), "lang": langs[own[p]]} for p, q in zip(cut, cut[1:], strict=False) if p < q]
            cols = [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(share)]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = trained(docs.where(~held_out(5, 0)))
    rows = identified(docs, model, with_spans=False)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
