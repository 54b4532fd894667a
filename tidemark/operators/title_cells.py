"""Entries (words of a title and of a venue) of one cell compared with each other: numpy on Arrow tables of a bounded size.

Two titles that share `need` of their words share one of their first words in any common order, rare words first. Of the two, the
shorter one's first n - ceil(n * 2 * need / (1 + need)) + 1 words are enough, of the longer one's the first n - ceil(n * need) + 1.
Pairs that meet so are dropped by size, place and a parity sketch where they surely are not alike; the rest is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows worked on at once.
CHUNK = 1 << 18
#: Bits of a sketch, in words of 64.
SKETCH = 8


class Needs(NamedTuple):
    """Similarity of titles alike by themselves, and of venues and titles alike together."""

    alone: float
    venue: float
    with_venue: float


class Words:
    """Words of all rows as numbers, rare ones first in each row."""

    def __init__(self, column: pa.Array):
        lists = pc.split_pattern(column, " ")
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        self.size = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        codes = flat.filter(pc.not_equal(flat, "")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        count = np.bincount(codes)
        self.n = max(len(count), 1)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.start = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.keys = np.sort(self.row * self.n + rank[codes])
        self.word = self.keys - self.row * self.n
        self.at = np.arange(len(self.row)) - self.start[self.row]

    def first(self, cut: np.ndarray) -> np.ndarray:
        """Places of the first words of each row."""
        return np.flatnonzero(self.at < cut[self.row])

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words each two rows share."""
        n = self.size[x]
        needle = np.repeat(y * self.n, n) + self.word[_ranges(self.start[x], n)]
        found = self.keys[np.minimum(np.searchsorted(self.keys, needle), len(self.keys) - 1)] == needle
        upto = np.concatenate([[0], np.cumsum(found)])
        end = np.cumsum(n)
        return upto[end] - upto[end - n]

    def sketches(self) -> np.ndarray:
        """A bit for each group of words, set if the row has an odd number of them: two rows differ in as many words as in bits, at least."""
        out = np.zeros((len(self.size), SKETCH), np.uint64)
        bit = (self.word * 0x9E3779B1 >> 7) % (SKETCH * 64)
        np.bitwise_xor.at(out, (self.row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, n numbers."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _slices(n: np.ndarray, most: int = 0) -> Iterator[slice]:
    """Slices of items that have `most` rows together, or little more than their last one's."""
    if len(n):
        part = (np.cumsum(n) - n) // (most or CHUNK)
        ends = np.flatnonzero(np.diff(part)) + 1
        yield from map(slice, [0, *ends.tolist()], [*ends.tolist(), len(n)])


def _least(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(n * share - 1e-9).astype(np.int64)


def _elements(w: Words, v: Words, cut: np.ndarray, rows: np.ndarray, venue: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and key of first words; if a similarity of venues is given, with each of the first words of the venue."""
    at = w.first(np.where(rows, cut, 0))
    if not venue:
        return w.row[at], w.at[at], w.word[at]
    n = np.where(v.size > 0, v.size - _least(v.size, venue) + 1, 0)[w.row[at]]
    also = _ranges(v.start[w.row[at]], n)
    at = np.repeat(at, n)
    return w.row[at], w.at[at], v.word[also] * w.n + w.word[at]


def _met(w: Words, v: Words, sketch: np.ndarray, need: float, venue: float, short: np.ndarray, long: np.ndarray, strict: bool, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a short and a long row (of rows marked so) that may be alike, each once. strict: the short one is shorter; once: of equals the first is the short one."""
    s, rows = w.size, len(w.size)
    x, x_at, x_key = _elements(w, v, s - _least(s, 2 * need / (1 + need)) + 1, short, venue)
    y, y_at, y_key = _elements(w, v, s - _least(s, need) + 1, long, venue)
    keys, x_key = np.unique(x_key, return_inverse=True)
    if not len(keys):
        return
    at = np.minimum(np.searchsorted(keys, y_key), len(keys) - 1)
    known = keys[at] == y_key
    y, y_at, at = y[known], y_at[known], at[known]
    step = s.max() + 1
    by = x_key * step + s[x]
    order = np.argsort(by, kind="stable")
    by, x, x_at = by[order], x[order], x_at[order]
    lo = np.searchsorted(by, at * step + _least(s[y], need))
    n = np.maximum(np.searchsorted(by, at * step + s[y] - strict, side="right") - lo, 0)
    heads = np.flatnonzero(np.diff(y, prepend=-1))
    ends = [*heads.tolist(), len(y)]
    for part in _slices(np.add.reduceat(n, heads) if len(heads) else heads):  # all that a long row meets is in one part
        part = slice(ends[part.start], ends[part.stop])
        near = _ranges(lo[part], n[part])
        a, b = x[near], np.repeat(y[part], n[part])
        rest = np.minimum(s[a] - x_at[near], s[b] - np.repeat(y_at[part], n[part]))
        ok = rest >= need / (1 + need) * (s[a] + s[b]) - 1e-9
        if once:
            ok &= (s[a] < s[b]) | (a < b)
        pair = np.unique(b[ok] * rows + a[ok])
        a, b = pair % rows, pair // rows
        ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= (1 - need) / (1 + need) * (s[a] + s[b]) + 1e-9
        yield a[ok], b[ok]


def alike(table: pa.Table, within: bool, needs: Needs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x and y that look alike, with the scores of titles and venues; each pair once. Within: of all rows; else x of side 0 and y of side 1."""
    w, v = (Words(table[c].combine_chunks()) for c in ("t", "v"))
    sketch, side = w.sketches(), table["side"].to_numpy()
    every = np.ones(len(side), bool)
    ways = [(every, every, False, True)] if within else [(side == 0, side == 1, False, False), (side == 1, side == 0, True, False)]
    for need, venue in ((needs.alone, 0.0), (needs.with_venue, needs.venue)):
        for short, long, strict, once in ways:
            for met in _met(w, v, sketch, need, venue, short, long, strict, once):
                for part in _slices(w.size[met[0]] + v.size[met[0]]):
                    x, y = (m[part] for m in met)
                    both = w.shared(x, y)
                    title = both / (w.size[x] + w.size[y] - both)
                    ok = (title >= need) & (title < needs.alone) if venue else title >= need
                    x, y, title = x[ok], y[ok], title[ok]
                    both = v.shared(x, y) if len(v.keys) else np.zeros(len(x), np.int64)
                    score = np.where((v.size[x] > 0) & (v.size[y] > 0), both / np.maximum(v.size[x] + v.size[y] - both, 1), 0.0)
                    ok = score >= venue
                    x, y = (y, x) if strict else (x, y)
                    yield x[ok], y[ok], title[ok], score[ok]


def links(table: pa.Table, own: bool, within: bool, needs: Needs) -> Iterator[pa.RecordBatch]:
    """id of a member, title_score and venue_score of an entry alike, and that entry's earlier members. own: both sides are of the same rows."""
    members = table["members"].combine_chunks()
    n = pc.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64)
    start, entry = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    rank = pc.rank(members.flatten().field("ord"), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((rank, entry))
    rows, rank = members.flatten().take(pa.array(order)), rank[order]
    step = rank.max() + 1
    places = entry * step + rank

    def expanded(x: np.ndarray, y: np.ndarray, title: np.ndarray, venue: np.ndarray) -> Iterator[pa.RecordBatch]:
        for some in _slices(n[x]):
            new = _ranges(start[x[some]], n[x[some]])
            pair = np.repeat(np.arange(len(x))[some], n[x[some]])
            first = start[y[pair]]
            k = np.searchsorted(places, y[pair] * step + rank[new]) - first  # members earlier than the new one
            new, pair, first, k = (c[k > 0] for c in (new, pair, first, k))
            for part in _slices(k):
                others = rows.take(pa.array(_ranges(first[part], k[part])))
                ends = pa.array(np.concatenate([[0], np.cumsum(k[part])]).astype(np.int32))
                p = pair[part]
                yield pa.RecordBatch.from_arrays([rows.field("id").take(pa.array(new[part])), pa.array(title[p]), pa.array(venue[p]), pa.ListArray.from_arrays(ends, others)], names=["id", "title_score", "venue_score", "others"])

    if own and within:
        x = np.flatnonzero(n > 1)
        venue = pc.not_equal(table["v"], "").to_numpy().astype(float)
        yield from expanded(x, x, np.ones(len(x)), venue[x])
    for x, y, title, venue in alike(table, within, needs):
        yield from expanded(x, y, title, venue)
        if own:
            yield from expanded(y, x, title, venue)


def firsts(table: pa.Table, own: bool, within: bool, needs: Needs) -> Iterator[pa.RecordBatch]:
    """no, ord, id of each entry: the first of those alike; where both sides are of the same rows, only if it is before its own."""
    ords, ids = table["members"].combine_chunks().flatten()
    order = pc.sort_indices(pa.table({"ord": ords, "id": ids}), sort_keys=[("ord", "ascending"), ("id", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = rank.copy() if own else np.full(len(order), len(order))
    for x, y, _, _ in alike(table, within, needs):
        np.minimum.at(best, x, rank[y])
        if own:
            np.minimum.at(best, y, rank[x])
    at = np.flatnonzero(best < (rank if own else len(order)))
    first = pa.array(order[best[at]].astype(np.int64))
    yield pa.RecordBatch.from_arrays([table["no"].combine_chunks().take(pa.array(at)), ords.take(first), ids.take(first)], names=["no", "ord", "id"])
