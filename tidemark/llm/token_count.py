"""Token counts by byte-pair merging, without token ids.

The vocabulary file's merges are read on the driver (a few MB, whatever the corpus) and broadcast. A task
cuts each text into the pieces that the byte-level splitter makes and counts a piece once: its bytes form a
linked list, a heap gives the adjacent pair of lowest rank (leftmost first), and the count is the number of
bytes less the number of merges.

Defined results: a null or empty text has 0 tokens; special strings inside a text count as one token each;
a piece of any length takes n log n steps; repeated rows and ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load

#: Fixed value: the split pattern of the byte-level splitter.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker remembers in each of two generations.
REMEMBERED = 250_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_merges(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The merges in rank order and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return merges, [t["content"] for t in spec.get("added_tokens") or () if t.get("special")]


def n_symbols(letters: str, ranks: dict[str, dict[str, int]]) -> int:
    """Symbols that are left of a piece when no adjacent pair has a rank."""
    n = len(letters)
    if n < 2:
        return n
    sym: list[str | None] = list(letters)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none: dict[str, int] = {}
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(sym[i], none).get(sym[i + 1])) is not None]
    heapify(heap)
    left = n
    while heap:
        r, i = heappop(heap)
        a = sym[i]
        j = after[i]
        if a is None or j >= n or ranks.get(a, none).get(sym[j]) != r:
            continue
        sym[i], sym[j] = a + sym[j], None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(sym[i], none).get(sym[k])) is not None:
                heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := ranks.get(sym[k], none).get(sym[i])) is not None:
            heappush(heap, (r, k))
    return left


class PieceCounts(dict):
    """Piece -> number of tokens, for the pieces met of late."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.ranks: dict[str, dict[str, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.ranks.setdefault(a, {}).setdefault(b, r)
        self.letters = byte_letters()
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if (n := self.older.get(piece)) is None:
            n = n_symbols("".join([self.letters[b] for b in piece.encode()]), self.ranks)
        if len(piece) <= 64:
            self[piece] = n
        return n


class Counter:
    """Tokens of texts."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str]):
        self.pieces = PieceCounts(merges)
        self.find = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str) -> int:
        of = self.pieces.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(of, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(of, self.find(p))) for p in parts)


_counters: dict[tuple[str, int], Counter] = {}


def count_tokens(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    path = tokenizer or tokenizer_path()
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(read_merges(path))

    def run(batches):
        key = (path, spec.id if hasattr(spec, "id") else 0)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*spec.value)
        count = _counters[key]
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(load(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
