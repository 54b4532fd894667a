"""A search index that follows its documents' files, in segments.

    <path>/segments/<id>/{postings,terms,lengths}    an index of some files' documents, never changed
    <path>/manifests/<version>.json                  the files that the index stands for, and which segments hold which

A refresh splits only the documents of files that are new or have changed into terms, as one more segment; files that have
gone or changed are left out of the segments that hold them. Segments with much left out, and all of them when they are
many, are merged from their postings, without reading a document. Readers take the newest manifest, so they go on with
the last index while the next is made.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.search import Index, corpus_stats, postings_of, term_counts
from tidemark.sources import folders

#: Segments from which on all are merged, and the part of a segment's files whose loss makes it be merged.
MANY, LOST = 8, 0.5


@dataclass(frozen=True)
class Segment:
    id: str
    #: all files that it was made from, in the order of their numbers, and those that it still stands for
    files: list[str]
    live: list[str]


@dataclass(frozen=True)
class State:
    version: int = 0
    made: float = 0.0
    #: file -> size and time of change
    files: dict[str, list[int]] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)


def state(spark: SparkSession, path: str) -> State:
    """What the newest manifest says; nothing if there is none."""
    there = [n for n in folders.names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
    if not there:
        return State()
    m = json.loads(folders.read_text(spark, f"{path}/manifests/{there[-1]}"))
    return State(int(there[-1][:-5]), m["made"], m["files"], [Segment(**s) for s in m["segments"]])


def files_of(spark: SparkSession, folder: str, suffix: str = ".parquet") -> dict[str, list[int]]:
    """The files of a folder with their sizes and times of change."""
    p, fs = folders._at(spark, folder)
    found = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix)]
    return {s.getPath().toString(): [s.getLen(), s.getModificationTime()] for s in found}


def _write(postings: DataFrame, lengths: DataFrame, path: str) -> str:
    """Writes a segment, sorted by term inside its files; its id."""
    spark, name = postings.sparkSession, uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    postings.sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
    spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/terms")
    lengths.write.parquet(f"{at}/lengths")
    return name


def _segment(spark: SparkSession, path: str, s: Segment, table: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/segments/{s.id}/{table}")
    if len(s.live) == len(s.files) or table == "terms":
        return df
    live = set(s.live)
    return df.where(F.col("file").isin([i for i, f in enumerate(s.files) if f in live]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _built(spark: SparkSession, path: str, files: list[str], read: Callable[[list[str]], DataFrame], tokens: Column, id_col: str) -> Segment:
    """A segment of files, each document split once."""
    number = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)])
    counts = term_counts(read(files), tokens, F.try_element_at(number, F.col("_metadata.file_path")).alias("file"), F.col(id_col).alias("id"))
    return Segment(_write(postings_of(counts), counts.select("file", "id", "len"), path), files, files)


def _merged(spark: SparkSession, path: str, some: list[Segment]) -> Segment:
    """One segment of what several still stand for, from their postings."""
    files = [f for s in some for f in s.live]
    at = {f: i for i, f in enumerate(files)}

    def renumbered(table: str) -> DataFrame:
        parts = []
        for s in some:
            new = F.array(*[F.lit(at.get(f, -1) if f in s.live else -1) for f in s.files])
            parts.append(_segment(spark, path, s, table).withColumn("file", F.get(new, F.col("file"))))
        return _union(parts)

    return Segment(_write(renumbered("postings"), renumbered("lengths"), path), files, files)


def refresh(spark: SparkSession, path: str, files: dict[str, list[int]], read: Callable[[list[str]], DataFrame], tokens: Column, id_col: str = "id", now: float | None = None) -> State:
    """Makes the index stand for the given files. `read` gives the documents of some of them.

    If another refresh has ended meanwhile, its state counts and this one's work is left.
    """
    old = state(spark, path)
    new = sorted(f for f, stat in files.items() if old.files.get(f) != stat)
    known = {f for f, stat in files.items() if old.files.get(f) == stat}
    if not new and len(known) == len(old.files) and old.version:
        return old
    kept = [Segment(s.id, s.files, [f for f in s.live if f in known]) for s in old.segments]
    kept = [s for s in kept if s.live]
    if new:
        kept.append(_built(spark, path, new, read, tokens, id_col))
    weak = kept if len(kept) >= MANY else [s for s in kept if len(s.live) <= LOST * len(s.files)]
    if weak and (len(weak) > 1 or len(weak[0].live) < len(weak[0].files)):
        kept = [s for s in kept if s not in weak] + [_merged(spark, path, weak)]
    made = State(old.version + 1, time.time() if now is None else now, {**files}, kept)
    text = json.dumps({"made": made.made, "files": made.files, "segments": [vars(s) for s in made.segments]})
    try:
        folders.write_once(spark, f"{path}/manifests/{made.version:09}.json", text)
    except Exception:
        now_there = state(spark, path)
        if now_there.version > old.version:
            return now_there
        raise
    return made


def index(spark: SparkSession, path: str) -> Index:
    """The index of the newest manifest, over all segments."""
    s = state(spark, path)
    if not s.version:
        raise FileNotFoundError(f"no index at {path}")
    if not s.segments:
        empty = lambda kind: spark.createDataFrame([], kind)
        return Index(empty("id long, len int, term string, tf long"), empty("id long, len int"), empty("term string, df long"), 0, 0.0)
    postings = _union([_segment(spark, path, x, "postings") for x in s.segments]).drop("file")
    lengths = _union([_segment(spark, path, x, "lengths") for x in s.segments]).drop("file")
    whole = [_segment(spark, path, x, "terms") for x in s.segments if len(x.live) == len(x.files)]
    part = [_segment(spark, path, x, "postings").groupBy("term").agg(F.count("*").alias("df")) for x in s.segments if len(x.live) < len(x.files)]
    terms = _union(whole + part)
    if len(s.segments) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
    n, avg_len = corpus_stats(lengths).first()
    return Index(postings, lengths, terms, n, avg_len)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes segments and manifests that the last `keep` versions don't need; must not run beside a refresh."""
    there = [n for n in folders.names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
    used = {s["id"] for n in there[-keep:] for s in json.loads(folders.read_text(spark, f"{path}/manifests/{n}"))["segments"]}
    gone = [s for s in folders.names(spark, f"{path}/segments") if s not in used]
    for s in gone:
        folders.delete(spark, f"{path}/segments/{s}")
    for n in there[:-keep]:
        folders.delete(spark, f"{path}/manifests/{n}")
    return len(gone)


class LiveIndex:
    """Gives the index at once and, where it is older than `ttl` seconds, makes the next one meanwhile, one at a time."""

    def __init__(self, spark: SparkSession, path: str, files: Callable[[], dict[str, list[int]]], read, tokens: Column, id_col: str = "id", ttl: float = 300, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.files, self.read, self.tokens, self.id_col, self.ttl, self.clock = spark, path, files, read, tokens, id_col, ttl, clock
        self._lock, self._running, self._checked = threading.Lock(), None, 0.0
        self.error: Exception | None = None

    def _refresh(self) -> None:
        try:
            refresh(self.spark, self.path, self.files(), self.read, self.tokens, self.id_col, self.clock())
            self.error, self._checked = None, self.clock()
        except Exception as e:  # the last index goes on; the error is kept for whoever asks
            self.error = e

    def get(self) -> Index:
        """The newest index there is; only the very first call waits for one to be made."""
        there = state(self.spark, self.path)
        with self._lock:
            if self.clock() - max(there.made, self._checked) > self.ttl and (self._running is None or not self._running.is_alive()):
                self._running = threading.Thread(target=self._refresh, daemon=True)
                self._running.start()
            running = self._running
        if not there.version and running is not None:
            running.join()
            if self.error is not None:
                raise self.error
        return index(self.spark, self.path)

    def wait(self) -> None:
        """Until a refresh that runs has ended."""
        running = self._running
        if running is not None:
            running.join()
