import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, segments


class Folder:
    """Documents in files, and which of them were read since the last look."""

    def __init__(self, spark, root):
        self.spark, self.root, self.reads = spark, f"file://{root}/docs", []

    def put(self, name, *rows):
        self.spark.createDataFrame(rows, "id long, title string, text string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def files(self):
        names = [n for n in segments.folders.names(self.spark, self.root)]
        return {f: s for n in names for f, s in segments.files_of(self.spark, f"{self.root}/{n}").items()}

    def read(self, files):
        self.reads.append(sorted(f.split("/docs/")[1].split("/")[0] for f in files))
        return self.spark.read.schema("id long, title string, text string").parquet(*files)


def tokens():
    return search.document_tokens(F.col("title"), F.col("text"))


@pytest.fixture
def docs(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.path = f"file://{tmp_path}/index"
    f.refresh = lambda **kw: segments.refresh(spark, f.path, f.files(), f.read, tokens(), **kw)
    f.put("a", (1, "wine walk", "hall"), (2, "jazz", "night wine"))
    f.put("b", (3, "market", "square wine"))
    return f


def tables(index):
    rows = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    return rows(index.postings), rows(index.lengths), rows(index.terms), index.n, index.avg_len


def fresh(docs):
    """The index as it is made from all documents at once."""
    all_ = docs.spark.read.schema("id long, title string, text string").parquet(*docs.files())
    return tables(search.build_index(all_, tokens()))


def test_only_new_and_changed_files_are_split(spark, docs):
    first = docs.refresh()
    assert first.version == 1 and docs.reads == [["a", "b"]] and tables(segments.index(spark, docs.path)) == fresh(docs)
    assert docs.refresh() == first and len(docs.reads) == 1  # nothing to do
    docs.put("c", (4, "opera", "wine hall"))
    second = docs.refresh()
    assert docs.reads[1:] == [["c"]] and len(second.segments) == 2 and tables(segments.index(spark, docs.path)) == fresh(docs)
    docs.put("a", (1, "wine walk", "new place"))
    docs.refresh()
    assert docs.reads[2:] == [["a"]] and tables(segments.index(spark, docs.path)) == fresh(docs)
    segments.folders.delete(spark, f"{docs.root}/b")
    third = docs.refresh()
    assert len(docs.reads) == 3 and tables(segments.index(spark, docs.path)) == fresh(docs)
    assert all(s.live for s in third.segments)
    n = len(segments.folders.names(spark, f"{docs.path}/segments"))
    assert segments.vacuum(spark, docs.path, keep=1) == n - len(third.segments)
    assert tables(segments.index(spark, docs.path)) == fresh(docs)


def test_many_segments_are_merged_without_reading(spark, docs):
    docs.refresh()
    for i in range(segments.MANY):
        docs.put(f"n{i}", (10 + i, f"title{i}", "wine"))
        now = docs.refresh()
    assert len(now.segments) < segments.MANY and docs.reads[1:] == [[f"n{i}"] for i in range(segments.MANY)]
    assert tables(segments.index(spark, docs.path)) == fresh(docs)


def test_no_documents_and_no_index(spark, docs):
    with pytest.raises(FileNotFoundError):
        segments.index(spark, docs.path)
    segments.refresh(spark, docs.path, {}, docs.read, tokens())
    empty = segments.index(spark, docs.path)
    assert (empty.n, empty.avg_len, empty.terms.count()) == (0, 0.0, 0)


def test_two_refreshes_at_once(spark, docs):
    """The one that ends last gives way; its segment is unused."""
    inner = []

    def read(files):
        if not inner:
            inner.append(docs.refresh())
        return docs.read(files)

    got = segments.refresh(spark, docs.path, docs.files(), read, tokens())
    assert got.version == 1 and tables(segments.index(spark, docs.path)) == fresh(docs)


def test_live_index_serves_the_old_one_meanwhile(spark, docs):
    now = [1000.0]
    live = segments.LiveIndex(spark, docs.path, docs.files, docs.read, tokens(), ttl=300, clock=lambda: now[0])
    assert live.get().n == 3
    docs.put("c", (4, "opera", "wine"))
    now[0] += 200
    assert live.get().n == 3 and len(docs.reads) == 1  # young enough
    now[0] += 200
    live._lock.acquire()  # as if a call were just deciding
    live._lock.release()
    assert live.get().n in (3, 4)  # never waits
    live.wait()
    assert live.get().n == 4 and docs.reads[1:] == [["c"]]
    now[0] += 400
    live.read = None  # a refresh that fails leaves the last index
    docs.put("d", (5, "x", "y"))
    assert live.get().n == 4
    live.wait()
    assert live.error is not None and live.get().n == 4
