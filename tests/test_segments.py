"""An index of segments reads as a full build does, and writes what changed."""

import pytest
from pyspark.sql import functions as F

from lodestrata.engine import CodeIndex, SegmentedIndex
from lodestrata.plans.code import _functions, _texts
from lodestrata.sources import segments
from lodestrata.sources.index import build_tables
from lodestrata.sources.segments import SCHEMAS, SegmentStore


def listing(spark, files):
    rows = spark.createDataFrame(list(files.items()), "file_path string, content string")
    return rows.select("file_path", F.when(F.col("file_path").endswith(".py"), "python").otherwise("text").alias("language"), "content", F.sha1("content").alias("sha1"))


FILES = {
    "a/load.py": 'def load(x):\n    """Read the user table."""\n    return parse(x)\n',
    "a/parse.py": "def parse(x):\n    return x\n\n\nclass Base:\n    pass\n",
    "b/kind.py": "from a.parse import Base\n\n\nclass Kind(Base):\n    def run(self):\n        return load(1)\n",
    "notes.txt": "how to load the user table\n\nand parse it\n",
    "empty.txt": "",
}
ASKED = [(1, "load user table"), (2, "parse"), (3, "nothing here matches zzz"), (4, "")]


def state(index):
    """All that a reader sees, without numbers that builds give."""
    spark = index.spark
    queries = spark.createDataFrame(ASKED, "query_id int, text string")
    seen = {name: sorted(map(repr, index.table(name).select(*cols).collect())) for name, cols in {"files": ("file_path", "sha1", "imports"), "chunks": ("chunk_id", "file_path", "text", "symbol"), "symbols": ("file_path", "qualified_name", "calls"), "nodes": ("node_id", "line"), "edges": ("src", "dst", "edge_type")}.items()}
    hits = index.search_many(queries, 5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "sources")
    order = [r.chunk_id for r in index.table("chunks").orderBy("ord").select("chunk_id").collect()]
    return seen | {"hits": sorted(map(repr, hits.collect())), "order": order, "callers": index.callers("load").collect(), "found": [r.qualified_name for r in index.find_symbol("pars").collect()]}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def full(spark, files, tmp_path, name="full"):
    where = f"file://{tmp_path}/{name}"
    build_tables(spark, listing(spark, files), where)
    return CodeIndex(spark, where, where)


def written(store, seg):
    return {name: {r.file_path for r in store.stored(name, seg).select("file_path").collect()} for name in SCHEMAS if "file_path" in SCHEMAS[name].names}


def test_changes_write_only_themselves_and_read_as_a_full_build(spark, path, tmp_path):
    store, stats = SegmentStore.create(spark, path).refresh(listing(spark, FILES))
    assert stats["files_indexed"] == 5 and stats["segment"] == 1 and stats["tombstones"] == 0
    assert state(SegmentedIndex(store)) == state(full(spark, FILES, tmp_path))

    later = FILES | {"a/parse.py": "def parse(x):\n    return load(x)\n", "c/new.py": "def fresh():\n    return parse(2)\n"}
    del later["notes.txt"]
    store, stats = SegmentStore.open(spark, path).refresh(listing(spark, later))
    assert (stats["files_indexed"], stats["files_skipped"], stats["files_removed"], stats["tombstones"]) == (2, 3, 1, 2)
    assert all(own <= {"a/parse.py", "c/new.py"} for own in written(store, stats["segment"]).values())
    assert state(SegmentedIndex(store)) == state(full(spark, later, tmp_path, "later"))

    same, stats = store.refresh(listing(spark, later))
    assert stats["segment"] is None and same.meta["segments"] == store.meta["segments"]

    # A change that names its files looks at no other.
    store, stats = same.apply(listing(spark, {"c/new.py": "def fresh():\n    return load(3)\n"}), spark.createDataFrame([("empty.txt",), ("never.txt",)], "file_path string"))
    assert stats["files"] == 1 and stats["tombstones"] == 2
    later = {k: v for k, v in later.items() if k != "empty.txt"} | {"c/new.py": "def fresh():\n    return load(3)\n"}
    seen = state(SegmentedIndex(store))
    assert seen == state(full(spark, later, tmp_path, "last"))

    merged = store.merge()
    assert len(merged.meta["segments"]) == 1 and not merged.meta["tombstones"]
    assert merged.vacuum() > 0
    assert state(SegmentedIndex(SegmentStore.open(spark, path))) == seen


def test_segments_of_a_size_are_merged(spark, path, monkeypatch):
    monkeypatch.setattr(segments, "FACTOR", 3)
    store = SegmentStore.create(spark, path)
    for k in range(7):
        store, _ = store.apply(listing(spark, {f"f{k}.txt": f"text number {k}"}))
    # Each third of one size becomes one of the next.
    assert sorted(s["files"] for s in store.meta["segments"]) == [1, 3, 3]
    assert sorted(r.file_path for r in store.rows("files").collect()) == [f"f{k}.txt" for k in range(7)]
    vectors = store.rows("vectors")
    assert vectors.count() == 7
    # Files that change again and again don't pile up.
    for k in range(6):
        store, _ = store.apply(listing(spark, {f"f{k}.txt": "changed"}))
    assert store.rows("files").count() == 7
    assert store.stored("files").count() < 14 and 2 * sum(t["files"] for t in store.meta["tombstones"]) <= sum(s["files"] for s in store.meta["segments"])


def test_vectors_are_carried_over(spark, path, monkeypatch):
    """A merge and a change of another file embed nothing again."""
    store, _ = SegmentStore.create(spark, path).refresh(listing(spark, FILES))
    embedded = []
    own = segments.make_embedder
    monkeypatch.setattr(segments, "make_embedder", lambda spec: (own(spec)[0], lambda texts, *ids: embedded.extend(r.file_path for r in texts.select("file_path").collect()) or own(spec)[1](texts, *ids)))
    store, _ = store.refresh(listing(spark, FILES | {"new.txt": "a new text"}))
    assert set(embedded) == {"new.txt"}
    embedded.clear()
    assert store.merge().rows("vectors").count() == store.rows("chunks").count() and not embedded


def test_empty_index_and_missing_one(spark, path):
    with pytest.raises(FileNotFoundError):
        SegmentStore.open(spark, path)
    index = SegmentedIndex(SegmentStore.create(spark, path))
    assert index.search_many(spark.createDataFrame(ASKED, "query_id int, text string")).count() == 0
    store, stats = index.tables.refresh(listing(spark, {"u.txt": None}))
    assert stats["files"] == 1 and store.rows("chunks").count() == 0
    gone, stats = store.refresh(listing(spark, {"u.txt": None}).limit(0))
    assert stats["files_removed"] == 1 and gone.rows("files").count() == 0


def test_one_changed_document(spark, sf_dir, path):
    """Over the given documents: as a text and a function each."""
    files = _texts(spark, sf_dir).unionByName(_functions(spark, sf_dir)).withColumn("sha1", F.sha1("content"))
    store, _ = SegmentStore.create(spark, path).refresh(files)
    changed = files.withColumn("content", F.when(F.col("file_path") == "texts/7.txt", "another text").otherwise(F.col("content"))).withColumn("sha1", F.sha1("content"))
    store, stats = store.refresh(changed)
    assert (stats["files_indexed"], stats["tombstones"]) == (1, 1)
    assert all(own == {"texts/7.txt"} for name, own in written(store, stats["segment"]).items() if name != "symbols")
    assert store.stored("postings", stats["segment"]).count() == 4


def test_builds_count_while_they_write(spark, path, tmp_path, monkeypatch):
    """No job only counts."""

    def refuse(*_):
        raise AssertionError("a counting job")

    monkeypatch.setattr(type(spark.range(1)), "count", refuse)
    stats = build_tables(spark, listing(spark, FILES), f"file://{tmp_path}/counted")
    assert (stats["files_indexed"], stats["chunks"], stats["symbols"]) == (5, 6, 5)
    _, stats = SegmentStore.create(spark, path).refresh(listing(spark, FILES))
    assert (stats["files"], stats["chunks"], stats["symbols"]) == (5, 6, 5)
