"""The index as tables, and its incremental build.

A build writes every table below a new version directory and then turns one small pointer file to
it, so readers never see half an index. Files are compared by content hash: only new and changed
ones are parsed and embedded, chunks of the others are carried over.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions.parsing import MAX_CHUNK_CHARS, parse_files
from lodestrata.functions.terms import hashed_rows, term_rows
from lodestrata.functions.text import TERM_TIMES, embedded_text
from lodestrata.operators import dense
from lodestrata.operators.resolve import build_graph
from lodestrata.sources.tree import INDEX_DIR, read_tree
from lodestrata.storage import drop_below, is_local, materialize, read_text, replace_text, scratch

TABLES = {"files": schemas.FILES, "chunks": schemas.CHUNKS, "symbols": schemas.SYMBOLS, "nodes": schemas.NODES, "edges": schemas.EDGES, "postings": schemas.POSTINGS, "lengths": schemas.LENGTHS, "vectors": schemas.VECTORS}
EMBEDDER = f"hashing-{dense.DIM}"


@dataclass(frozen=True)
class IndexOptions:
    embedder: str = "hash"
    max_chunk_chars: int = MAX_CHUNK_CHARS
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()


@dataclass
class IndexTables:
    """An index's tables, read lazily."""

    spark: SparkSession
    path: str
    meta: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexTables:
        pointer = read_text(spark, f"{path}/CURRENT")
        if pointer is None:
            raise FileNotFoundError(f"no index at {path}; build one first")
        meta = json.loads(pointer)
        return cls(spark, f"{path}/{meta['version']}", meta)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def export_jsonl(self, name: str, to: str) -> None:
        """A table as one JSON object a row."""
        self.table(name).write.mode("overwrite").json(to)


def make_embedder(spec: str | None):
    """(rows with ids and ``embed_text``) -> (ids, buckets, weights). Only feature hashing is built in."""
    if not spec or spec == "hash" or spec.startswith("hashing"):
        return EMBEDDER, lambda texts, *ids: hashed_rows(texts, *ids, text="embed_text")
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise ValueError(f"embedder {spec!r} needs the sentence-transformers package") from e
    from lodestrata.sources.neural import neural_vectors

    model = spec.removeprefix("st:")
    return f"st:{model}", lambda texts, *ids: neural_vectors(texts, model, *ids)


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, sha1) twice -> (file_path, status): unchanged, changed, added or removed."""
    a, b = old.select("file_path", F.col("sha1").alias("was"), F.lit(True).alias("in_old")), new.select("file_path", F.col("sha1").alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, "file_path", "full_outer").select("file_path", status.alias("status"))


STATUSES = ("added", "changed", "removed", "unchanged")


def counted_status(old: DataFrame, new: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``diff_files`` as a table, and how many files have each status, counted while it is written."""
    seen = Observation()
    of = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    status = materialize(diff_files(old, new).observe(seen, *of), "status")
    return status, seen.get


def with_order(rows: DataFrame) -> DataFrame:
    """``ord`` over (file_path, place): a prefix sum over files in two levels.

    Files, one row each, are range-partitioned by path; sums run within each range, and only one row
    for each range goes into the sum over all ranges.
    """
    counts = rows.groupBy("file_path").agg(F.count("*").alias("n"))
    ranges = materialize(counts.repartitionByRange("file_path").withColumn("part", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ranges.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(W.orderBy("part")).alias("base"))
    offsets = ranges.withColumn("within", before(W.partitionBy("part").orderBy("file_path"))).join(parts, "part").select("file_path", (F.col("base") + F.col("within")).alias("offset"))
    return rows.join(offsets, "file_path").withColumn("ord", (F.col("offset") + F.col("place")).cast("long")).drop("offset", "place")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``ord`` over all rows in order of ``keys``, from 0: places within each range, and a sum over ranges.

    A key that many rows share, as the first of several, is spread over as many ranges as it fills.
    """
    dealt = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition.
    bases = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("base"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1
    return dealt.withColumn("place", place).join(bases, "part").withColumn("ord", (F.col("base") + F.col("place")).cast("long")).drop("part", "base", "place")


def _unnested(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select(F.posexplode(column).alias("place", "row")).select("place", "row.*")


def _carried(rows: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Rows of unchanged files, numbered from 0 within each."""
    kept = rows.join(unchanged, "file_path", "left_semi")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("file_path").orderBy("ord")) - 1).drop("ord")


def index_path(spark: SparkSession, root: str, path: str | None = None) -> str:
    """Where a tree's index is: a path of any file system that Spark reads, or else the tree's own folder, on a local master only."""
    if path is None and not is_local(spark):
        raise ValueError("name a folder for the index that all executors share")
    path = path or os.path.join(os.path.abspath(root), INDEX_DIR)
    return path if ":" in path.split("/")[0] or not is_local(spark) else f"file://{os.path.abspath(path)}"


def build_index(spark: SparkSession, root: str, path: str | None = None, full: bool = False, options: IndexOptions = IndexOptions()) -> dict:
    """Build or refresh the index of a tree; returns counts of files indexed, skipped and removed, of chunks and symbols, and seconds."""
    began = time.time()
    stats = build_tables(spark, read_tree(spark, root, options.exclude, options.include), index_path(spark, root, path), full, options, os.path.abspath(root))
    return stats | {"seconds": round(time.time() - began, 3)}


def build_tables(spark: SparkSession, files: DataFrame, path: str, full: bool = False, options: IndexOptions = IndexOptions(), root: str | None = None) -> dict:
    """The same for a table of files: (file_path, language, content, sha1), file paths not repeated."""
    with scratch(spark):
        return _build(spark, files, path, full, options, root)


def _build(spark: SparkSession, files: DataFrame, path: str, full: bool, options: IndexOptions, root: str | None) -> dict:
    began = time.time()
    embedder, embed = make_embedder(options.embedder)
    try:
        old = None if full else IndexTables.open(spark, path)
    except FileNotFoundError:
        old = None
    # Contents are read once more where they are parsed; a file that changes in between is found the next time.
    read = materialize(files.select("file_path", "language", "sha1"), "tree")
    known = old.table("files").select("file_path", "sha1") if old else spark.createDataFrame([], "file_path string, sha1 string")
    status, count = counted_status(known, read)
    # Unreadable files stay listed, have a node, and are neither parsed nor carried over.
    changed = files.select("file_path", "language", "content").where(F.col("content").isNotNull())
    if old:
        changed = changed.join(status.where("status in ('added', 'changed')"), "file_path", "left_semi")
    unchanged = status.where("status = 'unchanged'").select("file_path")
    parsed = materialize(parse_files(changed, options.max_chunk_chars), "parsed")

    version = f"v-{uuid.uuid4().hex}"
    base = f"{path}/{version}"
    #: Rows of each table, counted while they are written.
    written: dict[str, int] = {}

    def save(name: str, df: DataFrame, *sort: str) -> DataFrame:
        schema, seen = TABLES[name], Observation()
        rows = (df.sortWithinPartitions(*sort) if sort else df).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{base}/{name}")
        written[name] = seen.get["n"]
        return spark.read.schema(schema).parquet(f"{base}/{name}")

    chunks, symbols, imports = _unnested(parsed, "chunks"), _unnested(parsed, "symbols"), parsed.select("file_path", "imports")
    if old:
        chunks = chunks.unionByName(_carried(old.table("chunks"), unchanged))
        symbols = symbols.unionByName(_carried(old.table("symbols"), unchanged))
        imports = imports.unionByName(old.table("files").join(unchanged, "file_path", "left_semi").select("file_path", "imports"))
    files = save("files", read.select("file_path", "language", "sha1").join(imports, "file_path", "left"))
    chunks = save("chunks", with_order(chunks), "ord")
    symbols = save("symbols", with_order(symbols), "ord")
    nodes, edges = build_graph(files, symbols)
    save("nodes", nodes)
    save("edges", edges, "edge_type", "src")

    terms = materialize(term_rows(chunks, "chunk_id", "ord", times=TERM_TIMES), "terms")
    # Sorted by term, so that a query's terms prune row groups.
    postings = terms.select("ord", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    save("postings", postings.repartitionByRange("term"), "term")
    save("lengths", terms.select("chunk_id", "ord", "dl"))

    texts = chunks.select("chunk_id", "ord", "file_path", embedded_text(F.col("file_path"), F.col("symbol"), F.col("docstring"), F.col("text")).alias("embed_text"))
    if old and old.meta.get("embedder") == embedder != EMBEDDER:
        # A model's vectors are carried over; to hash a text again costs less than to find its vector.
        reusable = texts.join(unchanged, "file_path", "left_semi").select("chunk_id", "ord")
        kept = old.table("vectors").select("chunk_id", "bucket", "w").join(reusable, "chunk_id")
        fresh = texts.join(unchanged, "file_path", "left_anti")
        vectors = dense.long_form(embed(fresh, "chunk_id", "ord"), "chunk_id", "ord").unionByName(kept.select("chunk_id", "ord", "bucket", "w"))
    else:
        vectors = dense.long_form(embed(texts, "chunk_id", "ord"), "chunk_id", "ord")
    save("vectors", vectors, "bucket")

    stats = {
        "files_indexed": count["added"] + count["changed"],
        "files_skipped": count["unchanged"],
        "files_removed": count["removed"],
        "chunks": written["chunks"],
        "symbols": written["symbols"],
        "seconds": round(time.time() - began, 3),
    }
    meta = {"version": version, "root": root, "embedder": embedder, "updated_at": int(time.time()), "stats": stats}
    replace_text(spark, f"{path}/CURRENT", json.dumps(meta))
    # The version before stays for readers that opened it; older ones go.
    drop_below(spark, path, "v-", {version} | ({old.meta["version"]} if old else set()))
    return stats
