"""The index as immutable segments: a change writes rows of what changed, and nothing else.

A segment holds all tables of the files that one change brought, below ``<table>/seg=<number>``; it is
never written again. A file that is changed or removed gets a tombstone, which says that its rows in
segments before a number don't count. A manifest names the segments and tombstones that make up the
index, and is turned to the next state in one step, so readers see a whole state or the one before.

Segments are merged when ``FACTOR`` of about the same size have come together, so a row is written
again once for each power of ``FACTOR`` that the index grows by, and when tombstones cover half of the
rows. A merge keeps what still counts, gives it the next number, and drops tombstones that no segment
is older than. Vectors are carried over, never made again.

``ord`` is text here, path and place in it, which orders rows as the numbers of a full build do.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata import schemas
from lodestrata.functions.parsing import MAX_CHUNK_CHARS, parse_files
from lodestrata.functions.terms import term_rows
from lodestrata.functions.text import TERM_TIMES, embedded_text
from lodestrata.operators import blocks
from lodestrata.operators.resolve import build_graph
from lodestrata.sources.index import counted_status, make_embedder
from lodestrata.storage import _delete, materialize, read_text, replace_text, scratch

#: Segments of about one size that are merged into one of the next.
FACTOR = 8
#: Files with tombstones up to which a list of them is broadcast.
BROADCAST_FILES = 100_000
#: A range's number begins with its segment's.
SEGMENT_BITS = 32
_PLACED = "file_path string, place int"


def _type(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in ((f.split()[0], {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}[f.split()[1]]) for f in ddl.split(", "))])


def _with_place(fields: str) -> T.StructType:
    return T.StructType([*_type(_PLACED), *[f for f in schemas._schema(fields) if f.name != "file_path"]])


SCHEMAS = {
    "files": schemas.FILES,
    "chunks": _with_place(schemas.CHUNK_FIELDS),
    "symbols": _with_place(schemas.SYMBOL_FIELDS),
    "documents": _type("range long, slot int, dl long, file_path string, place int, chunk_id string"),
    "postings": T.StructType([*_type("range long, term string, n long, terms long"), T.StructField("peaks", T.ArrayType(_type("tf int, dl int"))), T.StructField("entries", T.ArrayType(_type("tf int, less int, slot int")))]),
    "vectors": T.StructType([*_type(_PLACED), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]),
}
_TOMBSTONES = _type("file_path string, before long")


def order_key(path: Column, place: Column) -> Column:
    """Orders as (path, place) does: no path holds the character between them."""
    return F.concat(path, F.lit("\0"), F.lpad(place.cast("string"), 10, "0"))


def _placed(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select(F.posexplode(column).alias("place", "row")).select("place", "row.*")


@dataclass
class SegmentStore:
    """One state of a segmented index. Changes return the next one; this one stays readable until a merge's files are dropped."""

    spark: SparkSession
    path: str
    meta: dict = field(default_factory=lambda: {"segments": [], "tombstones": [], "next": 1})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentStore:
        held = read_text(spark, f"{path}/MANIFEST")
        if held is None:
            raise FileNotFoundError(f"no index at {path}; build one first")
        return cls(spark, path, json.loads(held))

    @classmethod
    def create(cls, spark: SparkSession, path: str, embedder: str = "hash", max_chunk_chars: int = MAX_CHUNK_CHARS) -> SegmentStore:
        name, _ = make_embedder(embedder)
        store = cls(spark, path, {"segments": [], "tombstones": [], "next": 1, "embedder": name, "max_chunk_chars": max_chunk_chars})
        store._publish()
        return store

    def _publish(self) -> None:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(files)
        replace_text(self.spark, f"{self.path}/MANIFEST", json.dumps(self.meta))

    # -- reading ---------------------------------------------------------------------------------

    def stored(self, name: str, *segments: int) -> DataFrame:
        """All rows of a table, or those of some segments, with ``seg``, whether they count or not."""
        numbers = segments or [s["seg"] for s in self.meta["segments"]]
        base, schema = f"{self.path}/{name}", T.StructType([*SCHEMAS[name], T.StructField("seg", T.LongType())])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/seg={n}" for n in numbers])

    def tombstones(self) -> DataFrame | None:
        """(file_path, before), one row for each file, or None if all rows count."""
        if not self.meta["tombstones"]:
            return None
        held = self.spark.read.schema(_TOMBSTONES).parquet(*[f"{self.path}/tombstones/{t['name']}" for t in self.meta["tombstones"]])
        last = held.groupBy("file_path").agg(F.max("before").alias("before"))
        return F.broadcast(last) if sum(t["files"] for t in self.meta["tombstones"]) <= BROADCAST_FILES else last

    def living(self, rows: DataFrame) -> DataFrame:
        """Those of a table's rows that count."""
        dead = self.tombstones()
        if dead is None:
            return rows
        return rows.join(dead, "file_path", "left").where(F.col("before").isNull() | (F.col("seg") >= F.col("before"))).drop("before")

    def rows(self, name: str) -> DataFrame:
        """A table's rows that count, with ``seg`` and, where they have a place, ``ord``."""
        own = self.living(self.stored(name))
        return own.withColumn("ord", order_key(F.col("file_path"), F.col("place"))) if "place" in own.columns else own

    def table(self, name: str) -> DataFrame:
        """A table under its name in a full build."""
        if name in ("nodes", "edges"):
            nodes, edges = build_graph(self.rows("files").drop("seg"), self.rows("symbols").drop("seg", "place"))
            return nodes if name == "nodes" else edges
        if name == "lengths":
            return self.rows("documents").select("chunk_id", "ord", "dl")
        return self.rows(name).drop("seg", "place")

    def posting_blocks(self) -> blocks.Blocks:
        """The postings of all segments; those of rows that don't count stay in their blocks and are left out."""
        documents = self.stored("documents").withColumn("ord", order_key(F.col("file_path"), F.col("place")))
        posts, none = self.stored("postings").drop("seg"), F.lit(0).cast("long")
        size = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("dl"), none)).first())
        if not self.meta["tombstones"]:
            return blocks.Blocks(documents, posts, size(documents))
        dead = materialize(documents.join(self.tombstones(), "file_path").where("seg < before").select("range", "slot", "dl"), "dead")
        (every, words), (lost, less) = size(documents), size(dead)
        return blocks.Blocks(documents, posts, (every - lost, words - less), dead.drop("dl"))

    # -- changing --------------------------------------------------------------------------------

    def refresh(self, files: DataFrame) -> tuple[SegmentStore, dict]:
        """Bring the index to a listing (file_path, language, content, sha1) of all files; paths aren't repeated."""
        with scratch(self.spark):
            status, count = counted_status(self.rows("files").select("file_path", "sha1"), files.select("file_path", "sha1"))
            # The listing is read once more for its contents; a file that changes in between is found the next time.
            changed = files.select("file_path", "language", "content", "sha1").join(status.where("status in ('added', 'changed')"), "file_path", "left_semi")
            store, stats = self._apply(changed, status.where("status = 'removed'").select("file_path"), count["changed"] + count["removed"], sum(v for k, v in count.items() if k != "unchanged"))
        return store, stats | {"files_indexed": count["added"] + count["changed"], "files_skipped": count["unchanged"], "files_removed": count["removed"]}

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> tuple[SegmentStore, dict]:
        """Add or replace the files of ``changed`` and remove those of ``removed`` (file_path); no other file is looked at."""
        with scratch(self.spark):
            changed = changed.select("file_path", "language", "content", "sha1")
            gone = materialize(removed.select("file_path"), "removed") if removed is not None else changed.select("file_path").limit(0)
            return self._apply(changed, gone, None, None)

    def _apply(self, changed: DataFrame, gone: DataFrame, buried: int | None, touched: int | None) -> tuple[SegmentStore, dict]:
        stats = {"segment": None, "files": 0, "chunks": 0, "symbols": 0, "tombstones": 0}
        meta = json.loads(json.dumps(self.meta))
        seg = meta["next"]
        meta["next"] += 1
        if touched != 0:
            # Contents are read once more where they are parsed.
            contents, changed = changed, materialize(changed.select("file_path", "language", "sha1"), "changed")
            if buried != 0 and meta["segments"]:
                # Only files that have rows get a tombstone.
                paths = changed.select("file_path").unionByName(gone).distinct()
                held = Observation()
                name = uuid.uuid4().hex
                stones = paths.join(self.rows("files").select("file_path"), "file_path", "left_semi").withColumn("before", F.lit(seg).cast("long"))
                stones.observe(held, F.count("*").alias("n")).write.parquet(f"{self.path}/tombstones/{name}")
                if held.get["n"]:
                    meta["tombstones"].append({"name": name, "files": held.get["n"]})
                    stats["tombstones"] = held.get["n"]
            parsed = materialize(parse_files(contents.where("content is not null"), meta["max_chunk_chars"]), "parsed")
            files = changed.select("file_path", "language", "sha1").join(parsed.select("file_path", "imports"), "file_path", "left")
            counts = self._write(seg, files, _placed(parsed, "chunks"), _placed(parsed, "symbols"))
            if counts["files"]:
                meta["segments"].append({"seg": seg} | counts)
                stats |= counts | {"segment": seg}
        store = SegmentStore(self.spark, self.path, meta)
        store._publish()
        return store._merged(), stats

    def _write(self, seg: int, files: DataFrame, chunks: DataFrame, symbols: DataFrame, vectors: DataFrame | None = None) -> dict:
        """A segment's tables, counted while they are written."""
        counts = {}

        def save(name: str, df: DataFrame) -> DataFrame:
            held, path = Observation(), f"{self.path}/{name}/seg={seg}"
            df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]]).observe(held, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
            counts[name] = held.get["n"]
            return self.spark.read.schema(SCHEMAS[name]).parquet(path)

        save("files", files)
        chunks = save("chunks", chunks)
        save("symbols", symbols)
        # Neighbours in the tree lie in one range, so that their common terms are in few blocks.
        counted, (_, _, postings) = blocks.stored_counts(term_rows(chunks, "file_path", "place", "chunk_id", "language", times=TERM_TIMES))
        tasks = blocks.tasks_for(postings)
        placed = materialize(blocks.ranged(counted, tasks, "language", "file_path", "place", first=seg << SEGMENT_BITS), "places")
        save("documents", placed)
        save("postings", blocks.counted_blocks(placed, tasks))
        if vectors is None:
            _, embed = make_embedder(self._embedder_spec())
            texts = chunks.select("file_path", "place", embedded_text(F.col("file_path"), F.col("symbol"), F.col("docstring"), F.col("text")).alias("embed_text"))
            vectors = embed(texts, "file_path", "place")
        save("vectors", vectors)
        return {c: counts[c] for c in ("files", "chunks", "symbols")}

    def _embedder_spec(self) -> str:
        name = self.meta["embedder"]
        return "hash" if name.startswith("hashing") else name

    # -- merging ---------------------------------------------------------------------------------

    def _due(self) -> list[int]:
        """Segments to be merged now: all if half of the files are dead, else those of a size that ``FACTOR`` share."""
        segments = self.meta["segments"]
        if len(segments) and 2 * sum(t["files"] for t in self.meta["tombstones"]) > sum(s["files"] for s in segments):
            return [s["seg"] for s in segments]
        tiers: dict[int, list[int]] = {}
        for s in segments:
            tiers.setdefault(math.floor(math.log(max(s["chunks"], 1), FACTOR)), []).append(s["seg"])
        return next((own for _, own in sorted(tiers.items()) if len(own) >= FACTOR), [])

    def _merged(self) -> SegmentStore:
        store = self
        while due := store._due():
            store = store.merge(due)
        return store

    def merge(self, segments: list[int] | None = None) -> SegmentStore:
        """One segment of the rows that count in ``segments``, or in all."""
        own = segments or [s["seg"] for s in self.meta["segments"]]
        meta = json.loads(json.dumps(self.meta))
        seg = meta["next"]
        meta["next"] += 1
        with scratch(self.spark):
            kept = lambda name: self.living(self.stored(name, *own)).drop("seg")
            counts = self._write(seg, kept("files"), kept("chunks"), kept("symbols"), kept("vectors"))
            meta["segments"] = [s for s in meta["segments"] if s["seg"] not in own] + ([{"seg": seg} | counts] if counts["files"] else [])
            stones, name, held = self.tombstones(), uuid.uuid4().hex, Observation()
            meta["tombstones"] = []
            oldest = min((s["seg"] for s in meta["segments"]), default=seg)
            if stones is not None and oldest < seg:
                stones.where(F.col("before") > oldest).observe(held, F.count("*").alias("n")).write.parquet(f"{self.path}/tombstones/{name}")
                meta["tombstones"] = [{"name": name, "files": held.get["n"]}] if held.get["n"] else []
        store = SegmentStore(self.spark, self.path, meta)
        store._publish()
        return store

    def vacuum(self) -> int:
        """Delete segments and tombstones that this state doesn't name, once no reader has an earlier one open."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        keep = {f"seg={s['seg']}" for s in self.meta["segments"]} | {t["name"] for t in self.meta["tombstones"]}
        gone = [f"{self.path}/{name}/{s.getPath().getName()}" for name in (*SCHEMAS, "tombstones") if fs.exists(fs_path(f"{self.path}/{name}")) for s in fs.listStatus(fs_path(f"{self.path}/{name}")) if s.getPath().getName() not in keep]
        for path in gone:
            _delete(self.spark, path)
        return len(gone)
