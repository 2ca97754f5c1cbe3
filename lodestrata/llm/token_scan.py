"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids, one after another, each document closed by an end-of-document id.
Files are read in byte ranges of equal size that know nothing of documents, each range by itself and
by whichever task has it. A vectorised comparison finds the separators of a range. A prefix scan over
one slim row for each range, how many ids and separators it holds and where the last one is, gives
every range its place in the file, the number of the documents before it and the document that is
open at its beginning; documents that cross ranges are stitched so, without any being read twice.

Token files lie in the shared folder, opened by its address with Arrow's file systems. The pass that
writes them leaves the documents' ids, in the order of each file, in a table of its own.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, shared_dir, short, table
from lodestrata.llm.tokens import default_path, encoder_of
from lodestrata.storage import register_folder

END_OF_DOCUMENT = 50256
#: Ids in a range; documents cross ranges wherever they happen to.
BLOCK_IDS = 1 << 21
#: Bytes that a task reads, about, in one or more ranges.
TASK_BYTES = 1 << 23


def id_type(greatest: int) -> str:
    """The narrowest little-endian unsigned type that holds all ids up to ``greatest``."""
    return "<u2" if greatest < 1 << 16 else "<u4"


def id_type_of(tokenizer: str, end_id: int = END_OF_DOCUMENT) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        held = json.load(f)
    return id_type(max([end_id, *held["model"]["vocab"].values(), *(t["id"] for t in held.get("added_tokens", ()))]))


def open_store(address: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address and the path in it; a bare path is a local or mounted one."""
    if "://" not in address:
        return arrow_fs.LocalFileSystem(), address.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(address)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Tokenise ``docs`` into flat files below ``path``, one for each task; returns (file, ordinal, id, end).

    ``ordinal`` numbers a file's documents from 0, ``end`` counts its ids up to and with that document.
    Strings of special tokens are ordinary text, so the separator never comes from a text. A null or
    empty text is its separator alone. A task that runs again writes a file of its own; files that
    the returned rows don't name are of no account.
    """
    name = tokenizer or default_path()
    width = id_type_of(name, end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(name, True)
        out, file, n, end = None, posixpath.join(path, f"{uuid.uuid4().hex}.ids"), 0, 0
        for batch in short(batches):
            if out is None:
                store, own = open_store(file)
                store.create_dir(posixpath.dirname(own), recursive=True)
                out = store.open_output_stream(own)
            ends = []
            for text in batch["text"]:
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype(width)
                out.write(ids.tobytes())
                end += len(ids)
                ends.append(end)
            yield pd.DataFrame({"file": file, "ordinal": np.arange(n, n + len(batch)), "id": batch["id"].to_numpy(), "end": ends})
            n += len(batch)
        if out is not None:
            out.close()

    kind = dict(docs.dtypes)[id_col]
    written = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"file string, ordinal long, id {kind}, end long")
    return materialize(written, "token-ids")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files below ``path``; only their lengths are read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def scan_separators(files: DataFrame, end_id: int = END_OF_DOCUMENT, ids: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, bytes) -> (file, ordinal, start, n_tokens, complete): a row for each document.

    ``ordinal`` is its number in the file, from 0; ``start`` counts ids from the file's beginning;
    ``n_tokens`` leaves the separator out. Ids after a file's last separator are a document that
    isn't complete. Empty files have no documents; bytes that don't fill an id at a file's end are none.
    """
    size = np.dtype(ids).itemsize
    count, none = F.ceil(F.floor(F.col("bytes") / size) / block_ids), F.lit(0).cast("long")
    ranges = files.where(F.col("bytes") >= size).select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, length, block in zip(batch["file"], batch["bytes"].tolist(), batch["block"].tolist(), strict=True):
                begin = block * block_ids * size
                store, own = open_store(file)
                with store.open_input_file(own) as f:
                    data = f.read_at(min(block_ids * size, length // size * size - begin), begin)
                at = np.flatnonzero(np.frombuffer(data, ids) == end_id)
                yield pd.DataFrame({"file": [file], "block": [block], "n": [len(data) // size], "seps": [len(at)], "at": [at]})

    # Ranges are rows of a few bytes that stand for much work, so it sets the number of tasks.
    count, held = files.agg(F.coalesce(F.sum(count), none), F.coalesce(F.sum("bytes"), none)).first()
    tasks = max(1, min(count, max(files.sparkSession.sparkContext.defaultParallelism, held // TASK_BYTES)))
    local = materialize(ranges.repartition(tasks, "file", "block").mapInPandas(find, "file string, block long, n long, seps long, at array<long>"), "separators")
    slim = local.select("file", "block", "n", "seps", F.try_element_at("at", F.lit(-1)).alias("last"))
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = slim.withColumn("base", F.coalesce(F.sum("n").over(before), none)).withColumn("done", F.coalesce(F.sum("seps").over(before), none))
    # Where the document begins that is open at the range's beginning: after the last separator before it.
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), none)).withColumn("tail", F.lead("block").over(order).isNull())
    whole = local.select("file", "block", "n", "at").join(placed.select("file", "block", "base", "done", "open", "tail"), ["file", "block"])
    spans = F.transform("at", lambda p, k: F.struct(F.when(k == 0, F.col("open")).otherwise(F.try_element_at("at", k) + F.col("base") + 1).alias("start"), (p + F.col("base")).alias("end"), F.lit(True).alias("complete")))
    rest = F.struct(F.coalesce(F.try_element_at("at", F.lit(-1)) + F.col("base") + 1, F.col("open")).alias("start"), (F.col("base") + F.col("n")).alias("end"), F.lit(False).alias("complete"))
    unfinished = F.when(F.col("tail") & (rest["end"] > rest["start"]), F.array(rest)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,complete:boolean>>"))
    rows = whole.select("file", "done", F.posexplode(F.concat(spans, unfinished)).alias("place", "d"))
    return rows.select("file", (F.col("done") + F.col("place")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.col("d.complete").alias("complete"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each row of ``docs``: id and n_tokens, read from token files written for it.

    Null ids stay null, repeated rows are counted as often as they stand there, other columns are
    ignored, an empty table gives no rows.
    """
    name = tokenizer or default_path()
    path = register_folder(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/lodestrata/tokens-{uuid.uuid4().hex}")
    written = write_token_files(docs, path, id_col, text_col, name)
    ids = id_type_of(name)
    files = written.groupBy("file").agg((F.max("end") * np.dtype(ids).itemsize).alias("bytes"))
    found = scan_separators(files, ids=ids, block_ids=block_ids)
    return found.where("complete").join(written.select("file", "ordinal", F.col("id").alias(id_col)), ["file", "ordinal"]).select(id_col, "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
