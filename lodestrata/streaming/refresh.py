"""Incremental refresh from a stream of file versions: Structured Streaming over the batch operators.

Each micro-batch holds (file_path, language, content, version); of several versions of a file the
last counts. A file's chunks and terms replace those of its versions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.functions.parsing import parse_files
from lodestrata.functions.text import boosted_terms

FILE_VERSIONS = "file_path string, language string, content string, version long"


def latest(versions: DataFrame) -> DataFrame:
    last = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("version"), F.desc(F.sha1("content"))))
    return versions.withColumn("n", last).where("n = 1").drop("n")


def parsed_chunks(versions: DataFrame) -> DataFrame:
    """Chunks of file versions, with their terms; a null content is a removed file and has none."""
    parsed = parse_files(versions.where(F.col("content").isNotNull()))
    rows = parsed.select(F.posexplode_outer("chunks").alias("place", "c")).where("c is not null").select("place", "c.*")
    return rows.withColumn("tokens", boosted_terms(F.col("text"), F.col("symbol"), F.col("docstring"), F.col("file_path"))).join(versions.select("file_path", "version"), "file_path")


def start_refresh(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Read JSON file versions from ``source`` and append their chunks to ``target``, partitioned by micro-batch.

    A batch that is run again after a failure overwrites its own partition, so each version is
    there once. ``current_chunks`` reads the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        files = latest(batch)
        files.select("file_path", "version").write.mode("overwrite").parquet(f"{target}/files/batch={batch_id}")
        parsed_chunks(files).write.mode("overwrite").parquet(f"{target}/chunks/batch={batch_id}")

    stream = spark.readStream.schema(FILE_VERSIONS).json(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of each file's last version."""
    last = spark.read.parquet(f"{target}/files").groupBy("file_path").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{target}/chunks").join(last, ["file_path", "version"])
