"""Reliable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Executors are threads of the driver, so its folders are theirs."""
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


#: Paths of this process's intermediate tables and folders, until they are dropped.
_written: set[str] = set()
#: Paths written in the scopes that this thread is in, the innermost last.
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def register_folder(spark: SparkSession, path: str) -> str:
    """Have ``path`` deleted with the intermediate tables, at the latest when the driver ends."""
    if not _written:
        atexit.register(_last_cleanup, spark)
    _written.add(path)
    if scopes := _scopes.get():
        scopes[-1].add(path)
    return path


def _last_cleanup(spark: SparkSession) -> None:
    # The session may be gone by then, and with it the way to its files.
    with contextlib.suppress(Exception):
        cleanup(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    The table stays until ``drop_table`` or ``cleanup``, which the driver's end calls, as results may
    be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(register_folder(spark, path))
    return spark.read.schema(schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """(file system, path) as the JVM has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is no such file."""
    fs, p = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then rename it in one step over what is there."""
    pending = f"{path}-{uuid.uuid4().hex}"
    fs, p = _file(spark, pending)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(p), files.makeQualified(hadoop.Path(path)), over)


def drop_below(spark: SparkSession, path: str, prefix: str, keep: set[str]) -> None:
    """Delete the folders of ``path`` whose names begin with ``prefix`` and aren't to be kept."""
    fs, p = _file(spark, path)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith(prefix) and name not in keep:
            fs.delete(status.getPath(), True)


def drop_table(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables that nothing reads any more."""
    for df in tables:
        names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        for path in [p for p in list(_written) if p.rsplit("/", 1)[1] in names]:
            _delete(df.sparkSession, path)
            _written.discard(path)


def cleanup(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process, once its results have been read or written; returns their number."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread writes within are dropped at its end: nothing lazy may read them after.

    What other threads write meanwhile is theirs, and scopes within a scope drop their own.
    """
    own: set[str] = set()
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own & _written:
            _delete(spark, path)
            _written.discard(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where the input has fewer files than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
