"""Tables of an index.

``ord`` is a row's place in the index: files in order of path, then the order in which a file was
parsed. It breaks all ties, so that every ranking is total.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(fields: str) -> T.StructType:
    """From "name type, ...", without a session, so that executors can import it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


CHUNK_FIELDS = "chunk_id string, file_path string, language string, start_line int, end_line int, text string, kind string, symbol string, docstring string"
SYMBOL_FIELDS = "name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, docstring string, bases array<string>, calls array<string>"
CHUNKS = _schema(f"ord bigint, {CHUNK_FIELDS}")
SYMBOLS = _schema(f"ord bigint, {SYMBOL_FIELDS}")
FILES = _schema("file_path string, language string, sha1 string, imports array<string>")
NODES = _schema("node_id string, type string, path string, language string, name string, qualified string, kind string, line int")
EDGES = _schema("src string, dst string, edge_type string")
POSTINGS = _schema("term string, ord bigint, tf bigint")
LENGTHS = _schema("chunk_id string, ord bigint, dl bigint")
VECTORS = _schema("chunk_id string, ord bigint, bucket int, w double")
PARSED = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("chunks", T.ArrayType(_schema(CHUNK_FIELDS))), T.StructField("symbols", T.ArrayType(_schema(SYMBOL_FIELDS))), T.StructField("imports", T.ArrayType(T.StringType()))])
EDGE_TYPES = ("contains", "imports", "calls", "inherits")
