"""Line windows of plain texts as column expressions; ``windows.line_windows`` says the same in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import chunk_id
from lodestrata.functions.windows import OVERLAP, WINDOW
from lodestrata.schemas import CHUNK_FIELDS, PARSED, _schema

# What ends a line, and what else counts as white space, to Python's string methods.
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85  "
SPACES = "\t\x1f \xa0              　"
ID_TEXT_CHARS = 64


def lines_of(text: Column) -> Column:
    """A text's lines without what ends them; what follows the last end is a line only if it isn't empty."""
    # The end of the last line goes first, so that what is left is split once.
    body = F.regexp_replace(text, f"(?:\\r\\n|[{BREAKS}])\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, f"\\r\\n|[{BREAKS}]", -1))


def _blank(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES + BREAKS)) == ""


def line_spans(lines: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of (begin, stop) over an array of lines.

    A fold with one step for each window: a step looks at the second half of its window only, and moves
    on by more than that less the overlap, which bounds the number of steps.
    """
    n = F.size(lines)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int>>").alias("spans"))

    def step(state: Column, _: Column) -> Column:
        begin = state["at"]
        full = F.least(begin + size, n)
        ends = F.filter(F.sequence(begin + max(size // 2, 1) + 1, full), lambda j: _blank(F.get(lines, j - 1)))
        stop = F.coalesce(F.when((full < n) & (full > begin + max(size // 2, 1)), F.array_max(ends)), full)
        then = F.when(stop == n, n).otherwise(F.greatest(stop - overlap, begin + 1))
        return F.when(begin >= n, state).otherwise(F.struct(then.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("begin"), stop.alias("stop")))).alias("spans")))

    shift = max(size // 2 + 1 - overlap, 1)
    return F.aggregate(F.sequence(F.lit(1), F.floor(n / shift).cast("int") + 1), start, step, lambda s: s["spans"])


def window_rows(files: DataFrame) -> DataFrame:
    """(file_path, language, content) of texts -> one row for each, as parsed: its windows are its chunks."""
    text = F.col("content")
    if isinstance(files.schema["content"].dataType, T.BinaryType):
        text = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string")).otherwise(F.decode(text, "ISO-8859-1"))
    lined = files.select("file_path", "language", lines_of(F.coalesce(text, F.lit(""))).alias("lines"))
    placed = lined.select("file_path", "language", "lines", line_spans(F.col("lines")).alias("spans"))
    body = lambda s: F.array_join(F.slice("lines", s["begin"] + 1, s["stop"] - s["begin"]), "\n")
    bodies = F.filter(F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), body(s).alias("text"))), lambda w: ~_blank(w["text"]))
    none = F.lit(None).cast("string")

    def chunk(w: Column) -> Column:
        name = chunk_id(F.col("file_path"), w["begin"], F.substring(w["text"], 1, ID_TEXT_CHARS))
        values = {"chunk_id": name, "file_path": F.col("file_path"), "language": F.col("language"), "start_line": w["begin"] + 1, "end_line": w["stop"], "text": w["text"], "kind": F.lit("block"), "symbol": none, "docstring": none}
        return F.struct(*[values[f.name].alias(f.name) for f in _schema(CHUNK_FIELDS)])

    whole = placed.select("file_path", "language", bodies.alias("windows"))
    empty = lambda name: F.array().cast(PARSED[name].dataType).alias(name)
    return whole.select("file_path", F.transform("windows", chunk).cast(PARSED["chunks"].dataType).alias("chunks"), empty("symbols"), empty("imports"))
