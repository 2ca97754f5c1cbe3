"""Symbol lookup, outlines and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.storage import materialize

FUZZY_LIMIT = 20
#: Names without an exact match up to which each symbol is held against all of them.
BROADCAST_NAMES = 1_000
GRAM = 3
OUTLINE_DOC_CHARS = 120


def find_symbols(symbols: DataFrame, names: DataFrame, limit: int = FUZZY_LIMIT) -> DataFrame:
    """(name asked) -> all symbols of that name or qualified name; where there are none, the first
    ``limit`` whose qualified name contains it in any case. Adds ``asked``; one query may ask for many names."""
    asked = names.select(F.col("name").alias("asked")).distinct()
    # Names asked for are stated by the caller and few; symbols are scanned once for each kind of match.
    by_name = symbols.join(asked, symbols["name"] == asked["asked"])
    by_full = symbols.where(F.col("qualified_name") != F.col("name")).join(asked, F.col("qualified_name") == F.col("asked"))
    exact = by_name.unionByName(by_full)
    open_ = materialize(asked.join(exact.select("asked").distinct(), "asked", "left_anti"), "open")
    contains = F.contains(F.lower("qualified_name"), F.lower("asked"))
    near = symbols.join(F.broadcast(open_), contains) if open_.count() <= BROADCAST_NAMES else _by_grams(symbols, open_).where(contains)
    place = F.row_number().over(W.partitionBy("asked").orderBy("ord"))
    return exact.unionByName(near.withColumn("place", place).where(F.col("place") <= limit).drop("place"))


def _grams(text: Column) -> Column:
    """Distinct runs of 0 to ``GRAM`` characters."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(GRAM + 1)])))


def _by_grams(symbols: DataFrame, open_: DataFrame) -> DataFrame:
    """Symbols with the names of ``open_`` whose rarest run of ``GRAM`` characters they hold; shorter names are runs themselves."""
    grams = materialize(symbols.select("ord", F.explode(_grams(F.lower("qualified_name"))).alias("gram")), "grams")
    name = F.lower("asked")
    own = F.when(F.length(name) < GRAM, F.array(name)).otherwise(F.filter(_grams(name), lambda g: F.length(g) == GRAM))
    wanted = open_.select("asked", F.explode(own).alias("gram"))
    known = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A name with a run that no symbol holds is in none.
    rare = wanted.join(known, "gram", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return symbols.join(grams.join(rare, "gram").select("ord", "asked"), "ord")


def outline(symbols: DataFrame, file_path: str) -> DataFrame:
    """A file's symbols in order of line."""
    rows = symbols.where(F.col("file_path") == file_path.replace("\\", "/"))
    doc = F.substring(F.coalesce("docstring", F.lit("")), 1, OUTLINE_DOC_CHARS)
    return rows.orderBy("start_line", "ord").select("kind", F.col("qualified_name").alias("name"), F.col("start_line").alias("line"), "signature", doc.alias("doc"))


def language_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "language")


def index_stats(chunks: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; each table is only counted, which its footers answer."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = count(chunks, "chunks")
    for df, name in ((symbols, "symbols"), (nodes, "graph_nodes"), (edges, "graph_edges")):
        rows = rows.crossJoin(count(df, name))
    return rows
