"""Hits from fused candidates: filters, boosts, order, and what is related to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import DEFINITIONS, symbol_node
from lodestrata.operators.graph import callees_of, callers_of, subclasses_of

DEFINITION_BOOST, COHERENCE_BOOST = 1.15, 1.1


def coherent(candidates: DataFrame, symbol_chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of candidates with a neighbour in the graph that is a candidate of the query too.

    ``candidates``: (query_id, chunk_id, node), all of them, filtered or not; ``symbol_chunks``:
    (node, chunk_id). Neighbours are callers, callees and subclasses.
    """
    starts = candidates.where("node is not null").select(F.col("node").alias("start")).distinct()
    around = callers_of(edges, starts).unionByName(callees_of(edges, starts)).unionByName(subclasses_of(edges, starts)).distinct()
    # A neighbour's chunks, as far as they are candidates, beside those they neighbour on.
    near = around.join(symbol_chunks.select("node", F.col("chunk_id").alias("other")), "node").select(F.col("start").alias("node"), "other")
    pairs = candidates.join(near, "node").select("query_id", "chunk_id", "other")
    return pairs.join(candidates.select("query_id", F.col("chunk_id").alias("other")), ["query_id", "other"], "left_semi").select("query_id", "chunk_id").distinct()


def ranked_hits(fused: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10, language: str | None = None, kind: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, sources) -> the best ``k`` chunks of each query, boosted, with rank from 1.

    Filters apply to the candidates, after their number has been cut, so fewer than ``k`` may be
    left; coherence looks at all candidates, filtered or not.
    """
    node = F.when(F.coalesce("symbol", F.lit("")) != "", symbol_node(F.col("file_path"), F.col("symbol")))
    owned = chunks.withColumn("node", node)
    hits = fused.join(owned, "chunk_id")
    linked = coherent(hits.select("query_id", "chunk_id", "node"), owned.where("node is not null").select("node", "chunk_id"), edges).withColumn("linked", F.lit(True))
    if language:
        hits = hits.where(F.col("language") == language)
    if kind:
        hits = hits.where(F.col("kind") == kind)
    boosted = F.col("score") * F.when(F.col("kind").isin(*DEFINITIONS), DEFINITION_BOOST).otherwise(1.0)
    hits = hits.join(linked, ["query_id", "chunk_id"], "left").withColumn("final", boosted * F.when(F.col("linked"), COHERENCE_BOOST).otherwise(1.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final"), F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("score", "linked", "ord").withColumnRenamed("final", "score")
