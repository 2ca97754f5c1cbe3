"""BM25 over postings in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: A term of a query counts at most so often.
QUERY_TF = 2
CANDIDATES = 40


def exploded(tokens: DataFrame, *ids: str) -> DataFrame:
    """(ids, tokens) -> (ids, term).

    An inner explode would make the optimiser test the array's size at the scan, which evaluates the
    tokeniser a second time; an outer one with a filter above it doesn't.
    """
    return tokens.select(*ids, F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())


def postings(tokens: DataFrame, *ids: str) -> DataFrame:
    """(ids, tokens) -> (term, ids, tf)."""
    return exploded(tokens, *ids).groupBy("term", *ids).agg(F.count("*").alias("tf"))


def lengths(tokens: DataFrame, *ids: str) -> DataFrame:
    """(ids, dl), rows without tokens included."""
    return tokens.select(*ids, F.size("tokens").cast("long").alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """One row: n documents and their mean length, 0 if there are none."""
    return dl.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))


def _or_one(c: Column) -> Column:
    return F.when(c == 0, 1).otherwise(c)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def contribution(idf_: Column, tf: Column, dl: Column, avgdl: Column, qtf: Column, k1: float = K1, b: float = B) -> Column:
    norm = 1 - b + b * _or_one(dl) / _or_one(avgdl)
    return idf_ * (tf * (k1 + 1)) / (tf + k1 * norm) * F.least(qtf, F.lit(QUERY_TF))


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, ...) -> (query_id, term, qtf)."""
    return exploded(queries.select("query_id", tokens.alias("tokens")), "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(posts: DataFrame, dl: DataFrame, queries: DataFrame, key: str = "ord", round_to: int | None = None) -> DataFrame:
    """(query_id, key, score) of every document that shares a term with a query.

    ``queries``: (query_id, term, qtf). Only the queries' terms leave the postings, so the filter
    reaches the scan where they are a stored table.
    """
    found = posts.join(queries, "term")
    df = posts.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(dl)
    scored = found.join(df, "term").join(dl.select(key, "dl"), key).crossJoin(F.broadcast(stats))  # stats is one row
    total = F.sum(contribution(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("qtf")))
    return scored.groupBy("query_id", key).agg((F.round(total, round_to) if round_to is not None else total).alias("score"))


def top_candidates(scores: DataFrame, k: int = CANDIDATES, key: str = "ord") -> DataFrame:
    """The best ``k`` of each query with their rank from 0; ties go to the smaller key."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank - 1).where(F.col("rank") < k)
