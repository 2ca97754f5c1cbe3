"""Dense retrieval: hashed term vectors in sparse long form, and dot products of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.hashing import DIM, bucket, sign
from lodestrata.operators.lexical import CANDIDATES, exploded, top_candidates
from lodestrata.storage import drop_table, materialize

#: Stored vectors keep so many decimals.
DECIMALS = 6


def hashed_vectors(tokens: DataFrame, *ids: str, dim: int = DIM, round_to: int | None = DECIMALS) -> DataFrame:
    """(ids, tokens) -> (ids, bucket, w): signed counts, damped by a logarithm, of length one.

    Buckets whose counts cancel have no row, nor have documents without terms. Token arrays are
    dealt by id once, before they are exploded; counts, norms and their join need no further shuffle.
    """
    terms = exploded(tokens.repartition(*ids), *ids)
    signed = terms.select(*ids, bucket(F.col("term"), dim).alias("bucket"), sign(F.col("term")).alias("sign")).groupBy(*ids, "bucket").agg(F.sum("sign").alias("v")).where("v <> 0")
    damped = signed.select(*ids, "bucket", (F.signum("v") * F.log1p(F.abs("v"))).alias("v"))
    w = F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(*ids)))
    return damped.select(*ids, "bucket", (F.round(w, round_to) if round_to is not None else w).alias("w"))


def long_form(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, buckets, weights) -> (ids, bucket, w)."""
    return rows.select(*ids, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("w"))))


def nearest(vectors: DataFrame, queries: DataFrame, everything: DataFrame, k: int = CANDIDATES, key: str = "ord", round_to: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` rows of ``everything`` for each query, from rank 0, ties to the smaller key.

    There is no threshold: rows without a common bucket score 0, and so come before those that score
    less. They are looked up only for queries with fewer than ``k`` rows above 0, and of them only
    the first ``k`` by key, among a beginning of the keys that grows until it holds as many.
    ``queries``: (query_id, bucket, w), at most ``DIM`` rows each.
    """
    score = F.sum(F.col("w") * F.col("qw"))
    score = (F.round(score, round_to) if round_to is not None else score).alias("score")
    near = materialize(vectors.join(queries.withColumnRenamed("w", "qw"), "bucket").groupBy("query_id", key).agg(score), "dense")
    full = near.where("score > 0").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = materialize(queries.select("query_id").distinct().join(full, "query_id", "left_anti"), "short")
    missing = short.count()
    first = 4 * k
    while missing:
        keys = everything.select(key).orderBy(key).limit(first)
        # As many rows as queries that lack some times ``first``, not times the corpus.
        apart = materialize(keys.join(short).join(near, ["query_id", key], "left_anti"), "apart")
        if keys.count() < first or apart.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).count() == missing:
            return top_candidates(near.unionByName(apart.withColumn("score", F.lit(0.0))), k, key)
        drop_table(apart)
        first *= 4
    return top_candidates(near, k, key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.round(x, DECIMALS))
