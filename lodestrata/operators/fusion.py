"""Reciprocal rank fusion of rankings in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60
WEIGHTS = {"bm25": 1.0, "dense": 0.9}


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], key: str = "ord", weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Rows (query_id, key, rank from 0) by source -> (query_id, key, score, sources).

    A union and one aggregation do what a full outer join would; ``sources`` are in order of name.
    """
    legs = [df.select("query_id", key, F.lit(name).alias("source"), (F.lit(weights.get(name, 1.0)) / (F.lit(k) + F.col("rank") + 1)).alias("share")) for name, df in rankings.items()]
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    # Shares are summed in order of source, so that equal inputs give equal sums.
    parts = F.array_sort(F.collect_list(F.struct("source", "share")))
    fused = every.groupBy("query_id", key).agg(parts.alias("parts"))
    return fused.select("query_id", key, F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["share"]).alias("score"), F.col("parts.source").alias("sources"))
