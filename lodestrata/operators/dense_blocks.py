"""Nearest vectors of many queries, block by block: only each task's best are rows.

A vector is one row with its buckets and weights. A task holds a few hundred of them as a matrix, and
for each query the best ``k`` that it has met. Before a block is multiplied with the queries, the
greatest and the least weight that it has in each bucket bound every score in it, as do the lengths
of its longest vector and the query; queries that couldn't place any of its rows leave it out. So a
query costs a task ``k`` rows, however many vectors there are, and what is shuffled grows with tasks
only. Queries are stated and few; ``QUERIES`` of them are sent to the tasks at a time, in as many
passes as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.hashing import DIM
from lodestrata.functions.terms import half_up
from lodestrata.operators.lexical import top_candidates

QUERIES = 2048
ROWS = 256


def vector_rows(vectors: DataFrame, everything: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, w) -> (keys, buckets, weights), a row for each of ``everything``, without buckets where there are none."""
    held = vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("v"))
    empty = F.array().cast("array<struct<bucket:int,w:double>>")
    every = everything.select(*keys).join(held, list(keys), "left").withColumn("v", F.coalesce("v", empty))
    return every.select(*keys, F.col("v.bucket").alias("buckets"), F.col("v.w").alias("weights"))


class Best:
    """The best ``k`` (score, key) of each query, ties to the lesser key."""

    def __init__(self, queries: np.ndarray, k: int, decimals: int | None) -> None:
        self.queries, self.k, self.decimals = queries, k, decimals
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        self.length = np.sqrt((queries * queries).sum(1))
        self.held: list[list[tuple[float, object]]] = [[] for _ in queries]
        self.least = np.full(len(queries), -np.inf)
        self.asked = self.scored = 0

    def add(self, keys: list, block: np.ndarray) -> None:
        bound = np.minimum(self.up @ block.max(0) + self.down @ block.min(0), self.length * np.sqrt((block * block).sum(1).max()))
        # A bound is rounded up, never down.
        live = np.flatnonzero(bound + (0.0 if self.decimals is None else 10.0**-self.decimals) + 1e-9 >= self.least)
        self.asked, self.scored = self.asked + len(bound), self.scored + len(live)
        scores = half_up(self.queries[live] @ block.T, self.decimals)
        for q, own in zip(live.tolist(), scores, strict=True):
            hits = np.flatnonzero(own >= self.least[q])
            if len(hits):
                # Zero has one sign only, so that equal scores are ties.
                both = self.held[q] + [(-s if s else 0.0, keys[i]) for i, s in zip(hits.tolist(), own[hits].tolist(), strict=True)]
                self.held[q] = nsmallest(self.k, both)
                if len(self.held[q]) == self.k:
                    self.least[q] = -self.held[q][-1][0]


def blocks_of(batch: pd.DataFrame, key: str, dim: int) -> Iterator[tuple[list, np.ndarray]]:
    for k in range(0, len(batch), ROWS):
        part = batch.iloc[k : k + ROWS]
        block = np.zeros((len(part), dim))
        for i, (buckets, weights) in enumerate(zip(part["buckets"], part["weights"], strict=True)):
            block[i, buckets.astype(np.int64)] = weights
        yield part[key].tolist(), block


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "ord", round_to: int | None = None, dim: int = DIM) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` of ``rows`` (key, buckets, weights) for each query, from rank 0, ties to the lesser key.

    ``queries``: (query_id, bucket, w), a row with weight 0 for one without terms. Keys aren't null.
    """
    vectors = queries.groupBy("query_id").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("w").alias("weights"))
    asked = vectors.orderBy("query_id").collect()
    spark, kind, id_kind = rows.sparkSession, dict(rows.dtypes)[key], dict(queries.dtypes)["query_id"]
    passes = [_pass(rows, asked[i : i + QUERIES], k, key, kind, round_to, dim, id_kind) for i in range(0, len(asked), QUERIES)]
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], f"query_id {id_kind}, {key} {kind}, score double")
    return top_candidates(found, k, key)


def _pass(rows: DataFrame, asked: list, k: int, key: str, kind: str, round_to: int | None, dim: int, id_kind: str) -> DataFrame:
    spark = rows.sparkSession
    matrix = np.zeros((len(asked), dim))
    for i, r in enumerate(asked):
        np.add.at(matrix[i], np.array(r.buckets, np.int64), r.weights)
    held = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(held.value, k, round_to)
        for batch in batches:
            for keys, block in blocks_of(batch, key, dim):
                best.add(keys, block)
        found = [(q, key_, -s) for q, own in enumerate(best.held) for s, key_ in own]
        yield pd.DataFrame(found, columns=["q", key, "score"])

    ids = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"q int, query_id {id_kind}")
    found = rows.select(key, "buckets", "weights").mapInPandas(run, f"q int, {key} {kind}, score double")
    # As many rows as a pass has queries at most.
    return found.join(F.broadcast(ids), "q").select("query_id", key, "score")
