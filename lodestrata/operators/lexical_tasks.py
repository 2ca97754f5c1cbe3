"""BM25 of many queries, scored where the documents are: only each task's best are rows.

A document is one row of small numbers, the queries' terms that it holds; these rows are written once,
as the terms' document frequencies come before any score. A task then scores its documents a block at a
time and keeps the best ``k`` of each query. So a query costs a task ``k`` rows, and no posting and no
pair of a query and a document is shuffled. Queries are stated and few, ``QUERIES`` of them to a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.terms import half_up, term_rows
from lodestrata.operators.lexical import B, K1, QUERY_TF, top_candidates
from lodestrata.storage import materialize

QUERIES = 2048
#: Contributions of terms to scores that a task holds at a time.
CONTRIBUTIONS = 500_000
ROWS = 256


class Weights:
    """By place of a term in the vocabulary: the queries that ask for it, and what a full contribution to each weighs."""

    def __init__(self, asked: list[tuple[int, int, int]], df: dict[int, int], n: int, terms: int) -> None:
        """``asked``: (number of the query, place of the term, qtf) of a vocabulary of so many terms."""
        self._set([(t, q, min(f, QUERY_TF) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for q, t, f in asked if t in df], terms)

    @classmethod
    def of(cls, weighed: list[tuple[int, int, int, float]], terms: int) -> Weights:
        """The same of (number of the query, place of the term, qtf, idf)."""
        own = cls.__new__(cls)
        own._set([(t, q, min(f, QUERY_TF) * w) for q, t, f, w in weighed], terms)
        return own

    def _set(self, rows: list[tuple[int, int, float]], terms: int) -> None:
        rows = sorted(rows)
        self.size = np.bincount(np.array([t for t, _, _ in rows], np.int64), minlength=terms)
        self.first = np.cumsum(self.size) - self.size
        self.query, self.weight = np.array([q for _, q, _ in rows], np.int64), np.array([w for _, _, w in rows])

    def scores(self, sizes: np.ndarray, terms: np.ndarray, shares: np.ndarray, queries: int, plain: bool = False) -> np.ndarray:
        """Of documents with so many of ``terms`` each: one row for each, a column for each query; ``plain`` leaves weights out."""
        row, often = np.repeat(np.arange(len(sizes)), sizes), self.size[terms]
        total = np.zeros(len(sizes) * queries)
        ends = np.concatenate(([0], np.cumsum(often)))
        begin = 0
        while begin < len(terms):
            # As many terms as stay within the bound, one at least.
            end = max(int(np.searchsorted(ends, ends[begin] + CONTRIBUTIONS, "right")) - 1, begin + 1)
            many = often[begin:end]
            place = np.arange(many.sum()) + np.repeat(self.first[terms[begin:end]] - (np.cumsum(many) - many), many)
            total += np.bincount(np.repeat(row[begin:end], many) * queries + self.query[place], np.repeat(shares[begin:end], many) * (1.0 if plain else self.weight[place]), len(total))
            begin = end
        return total.reshape(len(sizes), queries)


def counted(docs: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, dl, terms, tfs) of all documents, as a table."""
    return materialize(term_rows(docs.select(key, text), key, times={text: 1}, vocabulary=terms), "term-counts")


def best_documents(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", round_to: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` of ``docs`` (key, text) that share a term with a query, from rank 0, ties to the lesser key.

    ``queries``: (query_id, term, qtf). Keys aren't null, nor repeated.
    """
    asked = [tuple(r) for r in queries.select("query_id", "term", "qtf").orderBy("query_id", "term").collect()]
    ids = list(dict.fromkeys(q for q, _, _ in asked))
    vocabulary = sorted({t for _, t, _ in asked})
    rows = counted(docs, vocabulary, key, text)
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    # A row for each of the queries' terms.
    df = {r.t: r.n for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    place, number = {t: i for i, t in enumerate(vocabulary)}, {q: i for i, q in enumerate(ids)}
    kind, id_kind = dict(docs.dtypes)[key], dict(queries.dtypes)["query_id"]
    passes = []
    for begin in range(0, len(ids), QUERIES):
        own = ids[begin : begin + QUERIES]
        weights = Weights([(number[q] - begin, place[t], f) for q, t, f in asked if begin <= number[q] < begin + QUERIES], df, n, len(vocabulary))
        names = docs.sparkSession.createDataFrame(list(enumerate(own)), f"q int, query_id {id_kind}")
        found = _pass(rows, weights, len(own), (words / n if n else 0.0) or 1.0, k, key, kind, round_to)
        # As many rows as a pass has queries at most.
        passes.append(found.join(F.broadcast(names), "q").select("query_id", key, "score"))
    found = reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], f"query_id {id_kind}, {key} {kind}, score double")
    return top_candidates(found, k, key)


def _pass(rows: DataFrame, weights: Weights, queries: int, avgdl: float, k: int, key: str, kind: str, round_to: int | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value, ["q", key, "score"]
        held: list[list[tuple[float, object]]] = [[] for _ in range(queries)]
        least = np.full(queries, -np.inf)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                sizes = part.column(2).value_lengths().to_numpy()
                terms, tfs = (part.column(i).flatten().to_numpy() for i in (2, 3))
                dl = np.maximum(part.column(1).to_numpy(), 1)
                norm = np.repeat(K1 * (1 - B + B * dl / avgdl), sizes)
                exact = own.scores(sizes, terms, tfs * (K1 + 1) / (tfs + norm), queries)
                score = half_up(exact, round_to)
                query, doc = np.nonzero(((score >= least) & (exact > 0)).T)
                if not len(query):
                    continue
                keys = part.column(0).to_pylist()
                cuts = np.flatnonzero(np.diff(query)) + 1
                for docs_ in np.split(np.arange(len(query)), cuts):
                    q = int(query[docs_[0]])
                    held[q] = nsmallest(k, held[q] + [(-score[i, q], keys[i]) for i in doc[docs_].tolist()])
                    if len(held[q]) == k:
                        least[q] = -held[q][-1][0]
        if key_type is not None:
            flat = [(q, name, -float(s)) for q, best in enumerate(held) for s, name in best]
            columns = list(zip(*flat, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), key_type, pa.float64()), strict=True)], names=names)

    return rows.select(key, "dl", "terms", "tfs").mapInArrow(run, f"q int, {key} {kind}, score double")
