"""Queries over an index: hybrid search and relational lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import symbol_node, tokenize
from lodestrata.operators import blocks, dense, dense_blocks, fusion, graph, lexical, lookup, ranking
from lodestrata.sources.index import IndexTables, index_path, make_embedder
from lodestrata.sources.segments import SegmentStore
from lodestrata.storage import materialize, scratch

RESULT_DECIMALS = 6
#: Values up to which a query's terms or buckets become a filter on the stored table.
FILTER_VALUES = 1024


class CodeIndex:
    def __init__(self, spark: SparkSession, root: str, path: str | None = None) -> None:
        self.spark = spark
        self.tables = IndexTables.open(spark, index_path(spark, root, path))

    def table(self, name: str) -> DataFrame:
        return self.tables.table(name)

    # -- hybrid search ---------------------------------------------------------------------------

    def search_many(self, queries: DataFrame, k: int = 10, language: str | None = None, kind: str | None = None, use_dense: bool = True, candidates: int = lexical.CANDIDATES) -> DataFrame:
        """(query_id, text) -> the best ``k`` chunks of each, with score, sources and rank."""
        tokens = queries.select("query_id", tokenize(F.col("text")).alias("tokens"))
        legs = {"bm25": self._by_terms(lexical.query_terms(tokens, F.col("tokens")), candidates)}
        if use_dense:
            _, embed = make_embedder(self.tables.meta["embedder"])
            asked = queries.select("query_id", F.col("text").alias("embed_text"))
            legs["dense"] = self._by_vectors(self._query_vectors(asked, embed), candidates)
        ids = self.table("lengths").select("ord", "chunk_id")
        fused = fusion.reciprocal_rank_fusion(legs).join(ids, "ord").select("query_id", "chunk_id", "score", "sources")
        return ranking.ranked_hits(fused, self.table("chunks"), self.table("edges"), k, language, kind)

    def _by_terms(self, terms: DataFrame, candidates: int) -> DataFrame:
        posts = self._only(self.table("postings"), "term", terms)
        return lexical.top_candidates(lexical.bm25_scores(posts, self.table("lengths"), terms), candidates)

    def _by_vectors(self, vectors: DataFrame, candidates: int) -> DataFrame:
        return dense.nearest(self._only(self.table("vectors"), "bucket", vectors), vectors, self.table("lengths"), candidates)

    @staticmethod
    def _only(stored: DataFrame, column: str, asked: DataFrame) -> DataFrame:
        """The rows whose ``column`` is asked for, as a filter that reaches the scan while the values are few.

        Postings are sorted by term and vectors by bucket, so the filter skips row groups.
        """
        few = [r[0] for r in asked.select(column).distinct().limit(FILTER_VALUES + 1).collect()]
        return stored.where(F.col(column).isin(few)) if len(few) <= FILTER_VALUES else stored

    def _query_vectors(self, asked: DataFrame, embed) -> DataFrame:
        """Vectors of the queries, not rounded; one without terms is all zeros and still ranks everything."""
        if self.tables.meta["embedder"].startswith("hashing"):
            found = dense.hashed_vectors(asked.select("query_id", tokenize(F.col("embed_text")).alias("tokens")), "query_id", round_to=None)
        else:
            found = dense.long_form(embed(asked, "query_id"), "query_id")
        return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("bucket", F.lit(0)).alias("bucket"), F.coalesce("w", F.lit(0.0)).alias("w"))

    def search(self, query: str, k: int = 10, language: str | None = None, kind: str | None = None, use_dense: bool = True, graph_context: bool = True, candidates: int = lexical.CANDIDATES) -> list[dict]:
        """The best chunks for one query, as at most ``k`` dicts."""
        with scratch(self.spark):
            return self._search(query, k, language, kind, use_dense, graph_context, candidates)

    def _search(self, query: str, k: int, language: str | None, kind: str | None, use_dense: bool, graph_context: bool, candidates: int) -> list[dict]:
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        hits = [r.asDict(recursive=True) for r in self.search_many(asked, k, language, kind, use_dense, candidates).orderBy("rank").collect()]
        related = self._related([h["node"] for h in hits if h["node"]]) if graph_context else {}
        keep = [f.name for f in self.table("chunks").schema if f.name != "ord"]
        return [{"chunk": {n: h[n] for n in keep}, "score": round(h["score"], RESULT_DECIMALS), "sources": h["sources"], "related": related.get(h["node"], [])} for h in hits]

    def _related(self, nodes: list[str]) -> dict[str, list[dict]]:
        if not nodes:
            return {}
        starts = self.spark.createDataFrame([(n,) for n in set(nodes)], "start string")
        out: dict[str, list[dict]] = {}
        for r in graph.related(self.table("edges"), self.table("nodes"), starts).orderBy("start", "pos").collect():
            out.setdefault(r.start, []).append({"relation": r.relation, "symbol": r.symbol, "file": r.file, "line": r.line})
        return out

    # -- relational queries ----------------------------------------------------------------------

    def find_symbol(self, name: str) -> DataFrame:
        asked = self.spark.createDataFrame([(name,)], "name string")
        return lookup.find_symbols(self.table("symbols"), asked).drop("asked").orderBy("ord")

    def _starts(self, name: str) -> DataFrame:
        """Every match is a start of its own, also where several share a node."""
        found = self.find_symbol(name)
        return found.select(F.col("ord").alias("start_ord"), symbol_node(F.col("file_path"), F.col("qualified_name")).alias("start"))

    def callers(self, name: str) -> DataFrame:
        starts = self._starts(name)
        found = starts.join(graph.callers_of(self.table("edges"), starts), "start").join(self.table("nodes"), F.col("node") == F.col("node_id"), "left")
        return found.orderBy("start_ord", "node").select(F.col("qualified").alias("symbol"), F.col("path").alias("file"), "line")

    def impact(self, name: str, max_depth: int = graph.MAX_DEPTH) -> DataFrame:
        starts = self._starts(name)
        reached = graph.impact(self.table("edges"), starts.select("start"), max_depth)
        found = starts.join(reached, "start").join(self.table("nodes"), F.col("node") == F.col("node_id"), "left")
        return found.orderBy("start_ord", "depth", "node").select("depth", "via", "type", F.coalesce("qualified", "path").alias("name"), F.col("path").alias("file"), "line")

    def outline(self, file_path: str) -> DataFrame:
        return lookup.outline(self.table("symbols"), file_path)

    def stats(self) -> dict:
        row = lookup.index_stats(*[self.table(t) for t in ("chunks", "symbols", "nodes", "edges")]).first().asDict()
        row["chunks_by_language"] = {r.language: r.chunks for r in lookup.language_counts(self.table("chunks")).collect()}
        row["embedder"] = self.tables.meta["embedder"]
        return row


class SegmentedIndex(CodeIndex):
    """The same over an index that is kept as segments; blocks of postings and vectors are skipped by their bounds.

    Scores of both legs are rounded, so that equal texts tie wherever they lie.
    """

    def __init__(self, store: SegmentStore) -> None:
        self.spark, self.tables = store.spark, store

    def _by_terms(self, terms: DataFrame, candidates: int) -> DataFrame:
        held = self.tables.posting_blocks()
        return blocks.best(blocks.search(held, materialize(terms, "query-terms"), candidates, RESULT_DECIMALS), held, candidates, "ord")

    def _by_vectors(self, vectors: DataFrame, candidates: int) -> DataFrame:
        return dense_blocks.nearest(self.tables.rows("vectors"), vectors, candidates, round_to=RESULT_DECIMALS)
