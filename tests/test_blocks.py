"""Bounds of posting and vector blocks: the same hits with less read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.text import tokenize
from lodestrata.operators import blocks, dense, dense_blocks, lexical
from lodestrata.plans.inputs import document_tokens
from lodestrata.plans.segmented import document_blocks, query_vectors
from lodestrata.sources.index import numbered
from lodestrata.storage import materialize


def hits(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    words = [f"word{k}" for k in range(60)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words[5 * (k % 9) : 5 * (k % 9) + 20], rng.integers(1, 40))) for k in range(400)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return materialize(docs.select("doc_id", F.lit("x").alias("lang"), tokenize(F.col("text")).alias("tokens")), "tokens")


def built(tokens, dead=None):
    placed = materialize(blocks.in_ranges(numbered(tokens, "doc_id"), bits=3), "ranges")
    living = placed if dead is None else placed.join(dead, "doc_id", "left_anti")
    size = living.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    gone = None if dead is None else placed.join(dead, "doc_id").select("range", "slot")
    return blocks.Blocks(placed.select("range", "slot", "doc_id"), materialize(blocks.posting_blocks(placed, F.col("tokens")), "blocks"), tuple(size), gone)


def asked(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    return rows, materialize(lexical.query_terms(rows.select("query_id", tokenize(F.col("text")).alias("q")), F.col("q")), "terms")


QUERIES = ("word1 word2 word2", "word59", "nowhere", "", "word10 word30 word50 word10 word10", "word7")


def test_same_hits_as_all_postings(spark, corpus):
    _, terms = asked(spark, *QUERIES)
    want = lexical.top_candidates(lexical.bm25_scores(lexical.postings(corpus, "doc_id"), lexical.lengths(corpus, "doc_id"), terms, key="doc_id", round_to=6), 7, key="doc_id")
    held = built(corpus)
    found = blocks.search(held, terms, 7, round_to=6, seeds=2)
    assert hits(blocks.best(found, held, 7, "doc_id")) == hits(want.select("query_id", "doc_id", "score", "rank"))
    effort = {r.query_id: (r.blocks, r.blocks_read) for r in found.effort.collect()}
    assert set(effort) == {0, 1, 4, 5} and all(0 < read <= every for every, read in effort.values())
    assert sum(read for _, read in effort.values()) < sum(every for every, _ in effort.values())


def test_dead_documents_leave_as_if_never_there(spark, corpus):
    _, terms = asked(spark, *QUERIES)
    dead = corpus.where("doc_id % 3 = 0").select("doc_id")
    left = materialize(corpus.where("doc_id % 3 <> 0"), "left")
    held, plain = built(corpus, dead), built(left)
    same = [hits(blocks.best(blocks.search(b, terms, 5, round_to=6), b, 5, "doc_id")) for b in (held, plain)]
    assert same[0] == same[1] and same[0]


def test_peaks_bound_every_posting(spark, corpus):
    for r in built(corpus).postings.collect():
        assert r.n == len(r.entries) and len(r.peaks) <= r.n
        for e in r.entries:
            assert any(p.tf >= e.tf and p.dl <= -e.less for p in r.peaks)
        assert all((p.tf, p.dl) in {(e.tf, -e.less) for e in r.entries} for p in r.peaks)


def test_share_of_blocks_read(spark, sf_dir):
    """Over the documents, every benchmark text as a query."""
    terms = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), tokenize(F.col("text")).alias("q"))
    found = blocks.search(document_blocks(spark, sf_dir), materialize(lexical.query_terms(terms, F.col("q")), "terms"), 5, round_to=6)
    every, read = found.effort.agg(F.sum("blocks"), F.sum("blocks_read")).first()
    assert 0 < read < every


def test_empty_tables(spark, corpus):
    _, terms = asked(spark, *QUERIES)
    none = built(corpus.where("false"))
    assert blocks.search(none, terms, 3).hits.count() == 0
    assert blocks.search(built(corpus), terms.where("false"), 3).hits.count() == 0


@pytest.mark.parametrize("k", [1, 9, 1000])
def test_nearest_vectors_are_all_vectors_best(spark, corpus, k):
    queries, _ = asked(spark, *QUERIES)
    vectors = materialize(dense.hashed_vectors(corpus, "doc_id"), "vectors")
    rows = dense_blocks.vector_rows(vectors, corpus, "doc_id")
    want = dense.nearest(vectors, query_vectors(queries), corpus, k, key="doc_id", round_to=5)
    assert hits(dense_blocks.nearest(rows, query_vectors(queries), k, key="doc_id", round_to=5)) == hits(want.select("query_id", "doc_id", "score", "rank"))


def test_queries_in_passes(spark, corpus, monkeypatch):
    queries, _ = asked(spark, *QUERIES)
    rows = materialize(dense_blocks.vector_rows(dense.hashed_vectors(corpus, "doc_id"), corpus, "doc_id"), "rows")
    whole = hits(dense_blocks.nearest(rows, query_vectors(queries), 4, key="doc_id", round_to=5))
    monkeypatch.setattr(dense_blocks, "QUERIES", 2)
    assert hits(dense_blocks.nearest(rows, query_vectors(queries), 4, key="doc_id", round_to=5)) == whole
    assert dense_blocks.nearest(rows.where("false"), query_vectors(queries), 4, key="doc_id").count() == 0
    assert dense_blocks.nearest(rows, query_vectors(queries).where("false"), 4, key="doc_id").count() == 0


def test_bounds_leave_blocks_out():
    """Blocks that can't place a row are not multiplied; results are those of all products."""
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(3, 16))
    best = dense_blocks.Best(queries, 4, None)
    near = [q + 0.01 * rng.normal(size=(8, 16)) for q in queries]
    far = [0.05 * rng.normal(size=(8, 16)) for _ in range(20)]
    for n, block in enumerate(near + far):
        best.add([100 * n + i for i in range(8)], block)
    every = np.concatenate(near + far)
    keys = [100 * n + i for n in range(23) for i in range(8)]
    for q, held in zip(queries, best.held, strict=True):
        assert [key for _, key in held] == [keys[i] for i in np.argsort(-(every @ q), kind="stable")[:4]]
    assert best.scored < best.asked


def test_document_tokens_are_whole(spark, sf_dir):
    held = document_blocks(spark, sf_dir)
    counted = held.postings.select(F.explode("entries").alias("e")).agg(F.sum("e.tf")).first()[0]
    assert (held.documents.count(), counted) == held.size == tuple(document_tokens(spark, sf_dir).agg(F.count("*"), F.sum(F.size("tokens"))).first())
