"""Terms, vectors and scores made within tasks: as the expressions and joins say, and without their shuffles."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrata.functions import terms
from lodestrata.functions.text import tokenize
from lodestrata.operators import blocks, dense, lexical, lexical_tasks
from lodestrata.storage import materialize

ODD = ["", None, "the of", "getUserById HTTPServerError parse_config_file MAX_RETRY_2x __init__ a1B2 x _ ABCd_eF", "Ünïcode naïve_Word aÄb\x00c", "x" * 100 + "Y " + "if IF If", "word " * 300 + "Word WORD wOrd", "9lives 1234 a_1 A1B22c"]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{k}Of{k % 7}" for k in range(80)] + ["alpha", "beta", "the"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(900)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_terms_are_the_expressions(docs):
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    found = terms.term_rows(docs, "doc_id", times={"text": 1})
    assert rows(found.select("doc_id", "dl")) == rows(lexical.lengths(tokens, "doc_id"))
    pairs = found.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").cast("array<long>").alias("tf"))), "doc_id").select("term", "doc_id", "tf")
    assert rows(pairs) == rows(lexical.postings(tokens, "doc_id"))
    some = terms.term_rows(docs, "doc_id", times={"text": 1}, vocabulary=["alpha", "nowhere"])
    assert rows(some.select("doc_id", "dl")) == rows(found.select("doc_id", "dl"))
    assert rows(some.where("size(terms) > 0").select("doc_id", F.col("tfs")[0].cast("long").alias("tf"))) == rows(pairs.where("term = 'alpha'").select("doc_id", "tf"))


def test_vectors_are_the_expressions(docs):
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    made = terms.hashed_rows(docs, "doc_id")
    assert made.count() == docs.count()
    assert rows(dense.long_form(made, "doc_id")) == rows(dense.hashed_vectors(tokens, "doc_id"))


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_best_documents_are_all_pairs_best(spark, docs, k, monkeypatch):
    asked = spark.createDataFrame([(1, "w1Of1 w1Of1 w1Of1 alpha"), (2, "nowhere"), (3, "w2of2 beta w9Of2"), (4, "")], "query_id int, text string")
    queries = lexical.query_terms(asked.select("query_id", tokenize(F.col("text")).alias("q")), F.col("q"))
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    scores = lexical.bm25_scores(lexical.postings(tokens, "doc_id"), lexical.lengths(tokens, "doc_id"), queries, key="doc_id", round_to=6)
    want = rows(lexical.top_candidates(scores, k, "doc_id").select("query_id", "doc_id", "score", "rank"))
    assert rows(lexical_tasks.best_documents(docs, queries, k, round_to=6)) == want and want
    monkeypatch.setattr(lexical_tasks, "QUERIES", 1)
    monkeypatch.setattr(lexical_tasks, "CONTRIBUTIONS", 1)
    assert rows(lexical_tasks.best_documents(docs, queries, k, round_to=6)) == want
    assert lexical_tasks.best_documents(docs, queries.where("false"), k).count() == 0
    assert lexical_tasks.best_documents(docs.where("false"), queries, k).count() == 0


@pytest.mark.parametrize("name", ["bm25_batch", "bm25_block_max", "ranked_documents", "document_answers", "language_filter", "dense_block_topk"])
def test_only_each_tasks_best_are_shuffled(spark, sf_dir, name):
    """No posting, vector or pair of a query and a document: it would be dealt by term, bucket or document."""
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and line.split("hashpartitioning(")[1].split("#")[0] in ("term", "bucket", "doc_id")]


def test_blocks_of_counts_are_those_of_tokens(docs):
    counts, (n, words, postings) = blocks.stored_counts(terms.term_rows(docs, "doc_id", times={"text": 1}))
    placed = materialize(blocks.ranged(counts, 3, "doc_id"), "places")
    assert n == docs.count() and placed.groupBy("range").count().where("count > 16").count() == 0
    assert [r.doc_id for r in placed.orderBy("range", "slot").collect()] == list(range(n))
    assert placed.select("range", F.input_file_name().alias("p")).distinct().groupBy("range").count().where("count > 1").count() == 0
    made = blocks.counted_blocks(placed, 2).select("range", "term", "n", "terms", "peaks", "entries")
    texts = placed.select("range", "slot", "doc_id").join(docs, "doc_id")
    want = blocks.posting_blocks(texts, tokenize(F.col("text")))
    assert rows(made) == rows(want) and made.agg(F.sum("n"), F.sum("terms")).first() == (postings, words)


def test_tasks_hold_no_more_of_more_postings():
    assert blocks.tasks_for(0) == 1 and blocks.tasks_for(100 * blocks.POSTINGS_PER_TASK) == 100
