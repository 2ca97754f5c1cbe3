"""Queries on tokens, BM25, dense vectors and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.hashing import bucket, sign
from lodestrata.functions.terms import hashed_rows
from lodestrata.functions.text import boosted_terms, chunk_id, embedded_text, split_identifier, tokenize
from lodestrata.operators import dense, dense_blocks, fusion, lexical, lexical_tasks, lookup
from lodestrata.plans.inputs import QuerySet, CANDIDATES, QUERY, SQL_DOCUMENT_TOKENS, document_texts, document_tokens, sql_bm25, sql_hashed, sql_tokens, stated, table, values
from lodestrata.storage import materialize, spread

OWN = QuerySet()
register = OWN.register


IDENTIFIERS = [(1, "getUserById"), (2, "parse_config_file"), (3, "HTTPServerError"), (4, "MAX_RETRY_2x"), (5, "__init__"), (6, "class"), (7, "a1B2"), (8, "x"), (9, "ABCd_eF"), (10, "")]


@register("split_identifier", "WITH " + values("ids", "id, ident", IDENTIFIERS) + r""" SELECT id, array_to_string(list_transform(regexp_extract_all(regexp_replace(ident, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda s: lower(s)), ' ') AS parts FROM ids""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, IDENTIFIERS, "id int, ident string").select("id", F.array_join(split_identifier(F.col("ident")), " ").alias("parts"))


@register("tokenize_terms", f"WITH {SQL_DOCUMENT_TOKENS} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM tokens")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@register("doc_length_stats", f"WITH {SQL_DOCUMENT_TOKENS} SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(sum(len(t)) / count(*), 6) AS avgdl FROM tokens")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    dl = lexical.lengths(document_tokens(spark, sf_dir), "doc_id")
    return dl.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.sum("dl") / F.count("*"), 6).alias("avgdl"))


@register("term_doc_freq", f"WITH {SQL_DOCUMENT_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tokens) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's distinct terms and all its terms leave it in one pass, so one shuffle by term is enough.
    marked = lambda c, first: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))
    terms = document_tokens(spark, sf_dir).select(F.explode_outer(F.concat(marked(F.array_distinct("tokens"), 1), marked("tokens", 0))).alias("x"))
    return terms.where("x is not null").groupBy("x.term").agg(F.sum("x.first").alias("df"), F.sum(1 - F.col("x.first")).alias("cf"))


def fixed_query_scores(tokens: DataFrame, query: str, key: str = "doc_id", round_to: int = 6) -> DataFrame:
    """BM25 of one stated query without postings: its few terms are counted while tokens pass by.

    What is kept is a row of small numbers for each document; its statistics need no second pass
    over texts, and nothing is exploded or shuffled.
    """
    spark = tokens.sparkSession
    asked = [r.term for r in spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).collect()]
    terms = sorted(set(asked))
    occurrences = lambda w: F.size(F.filter("tokens", lambda t: t == w)).cast("long")
    counts = [occurrences(w).alias(f"tf{k}") for k, w in enumerate(terms)]
    rows = materialize(tokens.select(key, F.size("tokens").cast("long").alias("dl"), *counts), "counts")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))])
    n, avgdl = F.col("n"), F.col("avgdl")
    parts = [F.when(F.col(f"tf{k}") > 0, lexical.contribution(lexical.idf(n, F.col(f"df{k}")), F.col(f"tf{k}"), F.col("dl"), avgdl, F.lit(asked.count(w)))).otherwise(0.0) for k, w in enumerate(terms)]
    some = F.greatest(*[F.col(f"tf{k}") for k in range(len(terms))]) > 0 if len(terms) > 1 else F.col("tf0") > 0
    return rows.where(some).crossJoin(F.broadcast(facts)).select(F.lit(1).alias("query_id"), key, F.round(sum(parts, F.lit(0.0)), round_to).alias("score"))


_ONE = values("queries", "query_id, text", [(1, QUERY)])


@register("bm25_topk", f"WITH {_ONE}, {SQL_DOCUMENT_TOKENS}, {sql_bm25('queries')} SELECT doc_id, score FROM bm25 WHERE rank < {CANDIDATES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_query_scores(document_tokens(spark, sf_dir), QUERY).orderBy(F.desc("score"), "doc_id").limit(CANDIDATES).select("doc_id", "score")


@register("bm25_batch", f"WITH queries AS (SELECT item_id AS query_id, text FROM benchmark), {SQL_DOCUMENT_TOKENS}, {sql_bm25('queries')} SELECT query_id, doc_id, score, rank + 1 AS rank FROM bm25 WHERE rank < 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenize(F.col("text")).alias("q"))
    found = lexical_tasks.best_documents(document_texts(spark, sf_dir), lexical.query_terms(queries, F.col("q")), 5, round_to=6)
    return found.withColumn("rank", F.col("rank") + 1)


@register("bm25_field_boost", f"WITH tokens AS (SELECT doc_id, list_concat({sql_tokens('text')}, {sql_tokens('lang')}, {sql_tokens('lang')}, {sql_tokens('lang')}, {sql_tokens('source')}) AS t FROM documents), {values('queries', 'query_id, text', [(1, 'fr src7 onerth')])}, {sql_bm25('queries')} SELECT doc_id, score FROM bm25 WHERE rank < {CANDIDATES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    tokens = docs.select("doc_id", boosted_terms(F.col("text"), F.col("lang"), F.lit(""), F.col("source")).alias("tokens"))
    return fixed_query_scores(tokens, "fr src7 onerth").orderBy(F.desc("score"), "doc_id").limit(CANDIDATES).select("doc_id", "score")


@register("hash_bucket", f"WITH {SQL_DOCUMENT_TOKENS}, terms AS (SELECT DISTINCT unnest(t) AS term FROM tokens) SELECT term, ('0x' || substr(md5(term), 1, 2))::INT + 256 * (('0x' || substr(md5(term), 3, 2))::INT % 2) AS bucket, CASE WHEN ('0x' || substr(md5(term), 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM terms")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.exploded(document_tokens(spark, sf_dir)).distinct()
    return terms.select("term", bucket(F.col("term")).alias("bucket"), sign(F.col("term")).alias("sign"))


@register("hash_embed_norm", f"WITH {SQL_DOCUMENT_TOKENS}, {sql_hashed('tokens', 'doc_id', 'v', True)} SELECT doc_id, count(*) AS nnz, round(sum(w * w), 4) AS norm FROM v GROUP BY doc_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = dense.hashed_vectors(document_tokens(spark, sf_dir), "doc_id")
    return vectors.groupBy("doc_id").agg(F.count("*").alias("nnz"), F.round(F.sum(F.col("w") * F.col("w")), 4).alias("norm"))


def _dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stated(spark, [(1, QUERY)], "query_id int, text string").select("query_id", tokenize(F.col("text")).alias("tokens"))
    queries = dense.hashed_vectors(asked, "query_id", round_to=None)
    return dense_blocks.nearest(hashed_rows(document_texts(spark, sf_dir), "doc_id"), queries, CANDIDATES, key="doc_id", round_to=5)


_DENSE = f"{sql_hashed('tokens', 'doc_id', 'dv', True)}, qtok AS (SELECT query_id, {sql_tokens('text')} AS t FROM queries), {sql_hashed('qtok', 'query_id', 'qv', False)}, ds AS (SELECT d.doc_id, round(coalesce(s, 0), 5) AS score FROM tokens d LEFT JOIN (SELECT doc_id, sum(dv.w * qv.w) AS s FROM dv JOIN qv USING (bucket) GROUP BY doc_id) x ON d.doc_id = x.doc_id), dense AS (SELECT 1 AS query_id, *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ds)"


@register("dense_hash_topk", f"WITH {_ONE}, {SQL_DOCUMENT_TOKENS}, {_DENSE} SELECT doc_id, score FROM dense WHERE rank < {CANDIDATES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_hits(spark, sf_dir).select("doc_id", "score")


@register("vector_topk", f"SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT {CANDIDATES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # One row at most, whatever the table holds.
    query = vectors.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return vectors.crossJoin(F.broadcast(query)).select("vec_id", F.round(dense.dot(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(CANDIDATES)


@register("vector_store_round", "SELECT vec_id, round(sum(round(x::DOUBLE, 6)), 4) AS total, count(*) AS dim FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select("vec_id", dense.rounded(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return stored.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").cast("long").alias("dim"))


_FUSED = f"WITH {_ONE}, {SQL_DOCUMENT_TOKENS}, {sql_bm25('queries')}, {_DENSE}, legs AS (SELECT doc_id, 'bm25' AS source, 1.0 / (61 + rank) AS share FROM bm25 WHERE rank < {CANDIDATES} UNION ALL SELECT doc_id, 'dense', 0.9 / (61 + rank) FROM dense WHERE rank < {CANDIDATES}), fused AS (SELECT doc_id, round(sum(share), 6) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM legs GROUP BY doc_id)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stated(spark, [(1, QUERY)], "query_id int, text string").select("query_id", tokenize(F.col("text")).alias("q"))
    best = lexical_tasks.best_documents(document_texts(spark, sf_dir), lexical.query_terms(asked, F.col("q")), CANDIDATES, round_to=6)
    legs = {"bm25": best, "dense": _dense_hits(spark, sf_dir)}
    fused = fusion.reciprocal_rank_fusion(legs, key="doc_id")
    return fused.select("doc_id", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


@register("rrf_hybrid", _FUSED + " SELECT doc_id, score, sources FROM fused")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@register("language_filter", _FUSED + " SELECT f.doc_id, lang, score FROM fused f JOIN documents d ON f.doc_id = d.doc_id WHERE lang = 'en' ORDER BY score DESC, f.doc_id LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The filter acts on the candidates, so it stands above their cut.
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return langs.join(F.broadcast(_fused(spark, sf_dir)), "doc_id").where("lang = 'en'").orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "lang", "score")


RANKINGS = [("bm25", "a", 0), ("bm25", "b", 1), ("bm25", "c", 2), ("dense", "b", 0), ("dense", "a", 1), ("dense", "d", 2), ("other", "d", 0)]


@register("rrf_stated", "WITH " + values("legs", "source, doc, rank", RANKINGS) + " SELECT doc, round(sum(CASE source WHEN 'bm25' THEN 1.0 WHEN 'dense' THEN 0.9 ELSE 1.0 END / (61 + rank)), 8) AS score, string_agg(source, '+' ORDER BY source) AS sources FROM legs GROUP BY doc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stated(spark, RANKINGS, "source string, doc string, rank int").withColumn("query_id", F.lit(1))
    legs = {s: every.where(F.col("source") == s) for s in ("bm25", "dense", "other")}
    return fusion.reciprocal_rank_fusion(legs, key="doc").select("doc", F.round("score", 8).alias("score"), F.array_join("sources", "+").alias("sources"))


@register("embed_text", "SELECT doc_id, md5(concat_ws(chr(10), source, nullif(lang, ''), text[1:4000])) AS embed_md5 FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(embedded_text(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))).alias("embed_md5"))


@register("chunk_id", "SELECT doc_id, substr(sha1(source || chr(0) || doc_id || chr(0) || text[1:64]), 1, 16) AS chunk_id FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunk_id(F.col("source"), F.col("doc_id"), F.substring("text", 1, 64)).alias("chunk_id"))


@register("stats_by_language", "SELECT lang AS language, count(*) AS chunks FROM documents GROUP BY lang")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.language_counts(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")))


