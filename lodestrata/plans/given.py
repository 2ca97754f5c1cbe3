"""The engine's operators over the given tables: names of parts, addresses of pages, texts and their ranks, orders as versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.answer import HIT, extract_text
from lodestrata.functions.parsing import parse_files
from lodestrata.functions.text import language_of, module_of, split_identifier, tokenize
from lodestrata.operators import fusion, graph, lexical, lexical_tasks, ranking, resolve
from lodestrata.plans.inputs import CANDIDATES, SQL_DOCUMENT_TOKENS, QuerySet, document_texts, sql_bm25, table
from lodestrata.sources.repos import plan_sync
from lodestrata.sources.tree import ignored
from lodestrata.storage import materialize

OWN = QuerySet()
register = OWN.register


# -- names ---------------------------------------------------------------------------------------


@register("part_identifiers", r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(ident, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda s: lower(s)), ' ') AS parts FROM (SELECT p_partkey, 'HTTP' || replace(p_brand, '#', '') || '_' || replace(p_name, ' ', '_') || p_type AS ident FROM part)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.lit("HTTP"), F.regexp_replace("p_brand", "#", ""), F.lit("_"), F.regexp_replace("p_name", " ", "_"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(split_identifier(ident), " ").alias("parts"))


@register(
    "part_names",
    """WITH sym AS (SELECT p_partkey AS ord, p_name || ' ' || p_size AS name, p_type AS file_path, p_brand || '.' || p_name AS qualified FROM part),
    pend AS (SELECT 'own:' || ord AS src, file_path, name FROM sym UNION ALL SELECT 'far:' || p_partkey, p_brand, p_name || ' ' || p_size FROM part),
    near AS (SELECT name, file_path, arg_min(qualified, ord) AS qualified FROM sym GROUP BY ALL), every AS (SELECT name, count(*) AS n, arg_min('sym:' || file_path || '::' || qualified, ord) AS dst FROM sym GROUP BY name)
    SELECT src, CASE WHEN near.name IS NOT NULL THEN 'sym:' || near.file_path || '::' || near.qualified ELSE dst END AS dst FROM pend JOIN every USING (name) LEFT JOIN near ON near.name = pend.name AND near.file_path = pend.file_path WHERE near.name IS NOT NULL OR n <= 3""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is asked for from its own file and from one that has none of its name."""
    parts = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_size"))
    symbols = parts.select(F.col("p_partkey").alias("ord"), "name", F.col("p_type").alias("file_path"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"))
    asked = [parts.select(F.concat(F.lit(prefix), F.col("p_partkey")).alias("src"), F.col(at).alias("file_path"), "name") for prefix, at in (("own:", "p_type"), ("far:", "p_brand"))]
    return resolve.resolve_names(asked[0].unionByName(asked[1]), symbols)


@register(
    "account_nodes",
    """WITH rows AS (SELECT c_custkey AS ord, 'nation:' || c_nationkey AS node_id, CASE WHEN c_acctbal > 0 THEN c_name END AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_custkey END AS line FROM customer
      UNION ALL SELECT 1000000000000 + s_suppkey, 'nation:' || s_nationkey, CASE WHEN s_acctbal > 5000 THEN s_name END, NULL FROM supplier)
    SELECT node_id, arg_max(name, ord) FILTER (name IS NOT NULL) AS name, arg_max(line, ord) FILTER (line IS NOT NULL) AS line FROM rows GROUP BY node_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of customers and suppliers, the last known ones, on the nodes of their nations."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    node = lambda c: F.concat(F.lit("nation:"), F.col(c)).alias("node_id")
    rows = customers.select(F.col("c_custkey").alias("ord"), node("c_nationkey"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "FURNITURE", F.col("c_custkey")).alias("line"))
    more = suppliers.select((F.col("s_suppkey") + 1_000_000_000_000).alias("ord"), node("s_nationkey"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("name"), F.lit(None).cast("long").alias("line"))
    return graph.merge_nodes(rows.unionByName(more))


# -- paths: a page's address without its query, as a Python file -----------------------------------

_PAGES = r"p AS (SELECT page_id, regexp_replace(regexp_extract(coalesce(url, ''), '^[a-z]+://([^?#]*)', 1), '(\.html)?/*$', '') || '.py' AS file_path FROM pages)"
_MODULE = r"nullif(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(file_path, '\.py$', ''), '/__init__$', ''), '/'), lambda s: s NOT IN ('', '.', 'src')), '.'), '')"


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(address, r"(\.html)?/*$", ""), F.lit(".py")).alias("file_path"))


@register("page_modules", f"WITH {_PAGES} SELECT page_id, {_MODULE} AS module FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_files(spark, sf_dir).select("page_id", module_of(F.col("file_path")).alias("module"))


@register(
    "page_imports",
    rf"""WITH {_PAGES}, files AS (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS folder, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.py$', '') AS name, {_MODULE} AS module FROM p),
    asked AS (SELECT file_path, './' || name AS module, folder || '/' || name || '.py' AS probe FROM files UNION ALL SELECT file_path, '../fr/' || name, regexp_replace(folder, '/?[^/]*$', '') || '/fr/' || name || '.py' FROM files),
    dotted AS (SELECT f.file_path, f.module || '.none.at_all' AS module, max(g.file_path) AS target FROM files f JOIN files g ON f.module = g.module GROUP BY ALL)
    SELECT file_path, module, probe AS target FROM asked WHERE probe IN (SELECT file_path FROM files) UNION ALL SELECT * FROM dotted""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page imports its own name beside it, the same in French, and something that its module doesn't have."""
    files = materialize(_page_files(spark, sf_dir).select("file_path").distinct(), "page-files")
    name = F.regexp_replace(F.regexp_extract("file_path", r"[^/]*$", 0), r"\.py$", "")
    modules = F.array(F.concat(F.lit("./"), name), F.concat(F.lit("../fr/"), name), F.concat(module_of(F.col("file_path")), F.lit(".none.at_all")))
    return resolve.resolve_modules(files.select("file_path", F.explode(modules).alias("module")).where("module is not null"), files)


@register("ignored_pages", f"WITH {_PAGES} SELECT page_id, starts_with(file_path, 'spam-farm.example.org/') OR contains(file_path, '/de/') OR regexp_matches(file_path, '(^|/)1[^/]*\\.py$') AS skipped FROM p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_files(spark, sf_dir).select("page_id", ignored("file_path", ["/spam-farm.example.org", "*/de/*", "1*.py"]).alias("skipped"))


# -- sources written from documents, one language for each of theirs -----------------------------------

_ENDINGS = {"en": ("py", "python"), "fr": ("js", "javascript"), "de": ("GO", "go"), "es": ("x.rb", "ruby")}


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_path, language, content): a class or a function that has the document's number, and imports its source."""
    number, source = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("none"))
    bodies = {
        "en": F.concat(F.lit("import os\nfrom m."), source, F.lit(" import y\n\n\nclass C"), number, F.lit("(Base):\n    def run(self):\n        return go(1)\n")),
        "fr": F.concat(F.lit("import { u } from './"), source, F.lit("';\n\nexport function f"), number, F.lit("(a) {\n  return a;\n}\n")),
        "de": F.concat(F.lit('package main\n\nimport "a/'), source, F.lit('"\n\nfunc (c *Cart) T'), number, F.lit("() int {\n  return 1\n}\n")),
        "es": F.concat(F.lit("require '"), source, F.lit("'\nclass K"), number, F.lit("\n  def t\n    1\n  end\nend\n")),
    }
    pick = lambda found: F.coalesce(*[F.when(F.col("lang") == k, c) for k, c in found.items()])
    path = F.concat(source, F.lit("/"), number, F.lit("."), pick({k: F.lit(e) for k, (e, _) in _ENDINGS.items()}))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").where(F.col("lang").isin(*_ENDINGS))
    return docs.select("doc_id", path.alias("file_path"), language_of(path).alias("language"), pick(bodies).alias("content"))


_SOURCES = "src AS (SELECT doc_id, coalesce(source, 'none') AS source, lang, coalesce(source, 'none') || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.GO' ELSE '.x.rb' END AS file_path FROM documents WHERE lang IN ('en', 'fr', 'de', 'es'))"


@register("source_languages", f"WITH {_SOURCES} SELECT doc_id, file_path, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'ruby' END AS language FROM src")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_files(spark, sf_dir).select("doc_id", "file_path", "language")


@register(
    "source_symbols",
    f"""WITH {_SOURCES} SELECT file_path, CASE lang WHEN 'en' THEN 'C' WHEN 'fr' THEN 'f' WHEN 'de' THEN 'T' ELSE 'K' END || doc_id AS qualified_name, CASE WHEN lang IN ('en', 'es') THEN 'class' ELSE 'function' END AS kind,
      CASE lang WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 5 END AS start_line, CASE lang WHEN 'fr' THEN 5 WHEN 'es' THEN 6 ELSE 7 END AS end_line, CASE lang WHEN 'en' THEN 'Base' ELSE '' END AS bases, CASE lang WHEN 'en' THEN 'go' ELSE '' END AS calls FROM src
    UNION ALL SELECT file_path, 'C' || doc_id || '.run', 'method', 6, 7, '', 'go' FROM src WHERE lang = 'en'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_files(_source_files(spark, sf_dir).drop("doc_id")).select(F.explode("symbols").alias("s"))
    return parsed.select("s.file_path", "s.qualified_name", "s.kind", "s.start_line", "s.end_line", F.array_join("s.bases", ",").alias("bases"), F.array_join("s.calls", ",").alias("calls"))


@register("source_imports", f"WITH {_SOURCES} SELECT file_path, CASE lang WHEN 'en' THEN 'm.' || source WHEN 'fr' THEN './' || source WHEN 'de' THEN 'a/' || source ELSE source END AS module FROM src UNION ALL SELECT file_path, 'os' FROM src WHERE lang = 'en'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(_source_files(spark, sf_dir).drop("doc_id")).select("file_path", F.explode("imports").alias("module"))


# -- ranked hits: documents as chunks, the pairs of a line item as calls ------------------------------------

_ASKED = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
_RANKS = f"WITH {_ASKED}, {SQL_DOCUMENT_TOKENS}, {sql_bm25('queries')}"
_HITS = f"""{_RANKS}, fused AS (SELECT query_id, doc_id::VARCHAR AS chunk_id, 1.0::DOUBLE / (61 + rank) AS score FROM bm25 WHERE rank < {CANDIDATES}),
own AS (SELECT doc_id::VARCHAR AS chunk_id, lang AS language, CASE WHEN lang IN ('en', 'de') THEN 'function' ELSE 'block' END AS kind FROM documents),
e AS (SELECT DISTINCT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b FROM lineitem WHERE l_partkey <> l_suppkey), near AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
linked AS (SELECT DISTINCT f.query_id, f.chunk_id FROM fused f JOIN near ON near.a = f.chunk_id JOIN fused g ON g.query_id = f.query_id AND g.chunk_id = near.b),
hits AS (SELECT f.query_id, o.*, score, score * CASE WHEN kind = 'function' THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN l.chunk_id IS NULL THEN 1 ELSE 1.1::DOUBLE END AS final FROM fused f JOIN own o USING (chunk_id) LEFT JOIN linked l ON l.query_id = f.query_id AND l.chunk_id = f.chunk_id)"""


def _top_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of every benchmark text."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenize(F.col("text")).alias("q"))
    return lexical_tasks.best_documents(document_texts(spark, sf_dir), lexical.query_terms(asked, F.col("q")), k, round_to=6)


def _ranked(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    number, symbol = F.col("doc_id").cast("string"), lambda c: F.concat(F.lit("sym:docs::"), F.col(c))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), number.alias("chunk_id"), F.lit("docs").alias("file_path"), F.col("lang").alias("language"), F.when(F.col("lang").isin("en", "de"), "function").otherwise("block").alias("kind"), number.alias("symbol"))
    calls = table(spark, sf_dir, "lineitem").select(symbol("l_partkey").alias("src"), symbol("l_suppkey").alias("dst"), F.lit("calls").alias("edge_type"))
    fused = fusion.reciprocal_rank_fusion({"bm25": _top_documents(spark, sf_dir, CANDIDATES)}, key="doc_id").withColumn("chunk_id", number)
    return ranking.ranked_hits(fused, chunks, graph.typed_edges(calls), **options).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _sql_ranked(where: str) -> str:
    return f"{_HITS} SELECT query_id, rank, chunk_id, round(final, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, score DESC, chunk_id) AS rank FROM hits WHERE {where}) WHERE rank <= 10"


@register("ranked_documents", _sql_ranked("true"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@register("ranked_documents_by_kind", _sql_ranked("kind = 'function'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, kind="function")


@register("ranked_documents_by_language", _sql_ranked("language = 'fr'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, language="fr")


# -- answers from those hits -------------------------------------------------------------------------------

ANSWER_HITS = 3
_ANSWERS = rf"""{_RANKS}, hits AS (SELECT query_id, rank, doc_id, lang, source, list_transform(regexp_split_to_array(regexp_replace(d.text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')[1:6], lambda r: '    ' || r[1:150]) AS rows FROM bm25 JOIN documents d USING (doc_id) WHERE rank < {ANSWER_HITS}),
lines AS (SELECT query_id, rank, '[' || (rank + 1) || '] ' || source || '/' || doc_id || ':1 — block' || chr(10) || array_to_string(rows, chr(10)) || chr(10) AS body FROM hits)
SELECT q.query_id, md5('Top matches for: ' || q.text || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY rank) || chr(10) || '(extractive mode — configure an LLM for synthesized answers)') AS answer_md5 FROM queries q JOIN lines USING (query_id) GROUP BY q.query_id, q.text"""


def _hit(docs: DataFrame) -> Column:
    none = F.lit(None).cast("string")
    values = {"file_path": F.concat_ws("/", "source", "doc_id"), "start_line": F.lit(1), "end_line": F.lit(1), "kind": F.lit("block"), "symbol": none, "language": F.col("lang"), "docstring": none, "text": F.col("text"), "related": F.array()}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(HIT)


@register("document_answers", _ANSWERS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts from the best documents of every benchmark text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # As many rows as there are benchmark texts, some times over.
    found = docs.join(F.broadcast(_top_documents(spark, sf_dir, ANSWER_HITS)), "doc_id").select("query_id", F.struct("rank", _hit(docs).alias("hit")).alias("h"))
    hits = found.groupBy("query_id").agg(F.array_sort(F.collect_list("h"))["hit"].alias("hits"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.join(hits, "query_id").select("query_id", F.md5(extract_text(F.col("text"), F.col("hits"))).alias("answer_md5"))


# -- repositories: customers by their last order ------------------------------------------------------------


@register(
    "sync_customers",
    """WITH repos AS (SELECT c_name AS full_name, strftime(max(o_orderdate), '%Y-%m-%d') AS pushed_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name),
    known AS (SELECT c_name AS full_name, strftime(max(o_orderdate), '%Y-%m-%d') AS stamp FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' GROUP BY c_name)
    SELECT r.full_name, pushed_at, CASE WHEN stamp = pushed_at AND c_acctbal > 0 THEN 'skip' ELSE 'fetch' END AS action FROM repos r LEFT JOIN known k ON k.full_name = r.full_name JOIN customer ON c_name = r.full_name""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order is the newest push, the last one that isn't open the copy that is held."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = lambda rows, name: rows.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("full_name")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias(name))
    return plan_sync(last(orders, "pushed_at"), last(orders.where("o_orderstatus <> 'O'"), "stamp"), customers.where("c_acctbal > 0").select(F.col("c_name").alias("full_name")))
