"""Queries on graphs, names, files and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import language_of, module_of
from lodestrata.operators import graph, lookup, ranking, resolve
from lodestrata.plans.inputs import QuerySet, stated, table, values
from lodestrata.sources.index import diff_files, numbered
from lodestrata.sources.repos import plan_sync
from lodestrata.sources.tree import ignored

OWN = QuerySet()
register = OWN.register


# A typed graph over the star schema: parts contain suppliers' offers, suppliers call their nation,
# nations inherit from their region; and pages import what they link to.
_EDGES = """edges AS (
  SELECT DISTINCT 'part:' || l_partkey AS src, 'supp:' || l_suppkey AS dst, 'calls' AS edge_type FROM lineitem
  UNION SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'calls' FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'inherits' FROM nation
  UNION SELECT 'region:' || r_regionkey, 'nation:' || n_nationkey, 'contains' FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION SELECT 'nation:' || c_nationkey, 'cust:' || c_custkey, 'imports' FROM customer)"""


def _edge_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The graph's edges by their tables; an edge may come more than once."""

    def part(name: str, src: str, src_col: str, dst: str, dst_col: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(src), F.col(src_col)).alias("src"), F.concat(F.lit(dst), F.col(dst_col)).alias("dst"), F.lit(kind).alias("edge_type"))

    return [
        part("lineitem", "part:", "l_partkey", "supp:", "l_suppkey", "calls"),
        part("supplier", "supp:", "s_suppkey", "nation:", "s_nationkey", "calls"),
        part("nation", "nation:", "n_nationkey", "region:", "n_regionkey", "inherits"),
        part("nation", "region:", "n_regionkey", "nation:", "n_nationkey", "contains"),
        part("customer", "nation:", "c_nationkey", "cust:", "c_custkey", "imports"),
    ]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.typed_edges(*_edge_parts(spark, sf_dir))


def _start(spark: SparkSession, *nodes: str) -> DataFrame:
    return stated(spark, [(n,) for n in nodes], "start string")


@register("graph_edges", f"WITH {_EDGES} SELECT src, dst, edge_type FROM edges WHERE src <> dst")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@register("page_links", "SELECT DISTINCT 'page:' || page_id AS src, 'page:' || href AS dst, 'imports' AS edge_type FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    return graph.typed_edges(hrefs.select(F.concat(F.lit("page:"), "page_id").alias("src"), F.concat(F.lit("page:"), "href").alias("dst"), F.lit("imports").alias("edge_type")))


@register("graph_adjacency", f"WITH {_EDGES} SELECT edge_type, src, count(*) AS degree, md5(string_agg(dst, ',' ORDER BY dst)) AS dsts_md5 FROM edges GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_edges(spark, sf_dir)).select("edge_type", "src", F.size("dsts").cast("long").alias("degree"), F.md5(F.array_join("dsts", ",")).alias("dsts_md5"))


@register("graph_round_trip", f"WITH {_EDGES} SELECT edge_type, count(*) AS edges FROM edges GROUP BY edge_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.from_adjacency(graph.adjacency(_edges(spark, sf_dir))).groupBy("edge_type").agg(F.count("*").alias("edges"))


for _name, _f, _at, _from, _to, _type in (
    ("callers", graph.callers_of, "supp:1", "dst", "src", "calls"),
    ("callees", graph.callees_of, "part:1", "src", "dst", "calls"),
    ("subclasses", graph.subclasses_of, "region:1", "dst", "src", "inherits"),
    ("importers", graph.importers_of, "cust:1", "dst", "src", "imports"),
):
    register(_name, f"WITH {_EDGES} SELECT {_from} AS start, {_to} AS node FROM edges WHERE edge_type = '{_type}' AND {_from} = '{_at}'")(lambda spark, sf_dir, f=_f, at=_at: f(_edges(spark, sf_dir), _start(spark, at)))


@register(
    "impact_bfs",
    f"""WITH RECURSIVE {_EDGES},
    walk(start, node, depth) AS (
      SELECT 'region:1', 'region:1', 0 UNION SELECT start, src, depth + 1 FROM walk JOIN edges ON dst = node AND edge_type IN ('calls', 'inherits', 'imports') WHERE depth < 4
    ), least AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL),
    ways AS (SELECT l.start, l.node, l.depth, min(CASE edge_type WHEN 'calls' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END) AS way
      FROM least l JOIN edges e ON e.src = l.node AND edge_type IN ('calls', 'inherits', 'imports') JOIN least p ON p.node = e.dst AND p.depth = l.depth - 1 WHERE l.depth > 0 GROUP BY ALL)
    SELECT start, node, depth, CASE way WHEN 1 THEN 'calls' WHEN 2 THEN 'inherits' ELSE 'imports' END AS via FROM ways""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(_edges(spark, sf_dir), _start(spark, "region:1"))


@register(
    "impact_all",
    f"""WITH RECURSIVE {_EDGES}, starts AS (SELECT 'supp:' || s_suppkey AS s FROM supplier UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'region:' || r_regionkey FROM region),
    walk(start, node, depth) AS (
      SELECT s, s, 0 FROM starts UNION SELECT start, src, depth + 1 FROM walk JOIN edges ON dst = node AND edge_type IN ('calls', 'inherits', 'imports') WHERE depth < 4
    ), least AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL),
    ways AS (SELECT l.start, l.node, l.depth, min(CASE edge_type WHEN 'calls' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END) AS way
      FROM least l JOIN edges e ON e.src = l.node AND edge_type IN ('calls', 'inherits', 'imports') JOIN least p ON p.start = l.start AND p.node = e.dst AND p.depth = l.depth - 1 WHERE l.depth > 0 GROUP BY ALL)
    SELECT start, node, depth, CASE way WHEN 1 THEN 'calls' WHEN 2 THEN 'inherits' ELSE 'imports' END AS via FROM ways""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on any supplier, nation or region."""
    starts = [table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("start")) for name, prefix, key in (("supplier", "supp:", "s_suppkey"), ("nation", "nation:", "n_nationkey"), ("region", "region:", "r_regionkey"))]
    return graph.impact_many(reduce(DataFrame.unionByName, _edge_parts(spark, sf_dir)), reduce(DataFrame.unionByName, starts))


@register(
    "remove_file",
    f"""WITH {_EDGES}, gone AS (SELECT dst AS node FROM edges WHERE edge_type = 'contains' AND src = 'region:1' UNION SELECT 'region:1')
    SELECT src, dst, edge_type FROM edges WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    return graph.remove_file(nodes, edges, "region:1")[1]


NODE_ROWS = [(1, "n1", "a", None), (2, "n1", None, 5), (3, "n2", "b", 7), (4, "n2", "c", None)]


@register("merge_nodes", "WITH " + values("rows", "ord, node_id, name, line", NODE_ROWS) + " SELECT node_id, arg_max(name, ord) FILTER (name IS NOT NULL) AS name, arg_max(line, ord) FILTER (line IS NOT NULL) AS line FROM rows GROUP BY node_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(stated(spark, NODE_ROWS, "ord long, node_id string, name string, line int"))


# -- names and modules ---------------------------------------------------------------------------

SYMBOLS = [
    (1, "a/x.py", "load", "load", "function"), (2, "a/x.py", "Base", "Base", "class"), (3, "b/y.py", "load", "Store.load", "method"), (4, "b/y.py", "common", "common", "function"),
    (5, "c/z.py", "common", "common", "function"), (6, "d/w.py", "common", "common", "function"), (7, "e/v.py", "common", "common", "function"), (8, "e/v.py", "common", "V.common", "method"), (9, "b/y.py", "Base", "Base", "function"),
]
PENDING = [("s1", "a/x.py", "load"), ("s2", "b/y.py", "load"), ("s3", "q/q.py", "load"), ("s4", "q/q.py", "common"), ("s5", "e/v.py", "common"), ("s6", "q/q.py", "missing"), ("s7", "b/y.py", "Base")]


@register(
    "name_resolution",
    "WITH " + values("sym", "ord, file_path, name, qualified_name, kind", SYMBOLS) + ", " + values("pend", "src, file_path, name", PENDING)
    + """, cand AS (SELECT p.src, s.*, count(*) OVER (PARTITION BY p.src) AS n, row_number() OVER (PARTITION BY p.src ORDER BY (s.file_path = p.file_path) DESC, s.ord) AS rn, s.file_path = p.file_path AS here FROM pend p JOIN sym s ON p.name = s.name)
    SELECT src, 'sym:' || file_path || '::' || qualified_name AS dst FROM cand WHERE rn = 1 AND (here OR n <= 3)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = stated(spark, SYMBOLS, "ord long, file_path string, name string, qualified_name string, kind string")
    return resolve.resolve_names(stated(spark, PENDING, "src string, file_path string, name string"), symbols)


FILES = [("app/db.py",), ("app/__init__.py",), ("src/core/util.py",), ("web/a.js",), ("web/lib/index.js",), ("web/b.ts",), ("top.py",)]
IMPORTS = [("app/api.py", "app.db"), ("app/api.py", "app.db.connect"), ("app/api.py", "os"), ("app/api.py", "core.util.f"), ("app/api.py", ".db"), ("app/api.py", "app.missing.x"), ("web/c.js", "./a"), ("web/c.js", "./lib"), ("web/x/d.js", "../b"), ("web/x/d.js", "./none"), ("a.js", "./top")]


@register("path_to_module", "WITH " + values("files", "file_path", FILES) + r""" SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN nullif(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(file_path, '\.py$', ''), '/__init__$', ''), '/'), lambda s: s NOT IN ('', '.', 'src')), '.'), '') END AS module FROM files""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, FILES, "file_path string").select("file_path", module_of(F.col("file_path")).alias("module"))


@register(
    "import_resolution",
    "WITH "
    + values("want", "file_path, module, target", [("app/api.py", "app.db", "app/db.py"), ("app/api.py", "app.db.connect", "app/db.py"), ("app/api.py", "core.util.f", "src/core/util.py"), ("app/api.py", "app.missing.x", "app/__init__.py"), ("web/c.js", "./a", "web/a.js"), ("web/c.js", "./lib", "web/lib/index.js"), ("web/x/d.js", "../b", "web/b.ts"), ("a.js", "./top", "top.py")])
    + " SELECT * FROM want",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_modules(stated(spark, IMPORTS, "file_path string, module string"), stated(spark, FILES, "file_path string"))


PATHS = [("a/b.PY",), ("x.tar.gz",), (".json",), (".x.json",), ("Makefile",), ("web/app.tsx",), ("d.ot/name",), ("lib.so",), ("notes.rst",), ("..py",), ("a.b/.c.d.yml",)]


@register("language_detect", "WITH " + values("want", "path, language", [("a/b.PY", "python"), ("x.tar.gz", None), (".json", None), (".x.json", "json"), ("Makefile", None), ("web/app.tsx", "typescript"), ("d.ot/name", None), ("lib.so", None), ("notes.rst", "markdown"), ("..py", None), ("a.b/.c.d.yml", "yaml")]) + " SELECT * FROM want")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, PATHS, "path string").select("path", language_of(F.col("path")).alias("language"))


IGNORED = [("generated/junk.py",), ("src/generated.py",), ("a/b/test_x.py",), ("docs/readme.md",), ("lib/deep/er/x.js",), ("generated",), ("a/generated/x.py",)]


@register("ignore_globs", "WITH " + values("want", "path, skipped", [("generated/junk.py", True), ("src/generated.py", False), ("a/b/test_x.py", True), ("docs/readme.md", False), ("lib/deep/er/x.js", True), ("generated", True), ("a/generated/x.py", False)]) + " SELECT * FROM want")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, IGNORED, "path string").select("path", ignored("path", ["/generated", "test_*.py", "lib/*.js"]).alias("skipped"))


# -- lookups -------------------------------------------------------------------------------------


def _part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.lit("class").alias("kind"), F.col("p_type").alias("file_path"), F.col("p_size").alias("start_line"), F.col("p_type").alias("signature"), F.col("p_name").alias("docstring"))


_PARTS = "sym AS (SELECT p_partkey AS ord, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS file_path, p_size AS start_line FROM part)"


@register("find_symbol_exact", f"WITH {_PARTS} SELECT ord, name, qualified_name FROM sym WHERE name = 'small ring' OR qualified_name = 'small ring'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_symbols(_part_symbols(spark, sf_dir), stated(spark, [("small ring",)], "name string")).select("ord", "name", "qualified_name")


@register("fuzzy_lookup", f"WITH {_PARTS} SELECT ord, name, qualified_name FROM sym WHERE contains(lower(qualified_name), lower('BRAND#1')) ORDER BY ord LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_symbols(_part_symbols(spark, sf_dir), stated(spark, [("BRAND#1",)], "name string")).select("ord", "name", "qualified_name")


@register("outline", "SELECT 'class' AS kind, p_brand || '.' || p_name AS name, p_size AS line, p_type AS signature, p_name[1:120] AS doc FROM part WHERE p_type = 'ECONOMY'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.outline(_part_symbols(spark, sf_dir), "ECONOMY")


@register("index_stats", f"WITH {_EDGES} SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return lookup.index_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "part"), nodes, edges)


@register(
    "related_context",
    f"""WITH {_EDGES}, rel AS (
      SELECT dst AS start, src AS node, 0 AS p, 'caller' AS relation FROM edges WHERE edge_type = 'calls' AND dst IN ('supp:3', 'nation:4')
      UNION ALL SELECT src, dst, 1, 'callee' FROM edges WHERE edge_type = 'calls' AND src IN ('supp:3', 'nation:4')
      UNION ALL SELECT dst, src, 2, 'subclass' FROM edges WHERE edge_type = 'inherits' AND dst IN ('supp:3', 'nation:4'))
    SELECT start, pos, relation, node AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY p, node) AS pos FROM rel) WHERE pos <= 5""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = nodes.select(F.col("id").alias("node_id"), F.lit("symbol").alias("type"), F.col("id").alias("qualified"), F.lit("").alias("path"), F.lit(1).alias("line"))
    return graph.related(edges, nodes, _start(spark, "supp:3", "nation:4")).select("start", "pos", "relation", "symbol")


# -- boosts on a stated corpus -------------------------------------------------------------------

CHUNK_ROWS = [(1, "c1", "a.py", "python", "function", "f"), (2, "c2", "a.py", "python", "block", None), (3, "c3", "b.py", "python", "method", "K.g"), (4, "c4", "b.js", "javascript", "class", "K"), (5, "c5", "d.py", "python", "function", "h")]
EDGE_ROWS = [("sym:a.py::f", "sym:b.py::K.g", "calls"), ("sym:b.js::K", "sym:z.py::Z", "inherits"), ("sym:d.py::h", "sym:d.py::other", "calls")]
FUSED_ROWS = [(1, "c1", 0.030, "bm25"), (1, "c2", 0.033, "bm25"), (1, "c3", 0.020, "dense"), (1, "c4", 0.029, "bm25"), (1, "c5", 0.031, "bm25"), (2, "c1", 0.5, "bm25"), (2, "gone", 0.4, "bm25")]
_CHUNKS = values("chunks", "ord, chunk_id, file_path, language, kind, symbol", CHUNK_ROWS) + ", " + values("e", "src, dst, edge_type", EDGE_ROWS) + ", " + values("fused", "query_id, chunk_id, score, source", FUSED_ROWS)
_HITS = f"""WITH {_CHUNKS}, own AS (SELECT *, 'sym:' || file_path || '::' || symbol AS node FROM chunks), near AS (
  SELECT dst AS a, src AS b FROM e WHERE edge_type IN ('calls', 'inherits') UNION SELECT src, dst FROM e WHERE edge_type = 'calls'),
  hits AS (SELECT f.query_id, o.*, score * CASE WHEN kind IN ('function', 'method', 'class') THEN 1.15 ELSE 1 END
    * CASE WHEN EXISTS (SELECT 1 FROM near JOIN own x ON x.node = near.b JOIN fused g ON g.chunk_id = x.chunk_id AND g.query_id = f.query_id WHERE near.a = o.node) THEN 1.1 ELSE 1 END AS final, score
  FROM fused f JOIN own o USING (chunk_id))"""


def _hits(spark: SparkSession, **options) -> DataFrame:
    chunks = stated(spark, CHUNK_ROWS, "ord long, chunk_id string, file_path string, language string, kind string, symbol string")
    fused = stated(spark, FUSED_ROWS, "query_id int, chunk_id string, score double, sources string")
    return ranking.ranked_hits(fused, chunks, stated(spark, EDGE_ROWS, "src string, dst string, edge_type string"), **options).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _ranked(where: str) -> str:
    return f"{_HITS} SELECT query_id, rank, chunk_id, round(final, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, score DESC, chunk_id) AS rank FROM hits WHERE {where}) WHERE rank <= 10"


@register("boosted_hits", _ranked("true"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark)


@register("boosted_hits_by_kind", _ranked("kind = 'function'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, kind="function")


@register("boosted_hits_by_language", _ranked("language = 'python'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, language="python")


# -- increments ----------------------------------------------------------------------------------

_OLD = "old AS (SELECT source || '/' || doc_id AS file_path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha1(text) END AS sha1 FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT source || '/' || doc_id AS file_path, sha1(text) AS sha1 FROM documents WHERE doc_id % 11 <> 0)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as files: the earlier lacks some, the later others, and some differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.sha1("text").alias("sha1"))
    old = docs.where("doc_id % 5 <> 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("sha1")).alias("sha1"))
    return old, docs.where("doc_id % 11 <> 0").select("file_path", "sha1")


@register("incremental_diff", f"WITH {_OLD} SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'removed' WHEN o.file_path IS NULL THEN 'added' WHEN o.sha1 = n.sha1 THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.file_path = n.file_path")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_files(*_versions(spark, sf_dir))


@register("vector_reuse", f"WITH {_OLD} SELECT n.file_path, coalesce('old:' || o.sha1, 'new:' || n.sha1) AS vector FROM new n LEFT JOIN old o ON o.file_path = n.file_path AND o.sha1 = n.sha1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return new.join(old.select("file_path", "sha1", F.concat(F.lit("old:"), "sha1").alias("kept")), ["file_path", "sha1"], "left").select("file_path", F.coalesce("kept", F.concat(F.lit("new:"), "sha1")).alias("vector"))


_ALL = "h AS (SELECT source || '/' || doc_id AS file_path, sha1(text) AS sha1, substr(sha1(coalesce(text, '')), 1, 1) AS digit FROM documents), old AS (SELECT file_path, CASE WHEN digit IN ('3', '4') THEN 'stale' ELSE sha1 END AS sha1 FROM h WHERE digit NOT IN ('0', '1', '2')), new AS (SELECT file_path, sha1 FROM h WHERE digit NOT IN ('d', 'e', 'f'))"


def _all_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states set by the texts' hashes; every document is in at least one."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.sha1("text").alias("sha1"), F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 1).alias("digit"))
    old = docs.where(~F.col("digit").isin("0", "1", "2")).select("file_path", F.when(F.col("digit").isin("3", "4"), "stale").otherwise(F.col("sha1")).alias("sha1"))
    return old, docs.where(~F.col("digit").isin("d", "e", "f")).select("file_path", "sha1")


@register("incremental_diff_all", f"WITH {_ALL} SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'removed' WHEN o.file_path IS NULL THEN 'added' WHEN o.sha1 IS NOT DISTINCT FROM n.sha1 THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.file_path = n.file_path")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_files(*_all_versions(spark, sf_dir))


@register("vector_reuse_all", f"WITH {_ALL}, vectors AS (SELECT n.file_path, coalesce('old:' || o.sha1, 'new:' || n.sha1) AS vector FROM new n LEFT JOIN old o ON o.file_path = n.file_path AND o.sha1 = n.sha1) SELECT coalesce(h.file_path, v.file_path) AS file_path, vector FROM h FULL JOIN vectors v ON h.file_path = v.file_path")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: those that are removed have no vector."""
    old, new = _all_versions(spark, sf_dir)
    kept = new.join(old.select("file_path", "sha1", F.concat(F.lit("old:"), "sha1").alias("kept")), ["file_path", "sha1"], "left").select("file_path", F.coalesce("kept", F.concat(F.lit("new:"), "sha1")).alias("vector"))
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path")).join(kept, "file_path", "full_outer")


@register("global_order", "SELECT source AS file_path, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ord FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), "doc_id"), "file_path", "doc_id")


REPOS = [("me/a", "t2"), ("me/b", "t1"), ("me/c", "t3"), ("me/d", "t1")]
KNOWN = [("me/a", "t1"), ("me/b", "t1"), ("me/d", "t1"), ("me/old", "t9")]


@register("sync_plan", "WITH " + values("repos", "full_name, pushed_at", REPOS) + ", " + values("known", "full_name, stamp", KNOWN) + " SELECT full_name, pushed_at, CASE WHEN stamp = pushed_at AND full_name IN ('me/a', 'me/b') THEN 'skip' ELSE 'fetch' END AS action FROM repos LEFT JOIN known USING (full_name)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_sync(stated(spark, REPOS, "full_name string, pushed_at string"), stated(spark, KNOWN, "full_name string, stamp string"), stated(spark, [("me/a",), ("me/b",)], "full_name string"))
