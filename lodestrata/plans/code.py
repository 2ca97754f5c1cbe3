"""Queries that parse sources: line windows over the documents, and stated files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.answer import HIT, extract_text, prompt_text
from lodestrata.engine import CodeIndex
from lodestrata.functions.parsing import parse_files
from lodestrata.operators.resolve import build_graph
from lodestrata.plans.inputs import QuerySet, stated, table, values
from lodestrata.sources.index import build_tables
from lodestrata.storage import register_folder, shared_dir, spread

OWN = QuerySet()
register = OWN.register


PYTHON = '''"""Module."""
import os
from .pkg import thing
from a.b import c


@decorate
def first(x):
    """Say it."""
    return second(os.path.join(x))


class Kind(Base, mod.Other):
    field = 1

    def method(self):
        def inner():
            return first(2)
        return inner()


async def second(y):
    return Kind().method()

if __name__ == "__main__":
    first("z")
'''
SCRIPT = """import { util } from './util';
const helper = require("./helper");

export async function processOrder(order) {
  if (order) { return util(order); } // }
  return "{";
}

export class OrderService {
  run() { return 1; }
}

const fmt = (x) => x;
"""
RUBY = """require 'json'
module Shop
  class Cart
    def total
      items.each do |i|
        i
      end
    end
  end
end
puts 1
"""
GO = 'package main\n\nimport (\n  "fmt"\n  "a/b"\n)\n\ntype Cart struct {\n  n int\n}\n\nfunc (c *Cart) Total() int {\n  return c.n\n}\n'
SOURCES = [("app/mod.py", "python", PYTHON), ("web/order.js", "javascript", SCRIPT), ("shop.rb", "ruby", RUBY), ("cart.go", "go", GO), ("bad.py", "python", "def broken(:\n"), ("empty.py", "python", ""), ("notes.md", "markdown", "# Title\n\ntext\n")]


def _parsed(spark: SparkSession) -> DataFrame:
    return parse_files(stated(spark, SOURCES, "file_path string, language string, content string"))


@register(
    "parsed_symbols",
    "WITH "
    + values(
        "want",
        "file_path, qualified_name, kind, start_line, end_line, bases, calls",
        [
            ("app/mod.py", "first", "function", 7, 10, "", "second,join"),
            ("app/mod.py", "Kind", "class", 13, 19, "Base,Other", "inner,first"),
            ("app/mod.py", "Kind.method", "method", 16, 19, "", "inner,first"),
            ("app/mod.py", "Kind.method.inner", "function", 17, 18, "", "first"),
            ("app/mod.py", "second", "function", 22, 23, "", "method,Kind"),
            ("web/order.js", "processOrder", "function", 4, 7, "", ""),
            ("web/order.js", "OrderService", "class", 9, 11, "", ""),
            ("web/order.js", "fmt", "function", 13, 13, "", ""),
            ("shop.rb", "Shop", "class", 2, 10, "", ""),
            ("cart.go", "Cart", "class", 8, 10, "", ""),
            ("cart.go", "Total", "function", 12, 14, "", ""),
        ],
    )
    + " SELECT * FROM want",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark).select(F.explode("symbols").alias("s")).select("s.file_path", "s.qualified_name", "s.kind", "s.start_line", "s.end_line", F.array_join("s.bases", ",").alias("bases"), F.array_join("s.calls", ",").alias("calls"))


@register(
    "parsed_chunks",
    "WITH "
    + values(
        "want",
        "file_path, language, kind, symbol, start_line, end_line",
        [
            ("app/mod.py", "python", "block", None, 1, 4),
            ("app/mod.py", "python", "function", "first", 7, 10),
            ("app/mod.py", "python", "class", "Kind", 13, 19),
            ("app/mod.py", "python", "function", "second", 22, 23),
            ("app/mod.py", "python", "block", None, 25, 26),
            ("web/order.js", "javascript", "block", None, 1, 3),
            ("web/order.js", "javascript", "function", "processOrder", 4, 7),
            ("web/order.js", "javascript", "class", "OrderService", 9, 11),
            ("web/order.js", "javascript", "function", "fmt", 13, 13),
            ("shop.rb", "ruby", "block", None, 1, 1),
            ("shop.rb", "ruby", "class", "Shop", 2, 10),
            ("shop.rb", "ruby", "block", None, 11, 11),
            ("cart.go", "go", "block", None, 1, 7),
            ("cart.go", "go", "class", "Cart", 8, 10),
            ("cart.go", "go", "function", "Total", 12, 14),
            ("bad.py", "text", "block", None, 1, 1),
            ("notes.md", "markdown", "block", None, 1, 3),
        ],
    )
    + " SELECT * FROM want",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark).select(F.explode("chunks").alias("c")).select("c.file_path", "c.language", "c.kind", "c.symbol", "c.start_line", "c.end_line")


@register("parsed_imports", "WITH " + values("want", "file_path, module", [("app/mod.py", "os"), ("app/mod.py", ".pkg"), ("app/mod.py", "a.b"), ("web/order.js", "./util"), ("web/order.js", "./helper"), ("shop.rb", "json"), ("cart.go", "fmt"), ("cart.go", "a/b")]) + " SELECT * FROM want")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark).select("file_path", F.explode("imports").alias("module"))


@register(
    "parsed_graph",
    "WITH "
    + values(
        "want",
        "src, dst, edge_type",
        [(f"file:{p}", f"sym:{p}::{q}", "contains") for p, q in (("app/mod.py", "first"), ("app/mod.py", "Kind"), ("app/mod.py", "Kind.method"), ("app/mod.py", "Kind.method.inner"), ("app/mod.py", "second"), ("web/order.js", "processOrder"), ("web/order.js", "OrderService"), ("web/order.js", "fmt"), ("shop.rb", "Shop"), ("cart.go", "Cart"), ("cart.go", "Total"))]
        + [(f"sym:app/mod.py::{a}", f"sym:app/mod.py::{b}", "calls") for a, b in (("first", "second"), ("Kind", "Kind.method.inner"), ("Kind", "first"), ("Kind.method", "Kind.method.inner"), ("Kind.method", "first"), ("Kind.method.inner", "first"), ("second", "Kind.method"), ("second", "Kind"))],
    )
    + " SELECT * FROM want",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark)
    languages = stated(spark, SOURCES, "file_path string, language string, content string").select("file_path", "language")
    symbols = parsed.select(F.posexplode("symbols").alias("place", "s")).select("s.*", F.col("place").cast("long").alias("ord"))
    return build_graph(parsed.select("file_path", "imports").join(languages, "file_path"), symbols)[1]


# A document's lines as Python splits them: here only line feeds part them.
_WINDOWS = r"""WITH RECURSIVE doc AS (
  SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text[1:-2] ELSE text END AS body FROM documents WHERE text <> ''
), lines AS (SELECT doc_id, string_split(body, chr(10)) AS l, len(string_split(body, chr(10))) AS n FROM doc),
win(doc_id, a, b) AS (
  SELECT doc_id, 0, CASE WHEN n <= 60 THEN n ELSE coalesce(list_max(list_filter(range(31, 61), lambda j: trim(l[j], ' ' || chr(9)) = '')), 60) END FROM lines
  UNION ALL
  SELECT doc_id, s, CASE WHEN n <= s + 60 THEN n ELSE coalesce(list_max(list_filter(range(s + 31, s + 61), lambda j: trim(l[j], ' ' || chr(9)) = '')), s + 60) END
  FROM (SELECT w.doc_id, greatest(w.b - 10, w.a + 1) AS s, l, n FROM win w JOIN lines USING (doc_id) WHERE w.b < n)
)
SELECT doc_id, a + 1 AS start_line, b AS end_line, md5(array_to_string(l[a + 1 : b], chr(10))) AS text_md5 FROM win JOIN lines USING (doc_id) WHERE trim(array_to_string(l[a + 1 : b], ''), ' ' || chr(9)) <> ''"""


@register("chunk_windows", _WINDOWS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.lit("text").alias("language"), F.col("text").alias("content")))
    # An outer explode, as an inner one has the optimiser test the array's size, and compute it, once more.
    chunks = parse_files(docs).select(F.explode_outer("chunks").alias("c")).where("c is not null")
    return chunks.select(F.col("c.file_path").cast("long").alias("doc_id"), "c.start_line", "c.end_line", F.md5("c.text").alias("text_md5"))


# -- whole indexes over the documents: each is a text file, and names a function that calls another's ---

_CODE = "'def f' || doc_id || '(x):' || chr(10) || '    return f' || (doc_id // 2) || '(x)' || chr(10)"
_FILES = f"files AS (SELECT doc_id, 'texts/' || doc_id || '.txt' AS file_path, coalesce(text, '') AS content FROM documents UNION ALL SELECT doc_id, 'code/' || doc_id || '.py', {_CODE} FROM documents)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("texts/"), "doc_id", F.lit(".txt")).alias("file_path"), F.lit("text").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("def f"), "doc_id", F.lit("(x):\n    return f"), F.floor(F.col("doc_id") / 2), F.lit("(x)\n"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("code/"), "doc_id", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), body.alias("content"))


def _built(spark: SparkSession, *states: DataFrame) -> tuple[CodeIndex, dict]:
    """The index of the last state, refreshed from those before it, and what the last build says of itself."""
    path = register_folder(spark, f"{shared_dir(spark)}/lodestrata/index-{uuid.uuid4().hex}")
    for files in states:
        stats = build_tables(spark, spread(files.withColumn("sha1", F.sha1("content"))), path)
    return CodeIndex(spark, path, path), stats


@register("index_build", f"WITH {_FILES}, w AS (SELECT doc_id, count(*) AS n FROM ({_WINDOWS}) GROUP BY doc_id) SELECT file_path, sha1(content) AS sha1, CASE WHEN file_path LIKE 'code/%' THEN 1 ELSE coalesce(n, 0) END AS chunks, CASE WHEN file_path LIKE 'code/%' THEN 1 ELSE 0 END AS symbols FROM files LEFT JOIN w USING (doc_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _built(spark, _texts(spark, sf_dir).unionByName(_functions(spark, sf_dir)))
    found = index.table("files").select("file_path", "sha1")
    for name in ("chunks", "symbols"):
        found = found.join(index.table(name).groupBy("file_path").agg(F.count("*").alias(name)), "file_path", "left")
    return found.select("file_path", "sha1", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "symbols")])


_DIGIT = "substr(sha1(coalesce(text, '')), 1, 1)"


@register(
    "index_rebuild",
    f"""WITH h AS (SELECT doc_id, {_DIGIT} AS digit FROM documents), w AS (SELECT doc_id, count(*) AS n FROM ({_WINDOWS}) GROUP BY doc_id)
    SELECT count(*) FILTER (digit IN ('0', '1', '2', '3', '4')) AS files_indexed, count(*) FILTER (digit NOT IN ('0', '1', '2', '3', '4', 'd', 'e', 'f')) AS files_skipped, count(*) FILTER (digit IN ('d', 'e', 'f')) AS files_removed,
      (coalesce(sum(n) FILTER (digit NOT IN ('d', 'e', 'f')), 0))::BIGINT AS chunks, (coalesce(sum(n) FILTER (digit NOT IN ('d', 'e', 'f')), 0) - 1)::BIGINT AS last_ord FROM h LEFT JOIN w USING (doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose hash begins with 0 to 2 are added, with 3 or 4 changed, with d to f removed; the others are carried over."""
    every = _texts(spark, sf_dir).withColumn("digit", F.substring(F.sha1("content"), 1, 1))
    old = every.where(~F.col("digit").isin("0", "1", "2")).withColumn("content", F.when(F.col("digit").isin("3", "4"), "before").otherwise(F.col("content")))
    index, stats = _built(spark, old.drop("digit"), every.where(~F.col("digit").isin("d", "e", "f")).drop("digit"))
    counts = [F.lit(stats[c]).cast("long").alias(c) for c in ("files_indexed", "files_skipped", "files_removed")]
    return index.table("chunks").agg(F.count("*").alias("chunks"), F.max("ord").alias("last_ord")).select(*counts, "chunks", "last_ord")


@register("index_callers", "SELECT 'f' || a.doc_id AS symbol, 'code/' || a.doc_id || '.py' AS file, 1 AS line FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 AND a.doc_id <> b.doc_id WHERE b.doc_id = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, _functions(spark, sf_dir))[0].callers("f1")


@register(
    "index_impact",
    """WITH RECURSIVE walk(id, depth) AS (SELECT doc_id, 0 FROM documents WHERE doc_id = 1 UNION ALL SELECT doc_id, depth + 1 FROM walk JOIN documents ON doc_id // 2 = id AND doc_id <> id WHERE depth < 4)
    SELECT depth, 'calls' AS via, 'symbol' AS type, 'f' || id AS name, 'code/' || id || '.py' AS file, 1 AS line FROM walk WHERE depth > 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, _functions(spark, sf_dir))[0].impact("f1")


HITS = [("a.py", 3, 4, "function", "f", "python", "Does it.", "def f():\n    pass", [("caller", "g", "b.py", 1)]), ("n.md", 1, 1, "block", None, "markdown", None, "x\n", [])]
_EXTRACT = 'Top matches for: why?\n\n[1] a.py:3 — function `f`\n    "Does it."\n    def f():\n        pass\n\n[2] n.md:1 — block\n    x\n\n(extractive mode — configure an LLM for synthesized answers)'
_PROMPT = "Question: why?\n\nCode snippets:\n[1] a.py:3-4  (function f)\n```python\ndef f():\n    pass\n```\n    related caller: g (b.py:1)\n\n[2] n.md:1-1\n```markdown\nx\n\n```\n\nAnswer the question, citing snippet numbers like [1]."


@register("answers", "WITH " + values("want", "mode, answer", [("extractive", _EXTRACT), ("prompt", _PROMPT), ("nothing", "No matching code found for this question.")]) + " SELECT * FROM want")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stated(spark, [("extractive", "why?", HITS), ("prompt", "why?", HITS), ("nothing", "why?", [])], f"mode string, question string, hits array<{HIT}>")
    question, hits = F.col("question"), F.col("hits")
    return asked.select("mode", F.when(F.col("mode") == "prompt", prompt_text(question, hits)).otherwise(extract_text(question, hits)).alias("answer"))
