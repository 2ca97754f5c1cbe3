"""Tables and stated inputs of the registered queries, and pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import STOPWORDS, tokenize
from lodestrata.storage import spread

#: A repeated word counts twice at most; the rest are words of the corpus, of benchmark lines and one that is nowhere.
QUERY = "the edition of thonheouin onerth ionst inwh onerth onerth blein hear"
CANDIDATES = 40


class QuerySet:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def register(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, further columns, text) of all documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))


def document_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, further columns, tokens) of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))
    return docs.select("doc_id", *columns, tokenize(F.col("text")).alias("tokens"))


def stated(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of stated rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(text: str) -> str:
    """The tokeniser in SQL without look-ahead: a run of capitals is parted from the word that follows it first."""
    parts = r"regexp_extract_all(regexp_replace(i, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return (
        f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda i: list_concat("
        f"list_filter([lower(i)], lambda t: t NOT IN ({_STOP})), "
        f"list_filter(list_transform({parts}, lambda s: lower(s)), lambda s: s <> lower(i) AND length(s) > 1 AND s NOT IN ({_STOP})))))"
    )


SQL_DOCUMENT_TOKENS = f"tokens AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)"
SQL_STATS = "stats AS (SELECT count(*) AS n, coalesce(sum(len(t)) / count(*), 0) AS avgdl FROM tokens)"


def sql_bm25(queries: str) -> str:
    """CTEs from ``tokens`` and a table of queries (query_id, text) to bm25(query_id, doc_id, score, rank)."""
    return f"""{SQL_STATS},
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens("text")}) AS term FROM {queries}) GROUP BY ALL),
    post AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tokens) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * least(qtf, 2)), 6) AS score
      FROM post JOIN qt USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm)"""


def sql_hashed(source: str, key: str, name: str, rounded: bool) -> str:
    """CTE ``name``(key, bucket, w) from a table of (key, t)."""
    h = "md5(term)"
    bucket = f"(('0x' || substr({h}, 1, 2))::INT + 256 * (('0x' || substr({h}, 3, 2))::INT % 2))"
    sign = f"CASE WHEN ('0x' || substr({h}, 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    w = "v / sqrt(sum(v * v) OVER (PARTITION BY k))"
    return f"""{name}_v AS (SELECT k, bucket, sign(v) * ln(1 + abs(v)) AS v FROM (
      SELECT {key} AS k, {bucket} AS bucket, sum({sign}) AS v FROM (SELECT {key}, unnest(t) AS term FROM {source}) GROUP BY ALL) WHERE v <> 0),
    {name} AS (SELECT k AS {key}, bucket, {"round(" + w + ", 6)" if rounded else w} AS w FROM {name}_v)"""
