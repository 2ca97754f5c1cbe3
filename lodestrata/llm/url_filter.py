"""URL filters: a trie over reversed host labels, then path segments.

Rules are (host, path, verdict). A rule fits its host and every subdomain when the url's path
starts with the rule's path. Of the rules that fit, the longest (host plus path) wins; on equal
length the one with the longer host, then ``block`` before ``allow``. A url that no rule fits gets
``default``. A null url, or one without ``://``, has an empty host and an empty path, which no rule
with a host fits.

The trie travels to the executors by broadcast only while the rules hold at most
``BROADCAST_RULE_BYTES``; larger rule sets are joined by equality on every host suffix and on the
rule lengths that occur, so nothing that grows is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, table

BROADCAST_RULE_BYTES = 32 << 20
DEFAULT_VERDICT = "allow"

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class RuleTrie:
    """Host labels from the right, then path segments; a node's ``ends`` hold partial last segments."""

    __slots__ = ("ends", "hosts", "segments")

    def __init__(self) -> None:
        self.hosts: dict[str, RuleTrie] = {}
        self.segments: dict[str, RuleTrie] = {}
        self.ends: list[tuple[str, Rule]] = []

    @classmethod
    def build(cls, rules: Iterable[Rule]) -> RuleTrie:
        root = cls()
        for rule in rules:
            node = root
            for label in reversed(rule.host.split(".")):
                node = node.hosts.setdefault(label, cls())
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, cls())
            node.ends.append((last, rule))
        return root

    def lookup(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        segments = path.split("/")
        node = self
        for label in reversed(host.split(".")):
            if (node := node.hosts.get(label)) is None:
                break
            at: RuleTrie | None = node
            for i, segment in enumerate(segments):
                for tail, rule in at.ends:
                    if segment.startswith(tail) and (best is None or _rank(rule) > _rank(best)):
                        best = rule
                if i + 1 == len(segments) or (at := at.segments.get(segment)) is None:
                    break
        return best


def _rank(rule: Rule) -> tuple[int, int, bool, str]:
    return len(rule.name), len(rule.host), rule.verdict == "block", rule.name


def _host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_join(pages: DataFrame, id_col: str, rules: DataFrame, default: str) -> DataFrame:
    """Equality joins only: each place asks for every host suffix at the path lengths that rules of that host have."""
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    asked = pages.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    probes = asked.select("host", "path", F.explode(suffix).alias("r_host")).join(lengths, "r_host").withColumn("n", F.explode("lengths"))
    name = F.concat("r_host", "r_path")
    found = (
        probes.where(F.length("path") >= F.col("n"))
        .withColumn("r_path", F.expr("substring(path, 1, n)"))
        .join(rules, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(name), F.length("r_host"), F.col("r_verdict") == "block", name.alias("rule"), F.col("r_verdict"))).alias("best"))
    )
    return pages.join(found, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT_VERDICT,
    broadcast_bytes: int = BROADCAST_RULE_BYTES,
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null: none fits), verdict.

    ``rules`` may be a sequence or a DataFrame (host, path, verdict). Null ids stay null; repeated
    rows give repeated results; an empty table gives none; further columns are ignored.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
        small = [Rule(*r) for r in rules.select("host", "path", "verdict").toLocalIterator()] if size <= broadcast_bytes else None
    else:
        small = list(rules) if sum(len(r.name) for r in rules) <= broadcast_bytes else None
    if small is None:
        frame = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
        frame = frame.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
        keyed = pages.select(id_col, _host(F.col(url_col)).alias("host"), _path(F.col(url_col)).alias("path"))
        return _by_join(keyed, id_col, frame, default)

    shared = spark.sparkContext.broadcast(RuleTrie.build(small))
    kind = dict(pages.dtypes)[id_col]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch["url"]]
            rules_of = [trie.lookup(h, p) for h, p in parts]
            yield pd.DataFrame(
                {
                    id_col: batch["id"],
                    "host": [h for h, _ in parts],
                    "path": [p for _, p in parts],
                    "rule": [r.name if r else None for r in rules_of],
                    "verdict": [r.verdict if r else default for r in rules_of],
                }
            )

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInPandas(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS rn
  FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE rn = 1
"""
