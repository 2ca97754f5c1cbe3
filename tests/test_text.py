"""Tokens, subwords, buckets and paths against plain Python."""

import hashlib
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.hashing import bucket, sign
from lodestrata.functions.text import STOPWORDS, language_of, split_identifier, tokenize
from lodestrata.sources.tree import detect_language


def plain_parts(ident):
    return [p.lower() for piece in ident.split("_") for p in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", piece)]


def plain_tokens(text):
    out = []
    for ident in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text):
        low = ident.lower()
        out += [low] * (low not in STOPWORDS)
        out += [p for p in plain_parts(ident) if p != low and len(p) > 1 and p not in STOPWORDS]
    return out


def test_known_identifiers(spark):
    rows = [("getUserById", "get user by id"), ("parse_config_file", "parse config file"), ("HTTPServerError", "http server error"), ("", "")]
    df = spark.createDataFrame(rows, "i string, want string").select(F.array_join(split_identifier(F.col("i")), " ").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


@settings(max_examples=6, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abCDe_1 2.é(\n", max_size=40), min_size=40, max_size=60))
def test_tokens_match_plain_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("k"))
    assert all(r.k == plain_tokens(r.t) for r in df.collect())


def test_null_and_stopword_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("the class of 12",)], "t string").select(tokenize(F.col("t")).alias("k"))
    assert [r.k for r in df.collect()] == [[], [], []]


def test_buckets_match_digest(spark):
    words = [f"w{k}" for k in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bucket(F.col("w")).alias("b"), bucket(F.col("w"), 1000).alias("c"), sign(F.col("w")).alias("s"))
    for r in df.collect():
        h = hashlib.md5(r.w.encode()).digest()
        n = int.from_bytes(h[:4], "little")
        assert (r.b, r.c, r.s) == (n % 512, n % 1000, 1.0 if h[4] % 2 == 0 else -1.0)


def test_language_agrees_with_paths(spark):
    paths = ["a.py", ".json", ".x.json", "..py", "a.b/c", "d/E.TSX", "x.lock", "q.tar.gz", "n.md", "a."]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", language_of(F.col("p")).alias("l"))
    assert all(r.l == detect_language(r.p) for r in df.collect())
