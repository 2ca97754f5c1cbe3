"""Cuts, forms and the way back, against a plain regular expression."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm.fill_in_middle import Draw, code_points, fill_in_middle, rearranged, restored, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", " a b", "a b ", "\n\n", "x\ty\x0bz\x85　w", "😀 é <b> ñandú\n\n  end ", "has <P> mark", "<S>", "a<M>", "<<S>> <<P", "word " * 3000]


def expected(key, text):
    """As the contract says it, over strings."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x85　ab<P>SM😀é", max_size=30), st.integers(0, 500))
def test_against_a_regular_expression(text, key):
    assert unit_ends(code_points(text)).tolist() == [m.end() for m in UNIT.finditer(text)]
    assert rearranged(text, Draw.of(key)) == expected(key, text)


def test_rows_and_the_way_back(spark):
    rows = [(k, text, "x", "y") for k in range(40) for text in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, output string")
    made = fill_in_middle(docs)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((k, *expected(k, t)) for k, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(tuple(r) for r in back.collect()) == sorted((k, t) for k, t, *_ in rows)


def test_edges(spark):
    rows = [(None, "a b c d"), (None, None), (7, None), (7, ""), (3, "one two"), (3, "one two"), (5, "y" * 1_000_000 + " z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((tuple(r) for r in fill_in_middle(docs).collect()), key=repr)
    assert got == sorted(((k, *expected(k, t)) for k, t in rows), key=repr)
    empty = fill_in_middle(docs.where("false"))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and empty.count() == 0


@pytest.mark.parametrize(("rate", "spm", "forms"), [(0, 80, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares(spark, rate, spm, forms):
    docs = spark.createDataFrame([(f"k{k}", f"a b {k} c") for k in range(50)], "name string, body string")
    assert {r.form for r in fill_in_middle(docs, "name", "body", rate=rate, spm=spm).collect()} == forms
