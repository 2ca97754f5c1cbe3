"""Windows by expressions are those of the Python function, line for line."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.native_windows import BREAKS, SPACES, line_spans, lines_of, window_rows
from lodestrata.functions.parsing import parse_by_lines, parse_files
from lodestrata.functions.windows import line_windows

TEXTS = ["", "\n", "\n\n", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "\r\n\r\n", " \t　\n\xa0", "x\x1fy\n\x1f\n", "﻿bom\n", "end\n\n\n", "é" * 100 + "\n" + "日" * 70]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = list(TEXTS)
    for n in (1, 59, 60, 61, 70, 119, 121, 400, 1500):
        for blanks in (0.0, 0.1, 0.9, 1.0):
            made.append("\n".join(rng.choice(("", " ", "\t ")) if rng.random() < blanks else f"line {k}" for k in range(n)) + rng.choice(("", "\n")))
    return made


def test_white_space_is_pythons():
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    assert {c for c in every if c.isspace()} == set(BREAKS + SPACES)
    assert {c for c in every if len(f"a{c}b".splitlines()) == 2} == set(BREAKS)


def test_lines_and_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("lines", lines_of(F.col("text")))
    for r in df.select("text", "lines", line_spans(F.col("lines")).alias("spans")).collect():
        assert list(r.lines) == r.text.splitlines()
        assert [tuple(s) for s in r.spans] == list(line_windows([not x.strip() for x in r.lines]))


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (5, 2), (2, 0), (1, 0), (60, 29)])
def test_other_sizes(spark, size, overlap):
    rng = random.Random(size)
    rows = [(["" if rng.random() < 0.3 else "x" for _ in range(n)],) for n in range(40)]
    for r in spark.createDataFrame(rows, "lines array<string>").select("lines", line_spans(F.col("lines"), size, overlap).alias("spans")).collect():
        assert [tuple(s) for s in r.spans] == list(line_windows([not x for x in r.lines], size, overlap))


@pytest.mark.parametrize("binary", [False, True])
def test_chunks(spark, texts, binary):
    rows = [(f"d/{k}.txt", ("text", None, "markdown")[k % 3], t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_path string, language string, content string")
    if binary:
        df = df.withColumn("content", F.col("content").cast("binary")).unionByName(spark.createDataFrame([("latin.txt", "text", b"caf\xe9\nmenu")], "file_path string, language string, content binary"))
        rows = rows + [("latin.txt", "text", "café\nmenu")]
    got = {r.file_path: r for r in window_rows(df).collect()}
    assert len(got) == len(rows)
    for path, language, text in rows:
        want = parse_by_lines(path, text, language)
        assert [c.asDict() for c in got[path].chunks] == want["chunks"] and not got[path].symbols and not got[path].imports


def test_null_content_and_mixed_languages(spark):
    df = spark.createDataFrame([("a.txt", "text", None), ("b.py", "python", "def f():\n    pass\n"), ("c.go", "go", 'import "x"\n')], "file_path string, language string, content string")
    got = {r.file_path: (len(r.chunks), [s.name for s in r.symbols], list(r.imports)) for r in parse_files(df).collect()}
    assert got == {"a.txt": (0, [], []), "b.py": (1, ["f"], []), "c.go": (1, [], ["x"])}


def test_no_python_for_plain_texts(spark, sf_dir):
    from lodestrata.plans import registry

    plan = registry.QUERIES["chunk_windows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # The other branch reads a relation that is known to be empty, and so has no tasks.
    assert plan.count("MapIn") == plan.count("LocalTableScan <empty>") <= 1
