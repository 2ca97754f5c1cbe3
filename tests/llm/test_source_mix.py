import re

import pytest

from lodestrata.llm import source_mix as mix


def fair_targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing the excess by weight until no source is above its limit."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / share for s in names}
        above = {s for s in names if target[s] > most * sizes[s] + 1e-9 and s not in full}
        if not above:
            return target
        full |= above


def check(df):
    rows = mix.mix_sources(df).collect()
    sizes = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["__size"] == n
        sizes[r.source] = sizes.get(r.source, 0) + n
    targets, taken = fair_targets(sizes), {}
    for r in rows:
        assert r["__source_size"] == sizes[r.source] and r["__target"] == pytest.approx(targets[r.source], abs=1e-6)
        assert 0 <= r["__taken"] <= 3 * r["__size"]
        taken[r.source] = taken.get(r.source, 0) + r["__taken"]
    return rows, targets, taken


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, targets, taken = check(docs)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    again = mix.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r["__taken"]) for r in rows) == sorted((r.doc_id, r["__taken"]) for r in again)
    for r in rows:  # whole epochs come first
        assert r["__taken"] >= int(targets[r.source] // r["__source_size"]) * r["__size"]


def test_skewed_sources(spark):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 3 else f"s{k % 7}") for k in range(300)] + [(1000, "x y z", None), (1001, None, "empty"), (1002, "", "empty")]
    _, targets, taken = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets) and targets["empty"] == 0


NAMES = ("cut", "target", "source_size", "epochs", "tied", "at_cut", "taken", "size", "__size", "__taken", "__key", "__src", "__doc", "doc", "id", "words", "prefix", "rest", "a.b")


def test_columns_of_any_name(spark):
    rows = [(k, f"one two\nthree {k}", "a" if k < 8 else "b", *[f"{n}{k}" for n in NAMES]) for k in range(10)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    got = mix.mix_sources(df)
    # Columns of the added ones' names stay as well, and the added ones stand beside them.
    assert got.columns == [*df.columns, *mix.added_names(df.columns)]
    assert all(r["cut"] == f"cut{r.doc_id}" and r["a.b"] == f"a.b{r.doc_id}" for r in got.collect())
    for whole in (False, True):
        out = mix.mixed_documents(df, whole=whole)
        assert out.columns == df.columns and all(r["__size"] == f"__size{r.doc_id}" and r["words"] == f"words{r.doc_id}" for r in out.collect())


def test_repeated_rows(spark):
    rows = [(1, "a b c d", "s")] * 50 + [(2, "é f", "t"), (3, "g " * 90, "t")] + [(None, f"n{k} m", "u") for k in range(40)]
    _, targets, taken = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.mix_sources(empty).collect() == []


def test_heavier_documents_come_first(spark):
    rows = [(k, ("prosaic wording " if k % 2 else "x y ") * 20, "s") for k in range(4000)] + [(9999, "w " * 400000, "t")]
    got = mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 't' or __taken > 0").collect()
    assert len(got) > 1
    key = mix.with_keys(spark.createDataFrame(rows[:-1], "doc_id long, text string, source string")).groupBy("text").avg("__key").collect()
    by = {r.text[0]: r["avg(__key)"] for r in key}
    assert by["p"] < by["x"]


def test_mixed_documents(spark):
    rows = [(k, f"one two\nthree {k}", "a" if k < 8 else "b", "en", 0) for k in range(10)] + [(50, None, "b", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = mix.mixed_documents(df).collect()
    plan = {r.doc_id: r["__taken"] for r in mix.mix_sources(df).collect()}
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: n for d, n in plan.items() if n} and got[0].asDict().keys() == set(df.columns)


def test_parts_keep_their_spacing(spark):
    rows = [(k, f"one  two\nthree {k} four\tfive six", "a" if k < 8 else "b") for k in range(10)]
    got = mix.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    full = {k: t for k, t, _ in rows}
    assert any(r.text != full[r.doc_id] for r in got) and all(full[r.doc_id].startswith(r.text) for r in got)


@pytest.mark.parametrize("no_id", [False, True])
def test_whole_documents(spark, no_id):
    rows = [(None if no_id else k, f"one\n two {k}" + " w" * (k % 23), "a" if k < 300 else "b") for k in range(400)] + [(None, None, "a"), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.mixed_documents(df, whole=True).collect()
    full, sizes, words, times = {t: s for _, t, s in rows}, {}, {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in got:
        assert full[r.text] == r.source
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        times[r.text] = times.get(r.text, 0) + 1
    targets = fair_targets(sizes)
    for s, target in targets.items():
        assert -1 <= words[s] - target <= 25
        assert {times.get(t, 0) for t in full if t and full[t] == s} <= {int(target // sizes[s]), int(target // sizes[s]) + 1}
    if not no_id:
        assert {r.doc_id for r in got} == {r.doc_id for r in mix.mix_sources(df).collect() if r["__taken"]}


def test_columns_of_the_added_names_stay(spark):
    rows = [(k, "w " * (k + 1), "s", f"a{k}", k, 2.5, -k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, ___size int, __target double, __taken int")
    out = mix.mix_sources(df)
    assert out.columns == [*df.columns, "____size", "__source_size", "___target", "___taken"]
    plain = {r.doc_id: (r["__size"], r["__taken"], r["__target"]) for r in mix.mix_sources(df.select("doc_id", "text", "source")).collect()}
    for r in out.collect():
        assert (r["__size"], r["___size"], r["__target"], r["__taken"]) == (f"a{r.doc_id}", r.doc_id, 2.5, -r.doc_id)
        assert (r["____size"], r["___taken"], r["___target"]) == plain[r.doc_id]
    assert sorted(r.doc_id for r in mix.mixed_documents(df, whole=True).select("doc_id").distinct().collect()) == sorted(k for k, v in plain.items() if v[1])
