"""Operators whose other ways the registered queries don't take, against plain Python."""

import random

from lodestrata.operators import dense, graph, lookup
from lodestrata.sources.index import numbered
from lodestrata.storage import read_text, replace_text


def test_names_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    names = ["".join(rng.choice("aBcd.") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    asked = [*{"".join(rng.choice("abCd") for _ in range(rng.randrange(0, 6))) for _ in range(80)}, "zzz", "abzz", ""]
    symbols = spark.createDataFrame([(k, n.split(".")[-1], n) for k, n in enumerate(names)], "ord long, name string, qualified_name string")
    wanted = spark.createDataFrame([(a,) for a in asked], "name string")
    rows = lambda: sorted(map(tuple, lookup.find_symbols(symbols, wanted).select("asked", "ord", "name", "qualified_name").collect()))
    held = rows()
    monkeypatch.setattr(lookup, "BROADCAST_NAMES", 0)
    assert rows() == held and any(a not in (n, q) for a, _, n, q in held)


def test_nearest_against_all_scores(spark):
    rng = random.Random(2)
    vectors = {key: {rng.randrange(12): rng.choice([-1.0, 0.5, 1.0]) for _ in range(rng.randrange(3))} for key in range(90)}
    queries = {1: {0: 1.0}, 2: {b: -1.0 for b in range(12)}, 3: {50: 1.0}}
    table = spark.createDataFrame([(k, b, w) for k, v in vectors.items() for b, w in v.items()], "doc_id long, bucket int, w double")
    asked = spark.createDataFrame([(q, b, w) for q, v in queries.items() for b, w in v.items()], "query_id int, bucket int, w double")
    every = spark.createDataFrame([(k,) for k in vectors], "doc_id long")
    for k in (5, 40, 200):
        got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in dense.nearest(table, asked, every, k, "doc_id").collect()}
        for q, own in queries.items():
            scores = sorted((-sum(w * own.get(b, 0) for b, w in v.items()), key) for key, v in vectors.items())[:k]
            assert [got.pop((q, n)) for n in range(len(scores))] == [(key, -s) for s, key in scores]
        assert not got


def test_numbers_run_through_a_hot_key(spark):
    rows = [("b", k) for k in range(500)] + [("a", k) for k in range(20)] + [(None, 1), ("c", 7)]
    random.Random(3).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "s string, n long").repartition(5), "s", "n").orderBy("ord").collect()
    assert [(r.s, r.n) for r in got] == sorted(rows, key=lambda r: (r[0] or "", r[1])) and [r.ord for r in got] == list(range(len(rows)))


def test_small_files_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/CURRENT"
    assert read_text(spark, path) is None
    for text in ("one", '{"two": "ä"}'):
        replace_text(spark, path, text)
        assert read_text(spark, path) == text


def test_impact_of_many_starts_is_each_ones(spark):
    """150 starts, so that some words are full; a hub, cycles, and nodes that several types of edge reach."""
    rng = random.Random(3)
    rows = {(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}", rng.choice(["calls", "inherits", "imports", "contains"])) for _ in range(400)}
    rows |= {(f"n{k}", "n0", "calls") for k in range(1, 90)}
    edges = graph.typed_edges(spark.createDataFrame(sorted(rows), "src string, dst string, edge_type string"))
    starts = spark.createDataFrame([(f"n{k}",) for k in range(150)] + [("n3",), ("nowhere",)], "start string")
    got = sorted(map(tuple, graph.impact_many(edges, starts).collect()))
    assert got == sorted(map(tuple, graph.impact(edges, starts).select("start", "node", "depth", "via").collect())) and len(got) > 1500
    assert graph.impact_many(edges, starts.where("start = 'nowhere'")).collect() == graph.impact_many(edges.where("false"), starts).collect() == []
    assert sorted(map(tuple, graph.impact_many(edges, starts, max_depth=1).collect())) == [r for r in got if r[2] == 1]


def test_impact_writes_nothing_for_outer_nodes(spark, monkeypatch):
    """Each edge to a node that nothing depends on comes twice and is in no table that is written; either way of joining marks."""
    rows = [(f"b{k}", f"a{k % 3}", "inherits") for k in range(70)] + [(f"leaf{n}", f"b{n * k % 70}", ("calls", "imports")[n % 2]) for n in range(1500) for k in (1, 3)] + [("leaf1", "a1", "imports"), ("a1", "a1", "calls"), (None, "a1", "calls"), ("b1", None, "calls")]
    edges = spark.createDataFrame(rows * 2, "src string, dst string, edge_type string")
    starts = spark.createDataFrame([(f"a{k}",) for k in range(3)] + [(f"b{k}",) for k in range(70)] + [(None,)], "start string")
    want = sorted(map(tuple, graph.impact(graph.typed_edges(edges), starts).select("start", "node", "depth", "via").collect()))
    written, write = {}, graph.materialize

    def counted(df, name):
        table = write(df, name)
        written[name] = written.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(graph, "materialize", counted)
    for limit in (graph.BROADCAST_MARKS, 0):
        monkeypatch.setattr(graph, "BROADCAST_MARKS", limit)
        written.clear()
        got = graph.impact_many(edges, starts).collect()
        assert sum(written.values()) < 1000, written
        assert sorted(map(tuple, got)) == want and len(want) > 5000
    assert graph.impact_many(edges, starts, max_depth=0).collect() == []
