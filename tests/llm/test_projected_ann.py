import math

import duckdb
import numpy as np

from lodestrata.llm import projected_ann as ann


def test_chi_square_quantiles():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {}
    for q, rank, v, s in con.sql(ann.EXACT_SQL).fetchall():
        want.setdefault(q, {})[v] = s
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    for options in ({}, {"vector_block": 100, "query_block": 7}):
        got = {}
        for r in ann.nearest(vectors, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r)
        assert set(got) == set(want)
        hits = 0
        for q, rows in got.items():
            assert [r.rank for r in rows] == list(range(1, 21))
            assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
            hits += sum(r.vec_id in want[q] for r in rows)
            assert all(abs(r.score - want[q][r.vec_id]) < 1e-12 for r in rows if r.vec_id in want[q])
        assert hits / (20 * len(want)) >= 0.9


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [-1.0, 0.5], 1), (20, [1.0, 1.0], 1), (20, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (0, 4, 8, -1.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 8, -0.5)]
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.where("vec_id = 3")).collect() == []


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(60)], "vec_id long, embedding array<double>")
    for options in ({}, {"vector_block": 9}):
        got = ann.nearest(df, **options).where("query_id = 20").orderBy("rank").collect()
        assert [r.vec_id for r in got] == list(range(20))


def test_whole_search_equals_scan_when_certain():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 16)) * rng.uniform(0.2, 3, (500, 1))
    ids = rng.permutation(500)
    greatest, axes = math.sqrt((v**2).sum(axis=1).max()), ann.axes_of(16)
    tree = ann.ProjectedTree.loads(ann.ProjectedTree.build(ids, v, axes, greatest, leaf=16).dumps())
    bound = ann.chi_square_quantile(1 - 1e-9, ann.PROJECTIONS)
    for k in range(10):
        want = sorted((-float(v[j] @ v[k]), int(ids[j])) for j in range(500) if j != k)[:20]
        found, _ = tree.search(int(ids[k]), v[k], v[k] @ axes[:16], greatest, bound)
        assert sorted(-i for _, i in found) == sorted(i for _, i in want)


def test_structure_leaves_most_leaves_unvisited(spark):
    """Clustered unit vectors: few leaves are visited, and recall stays."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows, stats = ann.searched(df, vector_block=1500)
    got = {}
    for r in rows.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    products = v[::20] @ v.T
    hits = 0
    for k, q in enumerate(range(0, 6000, 20)):
        products[k, q] = -np.inf
        hits += len(got[q] & set(np.argsort(-products[k], kind="stable")[:20].tolist()))
    share = stats.first()
    assert hits / (20 * 300) >= 0.9 and share.visited < 0.4 * share.leaves
