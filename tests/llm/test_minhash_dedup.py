import random

import numpy as np
import pytest

from lodestrata.llm import minhash_dedup as m
from lodestrata.llm.components import connected_components


def brute_force(rows, words, per_cent):
    sets = []
    for _, text in rows:
        own = m_words(text)
        sets.append({tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def m_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize(("words", "per_cent"), [(3, 85), (5, 80)])
def test_near_copies_of_hot_and_small_groups(spark, words, per_cent):
    rng = random.Random(words)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = fresh(130)
    texts = [edited(rng, base, rng.randrange(9)) for _ in range(150)]
    for _ in range(12):
        small = fresh(rng.choice([4, 30, 80, 300]))
        chain = [small]
        for _ in range(5):
            chain.append(edited(rng, chain[-1], rng.randrange(1, 4)).split())
        texts += [" ".join(c) for c in chain]
    texts += [" ".join(fresh(50)) for _ in range(30)] + ["one", "one two", "ONE  two", "one two", "", None, " \t\n", "ä ö ü", "Ä ö ü"]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(df, words=words, per_cent=per_cent).collect()}
    want = brute_force(rows, words, per_cent)
    assert got == want


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = m.query(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    rows = [(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (None, "a b c d e f g", 0), (None, "only null ids here in this text", 0), (5, None, 0), (6, "z " * 60000, 0), (7, "z " * 60001, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "cls")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in m.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (5, 5, True), (6, 6, True), (7, 6, False)], key=repr)
    assert m.near_duplicates(df.limit(0)).collect() == []


def test_sketches_estimate_high_similarities():
    rng = random.Random(1)
    base = [f"w{k}" for k in range(400)]
    a = m.shingle_set(" ".join(base), 3)
    b = m.shingle_set(edited(rng, base, 12), 3)
    common = len(set(a.tolist()) & set(b.tolist()))
    true = common / (len(a) + len(b) - common)
    xor = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(m.odd_sketch(m.min_samples(a)).tolist(), m.odd_sketch(m.min_samples(b)).tolist()))
    assert m.most_differing_bits(true + 0.12) <= xor <= m.most_differing_bits(true - 0.12)


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)] + [(7, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 1000 for k in range(1001, 1200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("null_id", [False, True])
def test_many_similar_texts_under_one_id(spark, null_id):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    one = None if null_id else 7
    rows = [(one, edited(rng, base, 1)) for _ in range(5000)] + [(3, "a text of its own that is like none of the others here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = m.near_duplicates(df).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(one, one, True, 5000), (3, 3, True, 1)], key=repr)


def test_a_bucket_of_many_distant_texts(spark, monkeypatch):
    """5,000 texts of which any two share about 65 % of their shingles, some with a close copy."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(4900):
        own = base[:96] + [f"x{k}_{i}" for i in range(24)]
        rows.append((k, " ".join(own)))
        if k % 49 == 0:
            rows.append((10_000 + k, " ".join(own[:-1])))
    seen = []
    kept = m._unlinked
    monkeypatch.setattr(m, "_unlinked", lambda pairs, *rest: seen.append(pairs.count()) or kept(pairs, *rest))
    got = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {d: d % 10_000 for d, _ in rows}
    assert seen and seen[0] < 20 * len(rows)


@pytest.mark.parametrize("few", [0, 2, 10**9])
def test_both_ways_to_distant_pairs_find_all(spark, monkeypatch, few):
    monkeypatch.setattr(m, "FEW", few)
    rng = random.Random(few)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base)]
    for _ in range(60):
        texts.append(edited(rng, base, rng.randrange(3, 14)))
        texts.append(edited(rng, texts[-1].split(), rng.randrange(0, 3)))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, per_cent=85).collect()}
    assert got == brute_force(rows, 3, 85)


def test_texts_of_one_template(spark, monkeypatch):
    """5,000 texts of 200 words, 30 of them of two values: any two share about 63 % of their shingles, few are links."""
    rng = np.random.default_rng(9)
    filled = rng.integers(0, 2, (5000, 30))
    # A fifth are close to one before.
    for k in range(4000, 5000):
        filled[k] = filled[k - 4000]
        filled[k, rng.choice(30, rng.integers(1, 8), replace=False)] ^= 1
    texts = []
    for own in filled:
        words = [f"w{k}" for k in range(200)]
        for slot, value in enumerate(own):
            words[3 + 6 * slot] = f"s{slot}_{value}"
        texts.append(" ".join(words))
    root = list(range(5000))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    # Each differing word is three shingles of either text: at 85 % no more than five of 30.
    apart = (filled[:, None, :] != filled[None, :1, :]).sum(2).ravel()
    assert 12 < apart.mean() < 18
    for i in range(5000):
        for j in np.flatnonzero((filled[i + 1 :] != filled[i]).sum(1) <= 5) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    seen = {}

    def counted(name, own):
        def run(*args):
            if name == "_unlinked":
                seen["into"] = args[0].count()
            out = own(*args)
            if name == "_by_difference":
                seen["found"] = out.count()
            return out

        return run

    for name in ("_unlinked", "_by_difference"):
        monkeypatch.setattr(m, name, counted(name, getattr(m, name)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in m.near_duplicates(df, words=3, per_cent=85).collect()}
    assert got == {k: find(k) for k in range(5000)}
    # Measured: 32 and 43 a text; all pairs are 2,500 a text, and were looked at about a hundred times each.
    assert seen["into"] < 40 * 5000 and seen["found"] < 60 * 5000


@pytest.mark.parametrize("hot", [0, 4, 10**9])
def test_rare_and_common_differences_find_all(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(m, "BLOCK_CLASSES", 7)
    rng = random.Random(hot)
    texts = []
    for _ in range(80):
        words = [f"w{k}" for k in range(90)]
        for slot in range(12):
            words[3 + 7 * slot] = f"s{slot}_{rng.randrange(2)}"
        texts.append(edited(rng, words, rng.randrange(3)))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, per_cent=85).collect()}
    assert got == brute_force(rows, 3, 85)
