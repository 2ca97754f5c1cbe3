import hashlib

import numpy as np

from lodestrata.llm import cws_fingerprint as cws


def generalised_jaccard(a, b):
    words = set(a) | set(b)
    top = sum(max(a[w], b[w]) for w in words)
    return sum(min(a[w], b[w]) for w in words) / top if top else 1.0


def test_query_matches_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in cws.compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), block_rows=37).collect()}
    assert len(got) == len(docs)
    errors, by_text = [], {}
    for k, d in enumerate(docs):
        following = docs[(k + 1) % len(docs)].text or ""
        text, r = d.text or "", got[d.doc_id]
        edited = cws.edited_text(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        own, other, after = map(cws.bag_of, (text, edited, following))
        errors += [r.near_edited - generalised_jaccard(own, other), r.near_next - generalised_jaccard(own, after)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_one_block_gives_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = cws.compare_edits(docs, block_rows=20).collect()
    assert sorted(many) == sorted(cws.compare_edits(docs).collect())
    own = {r.doc_id: r.fingerprint for r in cws.fingerprint_documents(docs).collect()}
    assert own == {r.doc_id: r.fingerprint for r in many}


def test_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (4, None, 1), (None, "x", 1), (3, "", 1), (3, "...", 1), (2, "word " * 40000, 1)], "doc_id long, text string, block int")
    got = {(r.doc_id, r.n_chars): r for r in cws.compare_edits(df, block_rows=2).collect()}
    assert len(got) == 6
    assert got[(5, 11)].edited_sha256 == hashlib.sha256(b"a b c d ").hexdigest()  # the next is empty
    assert got[(4, 0)].near_next == 1.0 and got[(4, 0)].fingerprint == ""
    assert got[(3, 0)].near_next == 0.0 and got[(None, 1)].near_edited == 1.0
    one = cws.compare_edits(df.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert cws.compare_edits(df.limit(0)).collect() == []


def test_more_words_than_one_part():
    sampler = cws.Sampler(64)
    bag = cws.Counter({f"w{k}": 1 + k % 3 for k in range(5000)})
    half = cws.Counter({w: n for w, n in bag.items() if int(w[1:]) < 2500})
    assert abs(cws.likeness(sampler.sample(bag), sampler.sample(half)) - generalised_jaccard(bag, half)) < 0.25
    assert (sampler.sample(bag) == cws.Sampler(64).sample(bag)).all()


def test_long_documents_without_a_common_word():
    a, b = (cws.Counter({f"{x}{k}": 1 + k % 2 for k in range(60_000)}) for x in "ab")
    sampler = cws.Sampler(512)
    assert cws.likeness(sampler.sample(a), sampler.sample(b)) < 0.01
    c = cws.Counter({w: n for k, (w, n) in enumerate(a.items()) if k % 2}) + cws.Counter({w: n for k, (w, n) in enumerate(b.items()) if k % 2})
    assert abs(cws.likeness(sampler.sample(a), sampler.sample(c)) - generalised_jaccard(a, c)) < 0.1


def test_words_that_are_not_kept_draw_alike():
    bags = [cws.Counter({f"w{(k * 7 + d) % 900}": 1 + k % 3 for k in range(200)}) for d in range(30)]
    small, large = cws.Sampler(64, kept=16, kept_words=50), cws.Sampler(64)
    for bag in bags + bags:
        assert (small.sample(bag) == large.sample(bag)).all()


def test_many_texts_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(cws, "LEAST_ROWS", 40)
    rows = [(7, f"{k % 90:03d} text of one id {k}") for k in range(300)] + [(None, f"t{k % 9}") for k in range(60)] + [(9, "first"), (-(1 << 63), "least")]
    got = cws.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_rows=40).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    want = []
    for k, (d, text) in enumerate(order):
        edited = cws.edited_text(text, order[(k + 1) % len(order)][1])
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == sorted(want, key=repr)
