import numpy as np

from lodestrata.llm import quality_cnn as q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.93
    kept = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert np.mean(kept) >= 0.97


def test_whole_text_counts():
    net = q.ByteNet(3)
    net.max_w[:] = 1
    clean = "the quick brown fox jumps over a lazy dog and runs. " * 3000
    assert net.score(clean) != net.score(clean + "$$$ %%% ### " * 3)
    assert net.score("$$$ %%% ### " * 3 + clean) != net.score(clean)


def test_score_equals_plain_evaluation():
    net = q.ByteNet(5)
    for text in ("", "a", "hello " * 700, "é$" * 5000, None):
        symbols = q.symbols_of(text)
        got = net.responses(symbols)
        pooled = np.stack([np.maximum(got[s : s + q.CHUNK].max(axis=0) + net.bias, 0) for s in net.starts(len(got))])
        assert net.starts(len(got))[-1] + q.CHUNK >= len(got)
        logit = pooled.mean(axis=0) @ net.mean_w + pooled.max(axis=0) @ net.max_w + net.out[0]
        assert abs(net.score(text) - 1 / (1 + np.exp(-logit))) < 1e-5


def test_stretches_change_nothing(monkeypatch):
    texts = ("", "abcdefgh", "ab" * 900, "some text, repeated repeated repeated! " * 90, "é$x" * 1500)
    whole = [q.symbols_of(t) for t in texts]
    net = q.ByteNet(4)
    net.bias[:] = 0.05

    def gradients():
        grads = [{n: np.zeros_like(getattr(net, n)) for n in net.NAMES} for _ in texts]
        for symbols, own in zip(whole, grads, strict=True):
            q._gradient(net, symbols, 1.0, own)
        return grads

    plain = gradients()
    monkeypatch.setattr(q, "SYMBOL_STRETCH", 100)
    monkeypatch.setattr(q, "GRADIENT_CHUNKS", 2)
    assert all((q.symbols_of(t) == w).all() for t, w in zip(texts, whole, strict=True))
    for a, b in zip(plain, gradients(), strict=True):
        assert all(np.allclose(a[n], b[n], rtol=1e-3, atol=1e-5) for n in net.NAMES)


def test_gradient_by_differences():
    net = q.ByteNet(1)
    symbols = q.symbols_of("some text, repeated repeated repeated repeated! " * 40)
    grads = {n: np.zeros_like(getattr(net, n), dtype=np.float64) for n in net.NAMES}
    q._gradient(net, symbols, 1.0, grads)
    loss = lambda: -np.log(_score(net, symbols))
    for name, at in (("out", (0,)), ("mean_w", (3,)), ("max_w", (5,)), ("bias", (2,)), ("conv", (17, 4)), ("emb", (ord("e"), 2))):
        w = getattr(net, name)
        step = 1e-2
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-2 + 0.1 * abs(grads[name][at])


def _score(net, symbols):
    got = net.responses(symbols).astype(np.float64)
    pooled = np.stack([np.maximum(got[s : s + q.CHUNK].max(axis=0) + net.bias, 0) for s in net.starts(len(got))])
    return 1 / (1 + np.exp(-(pooled.mean(axis=0) @ net.mean_w + pooled.max(axis=0) @ net.max_w + net.out[0])))


def test_echoes_are_marked():
    assert (q.symbols_of("abcdefgh " * 4)[:100] >= 256).sum() > 15
    assert (q.symbols_of("abcdefgh ijklmnop qrstuvwx")[:26] >= 256).sum() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (3, "y" * 200000, 0.5), (3, "y" * 200000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    net = q.train(docs, none)
    assert [round(r.score, 3) for r in q.score_documents(docs.select("doc_id", "text"), q.fit([], [], 0.5)).collect()].count(0.5) >= 2
    assert q.score_documents(docs.drop("score"), net).count() == 5
    some = spark.createDataFrame([(1, 0), (2, 1), (3, None), (99, 1), (None, 0), (3, 7)], "doc_id long, quality int")
    scores = q.score_documents(docs.drop("score"), q.train(docs, some)).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert q.score_documents(docs.limit(0), net, keep=True).collect() == []
    assert q.score_documents(docs, net, keep=True).columns == ["doc_id", "text", "score", "__score"]
