import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from lodestrata.llm.source_mix import mix_sources

from .test_ga_packing import check
from .test_minhash_dedup import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "mix", "pack"] and pipeline.ORACLE_SQL is None
    held = docs
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, held, SF).write.parquet(str(tmp_path / name))
        before, held = held, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, held)
        if name != "pack":
            assert held.columns == docs.columns
    good = {r.doc_id for r in kept["quality"][1].collect()}
    assert all(d in good for d, q in labels.items() if q == 1)
    rows = [(r.doc_id, r.text) for r in kept["near_dedup"][0].collect()]
    want = brute_force(rows, 5, 80)
    assert {r.doc_id for r in kept["near_dedup"][1].collect()} == {d for d, (_, least) in want.items() if d == least}
    plan = {r.doc_id: r["__taken"] for r in mix_sources(kept["mix"][0]).collect()}
    words = {r.doc_id: r.n for r in kept["mix"][1].groupBy("doc_id").agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert set(words) == {d for d, n in plan.items() if n}
    used, least = check(held.collect(), {})
    assert used <= least * 1.01 + 1


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50


NAMES = ("cut", "target", "__size", "__row", "row", "body", "doc", "cls", "id", "key", "block", "n", "component_id", "__score", "a.b")


def test_empty_and_odd_documents(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    texts = [(1, None, None), (2, "", "s"), (None, "plain words of a text without an id", "s"), (3, "plain words of a text", None), (4, long, "s"), (5, "told twice in the very same words", "t"), (5, "told twice in the very same words", "t")]
    rows = [(i, t, "en", s, len(t or ""), *[f"{n}{k}" for n in NAMES]) for k, (i, t, s) in enumerate(texts)]
    odd = spark.createDataFrame(rows, ", ".join(f"`{c}` string" if c not in ("doc_id", "n_chars") else f"{c} long" for c in ("doc_id", "text", "lang", "source", "n_chars", *NAMES)))
    scored = pipeline.quality(spark, odd, SF)
    assert scored.columns == odd.columns and all(r["a.b"][:3] == "a.b" for r in scored.collect())
    single = pipeline.near_dedup(spark, odd, SF)
    assert single.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=repr) == sorted({(i, t) for i, t, _ in texts}, key=repr)
    taken = pipeline.mix(spark, odd, SF)
    assert taken.columns == odd.columns
    got = taken.collect()
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in texts if t} and all(r["cut"] == "cut" + r["a.b"][3:] for r in got)
    packed = pipeline.pack(spark, odd, SF).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == {i for i, _, _ in texts} and {r.doc_id: r[1] for r in packed}[1] == 1
    held = odd.limit(0)
    for name, stage in pipeline.STAGES:
        held = stage(spark, held, SF)
        assert held.collect() == [] and (name == "pack" or held.columns == odd.columns)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    texts = [(None, a), (1, a), (None, b), (2, c), (2, c), (3, a + " end"), (4, c + " end"), (4, "quite another text that stands under the id four"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (None, b), (2, c), (4, texts[7][1]), (None, None), (None, "")], key=repr)
