from lodestrata.plans import registry


def test_every_document_is_in_a_state(spark, sf_dir):
    want = sorted(f"{r.source}/{r.doc_id}" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = registry.QUERIES["incremental_diff_all"](spark, sf_dir).collect()
    assert sorted(r.file_path for r in got) == want and {r.status for r in got} == {"added", "removed", "changed", "unchanged"}
    vectors = registry.QUERIES["vector_reuse_all"](spark, sf_dir).collect()
    assert sorted(r.file_path for r in vectors) == want and {(r.vector or "none")[:4] for r in vectors} == {"old:", "new:", "none"}
