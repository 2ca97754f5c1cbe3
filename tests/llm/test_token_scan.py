import numpy as np
import pytest

from lodestrata.llm import token_scan as t
from lodestrata.llm.tokens import Encoder, default_path


@pytest.mark.parametrize("block_ids", [7, 1000, t.BLOCK_IDS])
def test_counts_equal_tokenising(spark, sf_dir, block_ids):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoder = Encoder(default_path(), plain=True)
    want = {r.doc_id: len(encoder.ids(r.text)) for r in docs.limit(40).collect()} if block_ids == 7 else {r.doc_id: len(encoder.ids(r.text)) for r in docs.collect()}
    some = docs.where(docs.doc_id.isin(list(want)))
    assert {r.doc_id: r.n_tokens for r in t.count_tokens(some.repartition(3), block_ids=block_ids).collect()} == want


def test_query(spark, sf_dir):
    rows = t.query(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens"] and rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("ids", ["<u2", "<u4"])
def test_raw_files(spark, tmp_path, ids):
    end = t.END_OF_DOCUMENT
    rng = np.random.default_rng(1)
    want = []
    for name, closed in (("a.bin", True), ("b.bin", False), ("c.bin", True)):
        held = []
        for n in rng.integers(0, 30, 50):
            want.append((name, len(held), int(n), True))
            # A narrower type would make separators of those beyond it.
            held += [*(rng.integers(0, 50000, n) if ids == "<u2" else (1 << 16) + end + 0 * rng.integers(0, 9, n)), end]
        if not closed:
            want.append((name, len(held), 3, False))
            held += [1, 2, 3]
        (tmp_path / name).write_bytes(np.array(held, ids).tobytes() + b"x" * (name == "c.bin"))
    (tmp_path / "empty.bin").write_bytes(b"")
    for block_ids in (1, 10, 64, 100000):
        got = t.scan_separators(t.raw_files(spark, str(tmp_path)), ids=ids, block_ids=block_ids).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.start, r.n_tokens, r.complete) for r in got) == sorted(want)
        assert sorted(r.ordinal for r in got if r.file.endswith("a.bin")) == list(range(50))


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(np.array(([7] * 99 + [t.END_OF_DOCUMENT]) * 1000, "<u2").tobytes())
    got = t.scan_separators(t.raw_files(spark, str(tmp_path)), block_ids=1000)
    assert got.where("n_tokens = 99 and start = ordinal * 100").count() == 1000
    ranges = [f for f in got.inputFiles() if "separators" in f]
    assert len(ranges) > 1


def test_the_vocabulary_sets_the_width():
    assert t.id_type(65535) == "<u2" and t.id_type(65536) == "<u4" and t.id_type_of(default_path()) == "<u2"
    assert t.id_type_of(default_path(), end_id=70000) == "<u4"


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a null id", 0), (3, "<|endoftext|> is text here", 0), (4, "long " * 100000, 0), (5, "twice", 0), (5, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in t.count_tokens(df, block_ids=1000).collect())
    encoder = Encoder(default_path(), plain=True)
    assert got == sorted(((d or 0), len(encoder.ids(x))) for d, x, _ in rows) and t.END_OF_DOCUMENT not in encoder.ids(rows[3][1])
    assert t.count_tokens(df.limit(0)).collect() == []
