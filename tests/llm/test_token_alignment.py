"""Alignments against whole-text encodings, counted pair by pair."""

import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import token_alignment as T
from lodestrata.llm.token_alignment import align, aligner_of, digest, piece_path, query, segments, stretches
from lodestrata.llm.tokens import _bytes_of_letters, default_path

TEXTS = [
    None, "", " ", "a", "The quick brown fox, jumps!", "two  spaces  and\n\nlines\tx ", " lead and trail  ", "naïve café ñandú über", "日本語 テキスト and 混ぜる",
    "😀 emoji 🤖🤖 here", "mark ▁ in text", "<|endoftext|> </s> <s> <unk> <0x41>", "x = 10025; y=3.14159", "\x1c \x85 odd\xa0space  　wide", "'s don't we'll I'M", "tiény Ωmega Привет мир", "aaaa" * 700 + " b",
    "under_score __init__ (a)(b) [c] {d}", "​ zero​width   thin", "end space ",
]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    with open(default_path(), encoding="utf-8") as f:
        held = json.load(f)
    letters = _bytes_of_letters()
    bytes_a = {k: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, k in held["model"]["vocab"].items()}
    return a, bytes_a, sentencepiece.SentencePieceProcessor(model_file=piece_path())


def plain(texts, encoders):
    """Every row's contract columns, with loops over all pairs of tokens."""
    a, bytes_a, b = encoders
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(map(bytes_a.get, ids_a)) != want or b"".join(map(piece, ids_b)) != want:
            docs.append(None)
            continue
        spans = []
        for ids, size in ((ids_a, lambda i: len(bytes_a[i])), (ids_b, lambda i: len(piece(i)))):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + size(i)))
                at += size(i)
            spans.append(own)
        links, k = [], 0
        for i, s, e in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        docs.append((len(ids_a), len(ids_b), links, groups))
        counts.update(links)
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[3]), len(d[2]), sum(counts[p] == best[p[1]] for p in d[2]), sum(counts[p] for p in d[2]), ";".join(d[3])) for d in docs]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_pairs_of_tokens(spark, encoders):
    texts = TEXTS + ["again the quick fox " * 30, "The quick brown fox, jumps!"]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, b int")
    assert as_rows(align(docs)) == sorted(((k, *row) for k, row in enumerate(plain(texts, encoders))), key=repr)


def test_long_texts_blocks_and_slices(spark, encoders, monkeypatch):
    """Stretches, blocks, rows and slices of a few postings each give the same rows."""
    for name, value in {"WINDOW_CHARS": 40, "BLOCK_POSTINGS": 50, "BLOCK_DOCS": 3, "SLICE_POSTINGS": 4, "HELD_SUMS": 5}.items():
        monkeypatch.setattr(T, name, value)
    texts = TEXTS + ["the cat and the dog met " * 40, "mark " * 60 + "▁", None, "the cat"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    got = align(docs)
    monkeypatch.undo()
    assert as_rows(got) == sorted(((k, *row) for k, row in enumerate(plain(texts, encoders))), key=repr)


def test_rows_of_a_block_and_a_short_memory(monkeypatch):
    monkeypatch.setattr(T, "ROW_POSTINGS", 2)
    monkeypatch.setattr(T, "MEMO_CHARS", 100)
    both = T.Aligner(default_path(), piece_path())
    seen = []
    for text in ["the cat met the dog", "another text of other words", "the cat met the dog"]:
        codes, n = both.read([text, text])
        assert n.tolist() == [5, 5]
        block = T._Block(9)
        block.add(0, *both.postings(codes, np.repeat([0, 3], n)))
        rows = block.rows(pa.int64()).to_pandas()
        assert rows["n"].max() <= 2 and set(rows["base"]) == {9} and rows["row"].isna().all()
        assert sum(rows["n"]) == 2 * len(set(both.postings(codes[:5], np.zeros(5, np.int64))[1]))
        seen.append(rows[["b", "n", "a", "doc", "times"]].to_dict("records"))
    assert seen[0] == seen[2] != seen[1]


def test_segments_meet_both_tokenizers(encoders):
    both, (a, _, b) = aligner_of(default_path(), piece_path()), encoders
    for text in filter(None, TEXTS):
        keys = [k for s in stretches(text, 7) for k in segments(s)]
        assert " ".join(keys) == text
        left, right, sound = both._encoded(keys)
        if all(sound):
            assert sum(left, []) == a.encode(" " + text, add_special_tokens=False).ids
            assert sum(right, []) == b.encode(text)


def test_edges(spark):
    rows = [(None, "one text"), (None, None), (4, "one text"), (4, "one text"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = as_rows(align(docs))
    assert len(got) == 5 and sum(r[1] > 0 for r in got) == 3 and len({r[1:] for r in got if r[1]}) == 1
    empty = align(docs.where("false"))
    assert empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"] and empty.count() == 0


def test_query(spark, sf_dir, encoders):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = as_rows(query(spark, sf_dir))
    want = [(r.doc_id, *p[:-1], digest(p[-1]) if p[-1] else "") for r, p in zip(rows, plain([r.text for r in rows], encoders), strict=True)]
    assert got == sorted(want, key=repr)
    assert digest("1|2") == hashlib.sha256(b"1|2").hexdigest()
