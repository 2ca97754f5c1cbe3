"""Scores against all segmentations written out, and counts against plain ones."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.lattice_lm import Lattice, held_out, piece_scores, pieces_of, query, score_documents, stretches
from lodestrata.llm.token_alignment import piece_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def is_held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1


def all_segmentations(data, scores, longest):
    """Probability of ``data`` by adding up every way to cut it."""
    if not data:
        return 1.0
    return sum(math.exp(scores[data[:k]]) * all_segmentations(data[k:], scores, longest) for k in range(1, min(longest, len(data)) + 1) if data[:k] in scores)


def plain(rows):
    """Contract columns by whole-text recursion over probabilities; score as a function of the scores."""
    docs = [(k, WORD.findall(lowered(t))) for k, t in rows]
    learnt = [w for k, w in docs if not is_held(k)]
    c = Counter(x for w in learnt for x in w)
    ends, n = len(learnt), sum(c.values()) + len(learnt)
    v = len(c) + (ends > 0)
    pieces = pieces_of(piece_path())
    used = Counter(i for w in learnt for x in w for i in pieces.model.encode(x))
    scores, end = piece_scores(used, ends, pieces.spelt)
    base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return [(k, is_held(k), len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(base(c[x]) for x in w) + base(ends), w) for k, w in docs], scores, end


def whole_text(words, scores):
    """The forward recursion over the whole text at once, by prefixes of pieces."""
    data = b"".join("▁".encode() + w.encode() for w in words)
    longest = max(map(len, scores))
    alpha = [0.0] + [-math.inf] * len(data)
    for i in range(len(data)):
        for k in range(1, min(longest, len(data) - i) + 1):
            if (s := scores.get(data[i : i + k])) is not None:
                a, b = alpha[i + k], alpha[i] + s
                alpha[i + k] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
    return alpha[-1]


def check(got, rows):
    want, scores, end = plain(rows)
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx((whole_text(w[6], scores) + end) / math.log(10), rel=1e-9)


def test_lattice_adds_up_all_segmentations():
    scores = {b"a": math.log(0.3), b"b": math.log(0.2), b"ab": math.log(0.1), b"aba": math.log(0.05), b"ba": math.log(0.15)}
    lattice = Lattice(scores)
    for text in (b"", b"a", b"ab", b"abab", b"ababaabbaab"):
        assert math.exp(lattice.log_marginal(text)) == pytest.approx(all_segmentations(text, scores, 3))
    assert lattice.log_marginal(b"ac") == -math.inf


def test_scores_are_a_distribution():
    spelt = pieces_of(piece_path()).spelt
    scores, end = piece_scores({300: 7, 68: 2}, 3, spelt)
    assert sum(map(math.exp, scores.values())) + math.exp(end) == pytest.approx(1)
    # A letter's piece and its byte's are two ways to write it.
    assert scores[b"A"] > -math.inf and sum(p == b"A" for p in spelt.values()) == 2


TEXTS = ["The cat met the DOG", "the dog", None, "", "  \t\n", "x" * 3000, "Ünïcode ÀB 日本 😀 ▁mark a▁b", "the cat " * 500, "one\x0btwo\x0cthree\x85four five", "a a a a b"]


def test_against_whole_texts(spark):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(40)]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, row long, words string")
    check(score_documents(docs, held_out(F.col("doc_id"))).collect(), rows)


def test_small_blocks_and_stretches(spark):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    check(score_documents(docs, held_out(F.col("doc_id")), block_bytes=50, block_docs=3).collect(), rows)
    assert b" ".join(stretches(b"ab cd ef gh", 3)) == b"ab cd ef gh"


def test_edges(spark):
    rows = [(None, "null id"), (None, None), (5, "twice twice"), (5, "twice twice"), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    check(score_documents(docs, held_out(F.col("doc_id"))).collect(), rows)
    empty = score_documents(docs.where("false"), held_out(F.col("doc_id")))
    assert empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and empty.count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(docs, F.lit(True)).collect()}
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in (got[1], got[2])] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert got[1].score < got[2].score < 0


def test_query_and_what_is_learnt(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = query(spark, sf_dir).collect()
    check(got, rows)
    # Held-out texts are far more likely than under pieces that are all alike.
    scores, end = piece_scores({}, 0, pieces_of(piece_path()).spelt)
    flat, texts = Lattice(scores), {k: WORD.findall(lowered(t)) for k, t in rows}
    alike = sum(flat.log_marginal("▁".encode() + w.encode()) for r in got if r.held_out for w in texts[r.doc_id]) / math.log(10)
    assert sum(r.score for r in got if r.held_out) > 0.8 * alike
