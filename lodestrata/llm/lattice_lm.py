"""Language-model scores from a subword lattice: all segmentations of a text count, not one.

The vocabulary is an existing one: pieces of a sentencepiece model, those for single bytes included,
read as byte strings. Its file holds the order of merges, not probabilities, so the unigram scores
are relative frequencies: how often the vocabulary's own segmentation of the training texts uses
each piece, half an occurrence added to all. A text is its words, each behind the vocabulary's mark
of a word's beginning, and an end. No piece of the lattice runs past a word, so the forward
recursion over a text falls into recursions over its words: ``alpha[j]`` is the logarithm of the sum,
over pieces that end at byte j, of ``alpha[i]`` and the piece's score, and the marginal probability
of a text is the product of its words' and the end's.

Words are counted, and run through the recursion, once for the whole corpus. Documents go into
blocks of some megabytes; a block asks for each of its words once, so a word that stands in every
document is a row for each block, which is far less than a block's other words. What is known of the
words comes back to the block in parts of ``PART_WORDS``, and meets the block's documents in a stream
that Spark sorts, and spills. Numbers that go to the driver: piece counts, as many as the vocabulary
has pieces, and totals.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, table
from lodestrata.llm.token_alignment import piece_path

#: Bytes of a block's texts, about, and the documents that it may hold, numbered by 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 1 << 25, 1 << 16
#: Words of a block whose facts come back in one row.
PART_WORDS = 1 << 13
MARK = "▁".encode()
_SPACE, _BYTE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(r"<0x([0-9A-F]{2})>")


def held_out(doc_id: Column) -> Column:
    """Rows that the model isn't learnt from; a null id is an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


class Pieces:
    """The vocabulary's pieces that lattices are made of, by id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelt: dict[int, bytes] = {}
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k) and (m := _BYTE.fullmatch(piece)):
                self.spelt[k] = bytes.fromhex(m[1])
            elif not (self.model.is_control(k) or self.model.is_unknown(k) or "▁" in piece[1:]):
                self.spelt[k] = piece.encode()

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often the vocabulary's own segmentation of these words uses each id."""
        found = self.model.encode(words, num_threads=1)
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        total = np.zeros(self.model.get_piece_size(), np.int64)
        np.add.at(total, ids, np.repeat(times, np.fromiter(map(len, found), np.int64, len(found))))
        return total


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Natural logarithms of the probabilities of words under scores of pieces."""

    def __init__(self, scores: Mapping[bytes, float]) -> None:
        # Every ending of a piece, so that a search backwards stops where no piece is that long.
        self.endings: dict[bytes, float | None] = {piece[k:]: None for piece in scores for k in range(len(piece))}
        self.endings.update(scores)

    def log_marginal(self, text: bytes) -> float:
        """Of all segmentations of ``text`` together; minus infinity if there is none."""
        alpha, endings = [0.0], self.endings
        for j in range(1, len(text) + 1):
            terms = []
            for i in range(j - 1, -1, -1):
                ending = text[i:j]
                if ending not in endings:
                    break
                if (score := endings[ending]) is not None:
                    terms.append(alpha[i] + score)
            top = max(terms, default=-math.inf)
            alpha.append(top if len(terms) < 2 or top == -math.inf else top + math.log(sum([math.exp(t - top) for t in terms])))
        return alpha[-1]


def piece_scores(counts: Mapping[int, int], ends: int, spelt: Mapping[int, bytes]) -> tuple[dict[bytes, float], float]:
    """(scores of byte strings, score of a text's end): logarithms of smoothed relative frequencies.

    Two pieces of the same bytes, a letter and the piece for its byte, are two segmentations.
    """
    total = sum(counts.get(k, 0) for k in spelt) + ends + 0.5 * (len(spelt) + 1)
    chance: dict[bytes, float] = defaultdict(float)
    for k, piece in spelt.items():
        chance[piece] += (counts.get(k, 0) + 0.5) / total
    return {piece: math.log(p) for piece, p in chance.items()}, math.log((ends + 0.5) / total)


def stretches(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end at white space."""
    at = 0
    while len(data) - at > size and (cut := _SPACE.search(data, at + size)):
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:]


class _Block:
    """Words of a run of documents, numbered as they come, and which documents hold them how often."""

    def __init__(self, block: int, base: int) -> None:
        self.block, self.base, self.size = block, base, 0
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        #: (document, number of words) and the words' numbers, in order.
        self.docs: list[tuple[int, int]] = []
        self.codes: list[np.ndarray] = []
        self.learnt: list[bool] = []

    def add(self, row: int, words: list[bytes], trained: bool) -> None:
        self.codes.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.docs.append((row - self.base, len(words)))
        self.learnt.append(trained)

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each part of the words, a few at a time."""
        if not self.number:
            return
        count = np.bincount(np.concatenate([np.empty(0, np.uint32), *[c for c, own in zip(self.codes, self.learnt, strict=True) if own]]), minlength=len(self.number))
        doc, n = np.array(self.docs, np.int64).T
        both = np.concatenate(self.codes).astype(np.int64)
        self.codes.clear()
        both <<= 16
        both |= np.repeat(doc, n)
        both.sort()
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        times = np.diff(np.append(first, len(both))).astype("<u4")
        both = both[first]
        code, doc = (both >> 16).astype(np.uint32), (both & 0xFFFF).astype("<u2")
        del both, first
        starts = np.arange(0, len(self.number), PART_WORDS)
        at = np.append(np.searchsorted(code, starts), len(code)).tolist()
        within, words = (code % PART_WORDS).astype("<u2"), iter(self.number)
        for part, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
            own = [w.decode() for w in itertools.islice(words, PART_WORDS)]
            k = part * PART_WORDS
            yield _record({"block": [self.block], "base": [self.base], "part": [part], "words": [own], "counts": [count[k : k + PART_WORDS]], "doc": [doc[i:j].tobytes()], "code": [within[i:j].tobytes()], "times": [times[i:j].tobytes()]}, id_type)


def _record(columns: dict, id_type: pa.DataType) -> pa.RecordBatch:
    """A batch of all columns, nulls where none are given."""
    long, blob = pa.int64(), pa.binary()
    kinds = {"row": long, "id": id_type, "held": pa.bool_(), "n": long, "block": long, "base": long, "part": pa.int32(), "words": pa.list_(pa.string()), "counts": pa.list_(long), "doc": blob, "code": blob, "times": blob}
    size = len(next(iter(columns.values())))
    given = lambda v, kind: v if isinstance(v, pa.Array) else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([given(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))


def _blocks(docs: DataFrame, kind: str, block_bytes: int, block_docs: int) -> DataFrame:
    """A row for each document, with its number of words, and rows of blocks, which have a ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first = TaskContext.get().partitionId() << 40
        block, id_type = _Block(first, row), pa.null()
        for batch in batches:
            id_type, n = batch["id"].type, []
            for text, held in zip(batch["text"], batch["held"].to_pylist(), strict=True):
                data = (text.as_py() or "").encode().lower()
                n.append(0)
                for stretch in stretches(data, block_bytes):
                    if block.size >= block_bytes or row + len(n) - block.base > block_docs:
                        yield from block.rows(id_type)
                        block = _Block(block.block + 1, row + len(n) - 1)
                    words = stretch.split()
                    block.add(row + len(n) - 1, words, not held)
                    block.size += len(stretch)
                    n[-1] += len(words)
            yield _record({"row": np.arange(row, row + len(n)), "id": batch["id"], "held": batch["held"], "n": n}, id_type)
            row += len(n)
            del batch
        yield from block.rows(id_type)

    return docs.mapInArrow(run, f"row long, id {kind}, held boolean, n long, block long, base long, part int, words array<string>, counts array<long>, doc binary, code binary, times binary")


def _piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(piece, n) over the training words (word, c)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, total = pieces_of(path), 0
        for batch in batches:
            total = total + pieces.counts(batch["word"].tolist(), batch["c"].to_numpy())
        used = np.flatnonzero(total) if np.ndim(total) else np.empty(0, np.int64)
        yield pd.DataFrame({"piece": used, "n": total[used] if len(used) else used})

    return words.where("c > 0").select("word", "c").mapInPandas(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _scored_words(words: DataFrame, scores: dict[bytes, float]) -> DataFrame:
    """(word, c, lp), ``lp`` the logarithm of the word's marginal probability."""
    # As many scores as the vocabulary has pieces at most.
    held = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(held.value)
        for batch in batches:
            yield batch.assign(lp=[lattice.log_marginal(MARK + w.encode()) for w in batch["word"]])

    return words.mapInPandas(run, "word string, c long, lp double")


def _contributions(parts: DataFrame, facts: DataFrame, smooth: float) -> DataFrame:
    """(row, known, base_score, lp): what each block adds to its documents."""
    none = F.lit(None)
    told = facts.select("block", "part", F.lit(0).alias("kind"), F.transform("facts", lambda f: f["c"]).alias("c"), F.transform("facts", lambda f: f["lp"]).alias("lp"), none.cast("long").alias("base"), *[none.cast("binary").alias(c) for c in ("doc", "code", "times")])
    held = parts.select("block", "part", F.lit(1).alias("kind"), none.cast("array<long>").alias("c"), none.cast("array<double>").alias("lp"), "base", "doc", "code", "times")
    stream = told.unionByName(held).repartition("block").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base, sums = None, 0, np.empty(0)
        count = lp = np.empty(0)

        def out() -> pd.DataFrame:
            own = np.flatnonzero(sums[:, 0])
            return pd.DataFrame({"row": own + base, "known": sums[own, 1].astype(np.int64), "base_score": sums[own, 2], "lp": sums[own, 3]})

        for batch in batches:
            for block, kind, c, p, first, doc, code, times in zip(*(batch[k] for k in ("block", "kind", "c", "lp", "base", "doc", "code", "times")), strict=True):
                if not kind:
                    count, lp = np.asarray(c, np.float64), np.asarray(p, np.float64)
                    continue
                if block != at:
                    if at is not None:
                        yield out()
                    at, base, sums = block, int(first), np.zeros((BLOCK_DOCS, 4))
                doc, code, times = np.frombuffer(doc, "<u2"), np.frombuffer(code, "<u2"), np.frombuffer(times, "<u4").astype(np.float64)
                for k, value in enumerate((None, count > 0, np.log10((count + 0.5) / smooth), lp)):
                    sums[:, k] += np.bincount(doc, times if value is None else times * value[code], BLOCK_DOCS)
        if at is not None:
            yield out()

    return stream.mapInPandas(run, "row long, known long, base_score double, lp double")


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", piece_file: str | None = None, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between white space, A-Z in lower case, and an end. ``held``: the rows that nothing
    is learnt from. ``base_score`` and ``score`` are decimal logarithms of a text's probability as
    separate words and by the lattice. A null or empty text is its end alone. Rows of one id, null ids
    and repeated rows are learnt from and scored each. Without training rows all words are unknown and
    all pieces alike. Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    kind, path = dict(docs.dtypes)[id_col], piece_file or piece_path()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    rows = materialize(_blocks(own, kind, block_bytes, block_docs), "blocks")
    parts = rows.where("part is not null")
    each = parts.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("c"))
    words = materialize(each, "words")
    seen, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = rows.where("row is not null and not held").count()
    total, smooth = seen + ends, seen + ends + 0.5 * (distinct + (ends > 0) + 1)
    used = {r.piece: r.n for r in _piece_counts(words, path).collect()}
    scores, end = piece_scores(used, ends, pieces_of(path).spelt)
    scored = materialize(_scored_words(words, scores), "scored")

    asked = parts.select("block", "part", F.posexplode("words").alias("place", "word"))
    facts = asked.join(scored, "word").groupBy("block", "part").agg(F.array_sort(F.collect_list(F.struct("place", "c", "lp"))).alias("facts"))
    added = _contributions(parts, facts, smooth).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base_score", "lp")])
    added = materialize(added, "contributions")
    drop_table(words, scored)
    own = rows.where("row is not null").select("row", "id", "held", "n").join(added, "row", "left")
    of_end = math.log10((ends + 0.5) / smooth)
    return own.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"), (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.coalesce("base_score", F.lit(0.0)) + of_end).alias("base_score"), ((F.coalesce("lp", F.lit(0.0)) + end) / math.log(10)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
