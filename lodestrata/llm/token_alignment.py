"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Every text is encoded by a byte-level BPE (A) and a sentencepiece model (B). An occurrence of an A
token and one of a B token are linked where their byte ranges overlap; offsets at which tokens of
both end cut the text into groups. How strongly a pair of ids belongs together is its count of links
in the whole corpus.

A document's pairs with their multiplicities are its postings. They are shuffled by the B id, the
side id: within a task's block of documents the postings of one id are a few byte strings, so a row
stands for many of them. Counts of pairs, and each B id's greatest, are computed where all of the
id's sums meet. Counts and postings then meet in one stream, sorted by Spark, which spills: an id's
counts come first, its postings after them are turned into contributions of documents, arrays for each
block, and these are summed by document. An id with many postings is split into slices by block, each with its own copy of
the counts; a copy is as long as A's vocabulary at most. Nothing but the number of slices for each B
id, as many rows as B's vocabulary has at most, is broadcast.

Texts are encoded in segments that begin with a space after a letter, digit or sign: no token of
either vocabulary runs across such a place, so segments that were met before needn't be encoded again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, table
from lodestrata.llm.tokens import _bytes_of_letters, default_path, encoder_of

#: Characters of texts that are worked on at a time, about.
WINDOW_CHARS = 1 << 20
#: Characters of segments, and some for each, that a worker remembers.
MEMO_CHARS = 1 << 24
#: Postings of a block; its documents are numbered by 16 bits.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Postings of one B id in a row, and in a slice, at most about.
ROW_POSTINGS, SLICE_POSTINGS = 1 << 15, 1 << 22
#: Sums that a task holds before it hands them on.
HELD_SUMS = 1 << 20
_A_BITS = 32
#: White space begins a segment only after one of these, of which no Unicode version says that it is white space.
_SOLID = r"[\w!-~¡-ɏ]"
_CUT, _LOOSE = re.compile(f"(?<={_SOLID}) "), re.compile(f"(?:^|(?!{_SOLID})[\\s\\S]) ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_STATS = ("n_a", "n_b", "n_groups", "n_links")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stretches(text: str, size: int = WINDOW_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end before a segment; the segment's space is left out."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def segments(stretch: str) -> list[str]:
    """A stretch's segments, each without the space that it begins with."""
    return _CUT.split(stretch) if _LOOSE.search(stretch) else stretch.split(" ")


class Aligner:
    """Both tokenizers, and the alignments of the segments met lately."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece

        self.a, self.b = encoder_of(byte_file, True), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        with open(byte_file, encoding="utf-8") as f:
            held = json.load(f)
        letters, added = _bytes_of_letters(), {t["content"]: t["id"] for t in held.get("added_tokens", ())}
        ids = held["model"]["vocab"] | added
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, k in ids.items():
            self.a_bytes[k] = token.encode() if token in added else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes.fromhex(m[1]) if self.b.is_byte(k) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        # A vocabulary with pieces that run into the next word is encoded in whole texts.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        names = lambda n, ends: [np.array([f"{k}{e}" for k in range(n)], object) for e in ends]
        (self.a_more, self.a_last), (self.b_more, self.b_last) = names(len(self.a_bytes), ",|"), names(len(self.b_bytes), ",;")
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.held, self.texts, self.facts, self.pool, self.begins = 0, [], np.empty((0, len(_STATS)), np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.sound = np.empty(0, bool)

    def _encoded(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, none where joined bytes differ from a space and the segment."""
        left = [self.a.ids(f" {key}").tolist() for key in keys]
        right = self.b.encode(keys, num_threads=1)
        sound = []
        for k, key in enumerate(keys):
            if not key:
                # White space at a text's end: the model adds no space to nothing.
                right[k] = [self.space]
            want = f" {key}".encode()
            sound.append(b"".join(map(self.a_bytes.__getitem__, left[k])) == want == b"".join(map(self.b_bytes.__getitem__, right[k])))
            if not sound[-1]:
                left[k], right[k] = [], []
        return left, right, sound

    def _learn(self, keys: list[str]) -> None:
        left, right, sound = self._encoded(keys)
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(keys)) for side in (left, right))
        a, b = (np.fromiter((i for ids in side for i in ids), np.int64) for side in (left, right))
        # Both sides of a segment have the same bytes, so offsets run on over all segments.
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(ends_b, ends_a - self.a_size[a], "right")
        met = np.searchsorted(ends_b - self.b_size[b], ends_a, "left") - first
        at = np.repeat(first - np.append(0, np.cumsum(met)[:-1]), met) + np.arange(met.sum())
        pairs = b[at] << _A_BITS | np.repeat(a, met)
        segment = np.repeat(np.arange(len(keys)), n_a)
        last_a, last_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
        n_links = np.bincount(segment, met, len(keys)).astype(np.int64)
        n_groups = np.bincount(segment[last_a], minlength=len(keys))
        # In writing, a group's B tokens follow its A tokens.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = np.where(last_a, self.a_last[a], self.a_more[a])
        written[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(last_b, self.b_last[b], self.b_more[b])
        stops = np.append(0, np.cumsum(n_a + n_b)).tolist()
        words = written.tolist()
        self.texts += ["".join(words[i:j])[:-1] for i, j in zip(stops[:-1], stops[1:], strict=True)]
        self.codes.update(zip(keys, range(len(self.codes), len(self.codes) + len(keys)), strict=True))
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.sound = np.append(self.sound, sound)
        self.begins = np.append(self.begins, len(self.pool) + np.cumsum(n_links))
        self.pool = np.append(self.pool, pairs)
        self.held += sum(map(len, keys)) + 64 * len(keys)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of segments, number of them in each text) of texts or their stretches. Codes hold until the next call."""
        parts = [segments(t) if self.cuts else [t] for t in texts]
        if self.held > MEMO_CHARS:
            self.forget()
        if new := list({k: None for keys in parts for k in keys if k not in self.codes}):
            self._learn(new)
        return np.fromiter((self.codes[k] for keys in parts for k in keys), np.int64), np.fromiter(map(len, parts), np.int64, len(parts))

    def gives_back(self, stretch: str) -> bool:
        """Both tokenizers' tokens hold the stretch byte by byte."""
        codes, _ = self.read([stretch])
        return bool(self.sound[codes].all())

    def postings(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, pair, multiplicity), a segment's pairs once for each that it holds."""
        both, times = np.unique(owner << 32 | codes, return_counts=True)
        code, own = both & 0xFFFFFFFF, both >> 32
        n = self.begins[code + 1] - self.begins[code]
        at = np.repeat(self.begins[code] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.repeat(own, n), self.pool[at], np.repeat(times, n)


@functools.lru_cache(maxsize=1)
def aligner_of(byte_file: str, piece_file: str) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(byte_file, piece_file)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and, for each, the sums of whole numbers."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], *[np.add.reduceat(v[order], first) for v in values]


class _Block:
    """Postings of a run of documents, written as rows by B id."""

    def __init__(self, base: int) -> None:
        self.base, self.parts, self.size = base, [], 0

    def add(self, first: int, doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        """``doc`` counts from the block's document ``first``."""
        self.parts.append((doc + first, pair, times))
        self.size += len(doc)

    def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        doc, pair, times = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64),) * 3
        order = np.lexsort((doc, pair))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.empty(0, np.int64)
        doc, pair, times = doc[first].astype("<u2"), pair[first], np.add.reduceat(times, first) if len(first) else times
        b, a = pair >> _A_BITS, (pair & 0xFFFFFFFF).astype("<u4")
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)
        stops = np.append(cut, len(b))
        stops = np.unique(np.concatenate([stops, *[np.arange(i, j, ROW_POSTINGS) for i, j in zip(stops[:-1], stops[1:], strict=True) if j - i > ROW_POSTINGS]])).tolist()
        spans = list(zip(stops[:-1], stops[1:], strict=True))
        narrow = lambda v: v.astype("<u1" if v.max() < 256 else "<u8").tobytes()
        return _record({"base": np.full(len(spans), self.base), "b": b[stops[:-1]], "n": np.diff(stops), "a": [a[i:j].tobytes() for i, j in spans], "doc": [doc[i:j].tobytes() for i, j in spans], "times": [narrow(times[i:j]) for i, j in spans]}, id_type)


def _numbers(row_n: int, a: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(times, "<u1" if len(times) == row_n else "<u8").astype(np.int64)


def _encoded(docs: DataFrame, kind: str, byte_file: str, piece_file: str, render: Callable[[str], str]) -> DataFrame:
    """A row for each document, and rows of postings, which have a ``b``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
        """(ids, texts) of a few rows each."""
        for batch in batches:
            size = pc.cumulative_sum(pc.coalesce(pc.utf8_length(batch["text"]), pa.scalar(0, pa.int32())).cast(pa.int64())).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(size // WINDOW_CHARS, prepend=0 if len(size) else [])), len(size))
            for i, j in zip(np.append(0, cuts).tolist(), cuts.tolist(), strict=False):
                if j > i:
                    part = batch.slice(i, j - i)
                    yield part["id"], [t or "" for t in part["text"].to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner_of(byte_file, piece_file)
        row = TaskContext.get().partitionId() << 40
        block, id_type = _Block(row), pa.null()
        for ids, texts in windows(batches):
            id_type = ids.type
            stats, groups = np.zeros((len(texts), len(_STATS)), np.int64), [""] * len(texts)
            if sum(map(len, texts)) <= 2 * WINDOW_CHARS:
                some = np.flatnonzero([bool(t) for t in texts])
                codes, n = both.read([texts[k] for k in some])
                owner = np.repeat(some, n)
                bad = np.zeros(len(texts), bool)
                bad[owner[~both.sound[codes]]] = True
                at = 0
                for k, length in zip(some.tolist(), n.tolist(), strict=True):
                    if not bad[k]:
                        groups[k] = render(";".join(map(both.texts.__getitem__, codes[at : at + length].tolist())))
                    at += length
                codes, owner = codes[~bad[owner]], owner[~bad[owner]]
                for c in range(len(_STATS)):
                    stats[:, c] = np.bincount(owner, both.facts[codes, c], len(texts))
                if row + len(texts) - block.base > BLOCK_DOCS:
                    yield block.rows(id_type)
                    block = _Block(row)
                block.add(row - block.base, *both.postings(codes, owner))
            else:
                # Long texts, each by stretches: one has tokens only if all of its stretches have.
                for k, text in enumerate(texts):
                    if not text or not all(map(both.gives_back, stretches(text, WINDOW_CHARS))):
                        continue
                    written = []
                    for stretch in stretches(text, WINDOW_CHARS):
                        codes, _ = both.read([stretch])
                        stats[k] += both.facts[codes].sum(0)
                        written.append(";".join(map(both.texts.__getitem__, codes.tolist())))
                        if block.size > BLOCK_POSTINGS or row + k - block.base >= BLOCK_DOCS:
                            yield block.rows(id_type)
                            block = _Block(row + k)
                        block.add(row + k - block.base, *both.postings(codes, np.zeros(len(codes), np.int64)))
                    groups[k] = render(";".join(written))
            yield _record({"row": np.arange(row, row + len(texts)), "id": ids, **{c: stats[:, k] for k, c in enumerate(_STATS)}, "groups": groups}, id_type)
            row += len(texts)
            if block.size > BLOCK_POSTINGS:
                yield block.rows(id_type)
                block = _Block(row)
        yield block.rows(id_type)

    kept = f"row long, id {kind}, " + ", ".join(f"{c} long" for c in _STATS) + ", groups string, base long, b int, n long, a binary, doc binary, times binary"
    return docs.mapInArrow(run, kept)


def _record(columns: dict, id_type: pa.DataType) -> pa.RecordBatch:
    """A batch of all columns, nulls where none are given."""
    long, blob = pa.int64(), pa.binary()
    kinds = {"row": long, "id": id_type, **dict.fromkeys(_STATS, long), "groups": pa.string(), "base": long, "b": pa.int32(), "n": long, "a": blob, "doc": blob, "times": blob}
    size = len(next(iter(columns.values())))
    given = lambda v, kind: v if isinstance(v, pa.Array) else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([given(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))


def _pair_sums(postings: DataFrame) -> DataFrame:
    """(b, a, links): a task's sums of what its blocks hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def total() -> tuple[np.ndarray, ...]:
            return summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

        as_rows = lambda keys, n: pd.DataFrame({"b": keys >> _A_BITS, "a": keys & 0xFFFFFFFF, "links": n})
        for batch in batches:
            for b, n, a, times in zip(batch["b"].tolist(), batch["n"].tolist(), batch["a"], batch["times"], strict=True):
                a, times = _numbers(n, a, times)
                held.append(summed(b << _A_BITS | a, times))
                size += len(held[-1][0])
                if size > 2 * HELD_SUMS:
                    held = [total()]
                    size = len(held[0][0])
                    if size > HELD_SUMS:
                        yield as_rows(*held[0])
                        held, size = [], 0
        if held:
            yield as_rows(*total())

    return postings.select("b", "n", "a", "times").mapInPandas(run, "b int, a int, links long")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, links): how many links of the corpus join the two ids."""
    return _pair_sums(postings).groupBy("b", "a").agg(F.sum("links").alias("links"))


def _contributions(postings: DataFrame, counts: DataFrame, slices: DataFrame) -> DataFrame:
    """(base, doc, n_best, count_sum): what a task's postings add to the documents of a block, as arrays."""
    # Not more rows than B's vocabulary.
    parts = F.broadcast(slices)
    each = counts.join(parts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), F.lit(0).alias("kind"), F.array_sort(F.col("pairs")).alias("pairs"))
    none = F.lit(None)
    told = each.select("b", "slice", "kind", F.transform("pairs", lambda p: p["a"]).alias("ids"), F.transform("pairs", lambda p: p["links"]).alias("links"), none.cast("long").alias("base"), none.cast("long").alias("n"), *[none.cast("binary").alias(c) for c in ("a", "doc", "times")])
    held = postings.join(parts, "b").select("b", F.pmod(F.xxhash64("base"), "parts").cast("int").alias("slice"), F.lit(1).alias("kind"), none.cast("array<int>").alias("ids"), none.cast("array<long>").alias("links"), "base", "n", "a", "doc", "times")
    stream = told.unionByName(held).repartition("b", "slice").sortWithinPartitions("b", "slice", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size = defaultdict(list), 0
        ids = links = np.empty(0, np.int64)

        def total() -> pd.DataFrame:
            rows = [(base, *(v.tobytes() for v in _summed_parts(own))) for base, own in kept.items()]
            return pd.DataFrame(rows, columns=["base", "doc", "n_best", "count_sum"])

        for batch in batches:
            for kind, own, count, base, n, a, doc, times in zip(*(batch[c] for c in ("kind", "ids", "links", "base", "n", "a", "doc", "times")), strict=True):
                if not kind:
                    ids, links = np.asarray(own, np.int64), np.asarray(count, np.int64)
                    continue
                a, times = _numbers(int(n), a, times)
                met = links[np.searchsorted(ids, a)]
                kept[int(base)].append(summed(np.frombuffer(doc, "<u2"), np.where(met == links.max(), times, 0), times * met))
                size += len(doc) // 2
                if size > HELD_SUMS:
                    yield total()
                    kept, size = defaultdict(list), 0
        if kept:
            yield total()

    return stream.mapInPandas(run, "base long, doc binary, n_best binary, count_sum binary")


def _summed_parts(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _by_document(contributions: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): the arrays of one block added up, a row for each of its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts = None, []

        def total() -> pd.DataFrame:
            doc, best, count = _summed_parts(parts)
            return pd.DataFrame({"row": at + doc.astype(np.int64), "n_best": best, "count_sum": count})

        for batch in batches:
            for base, doc, best, count in zip(batch["base"].tolist(), batch["doc"], batch["n_best"], batch["count_sum"], strict=True):
                if base != at and parts:
                    yield total()
                    parts = []
                at = base
                parts.append((np.frombuffer(doc, "<u2"), np.frombuffer(best, np.int64), np.frombuffer(count, np.int64)))
                # No more of a block is held than it has documents, some times over.
                if len(parts) == 64:
                    parts = [_summed_parts(parts)]
        if parts:
            yield total()

    by_block = contributions.repartition("base").sortWithinPartitions("base").mapInPandas(run, "row long, n_best long, count_sum long")
    # A document that runs on into another block has a row of each.
    return by_block.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_file: str | None = None, piece_file: str | None = None, render: Callable[[str], str] = str) -> DataFrame:
    """One row for each row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``groups`` is the alignment in writing, ``a1,a2|b1;a3|b2,b3``, put through ``render`` in the task
    that made it. ``n_best`` counts links whose pair has its B id's greatest count, ties included;
    ``count_sum`` adds the counts of a document's links. Texts that are null, empty, or that one of the
    tokenizers doesn't give back byte by byte have no tokens: zeros and an empty string. Strings of
    special tokens are ordinary text. Rows of one id, null ones and repeated rows are counted each.
    Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_encoded(own, kind, byte_file or default_path(), piece_file or piece_path(), render), "aligned")
    postings = rows.where("b is not null").select("base", "b", "n", "a", "doc", "times")
    sums = pair_counts(postings)
    # A B id has as many pairs as A has ids at most.
    counts = sums.groupBy("b").agg(F.collect_list(F.struct("a", "links")).alias("pairs"))
    slices = postings.groupBy("b").agg(F.ceil(F.sum("n") / SLICE_POSTINGS).cast("int").alias("parts"))
    added = materialize(_by_document(_contributions(postings, counts, slices)), "contributions")
    none = F.lit(0).cast("long")
    own = rows.where("row is not null").select("row", "id", *_STATS, "groups").join(added, "row", "left")
    return own.select(F.col("id").alias(id_col), *_STATS, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups")


def digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), render=digest).withColumnRenamed("groups", "groups_sha256")
